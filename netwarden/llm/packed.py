"""Corpus counts of very many keys, by chunks.

Documents are tokenized into chunks of about half a million words, stored compactly. A chunk
counts its own 64-bit keys first and sends each distinct key once, in packed arrays, to a
hash bucket; a bucket sums over all chunks and sends the counts back to the chunks that
hold the keys. A key that a third of all rows hold is one entry per chunk.
"""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import MADE, map_arrow, sweep
from netwarden.session import scratch_path

#: Tokens of one chunk (or one longer document) and distinct keys of one bucket, about.
CHUNK_TOKENS, BUCKET_KEYS = 500_000, 1_000_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, in order."""
    x = (a ^ (a >> np.uint64(29))) * _M1 + b
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def planes(v: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compresses well."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, v.dtype.itemsize).T).tobytes()


def unplanes(b: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


# --- chunks ---------------------------------------------------------------------
CHUNKS = "chunk bigint, doc_ids array<bigint>, lens array<int>, train array<boolean>, words binary, tokens binary"


def _tokenize(batches):
    at = TaskContext.get().partitionId() << 32
    known: dict[bytes, int] = {}
    ids, lens, train, tokens, n = [], [], [], [], 0

    def row():
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64)
        cols = [[at], [ids], [lens], [train], [hashes.tobytes()], [planes(np.concatenate(tokens))]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          ["chunk", "doc_ids", "lens", "train", "words", "tokens"])

    for b in batches:
        for d, t, x in zip(*(b.column(k) for k in ("doc_id", "train", "text"))):
            words = (x.as_py() or "").encode().lower().split()
            ids.append(d.as_py())
            lens.append(len(words))
            train.append(t.as_py())
            tokens.append(np.array([known.setdefault(w, len(known)) for w in words], np.uint32))
            n += len(words) + 1
            if n >= CHUNK_TOKENS:
                yield row()
                at, known, ids, lens, train, tokens, n = at + 1, {}, [], [], [], [], 0
    if ids:
        yield row()


def rows_of(batches):
    """Chunk rows as dictionaries, one at a time: several would not fit a worker."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def tokens_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word counts of the documents, hashes of the distinct words, and each word's place in them"""
    return np.array(row["lens"], np.int64), np.frombuffer(row["words"], np.uint64), unplanes(row["tokens"], "<u4")


KEYS = "bucket int, chunk bigint, kind int, keys binary, n binary"


def packed_rows(chunk: int, parts, bits: int) -> pa.RecordBatch:
    """The sorted distinct keys and counts of each kind, cut by their leading bits."""
    out = []
    for kind, keys, n in parts:
        cut = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        edges = [0, *cut.tolist(), len(keys)]
        for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
            if hi > lo:
                out.append((k, chunk, kind, planes(np.diff(keys[lo:hi], prepend=np.uint64(0))),
                            planes(n[lo:hi].astype("<u4"))))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    cols = list(zip(*out)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)],
                                      ["bucket", "chunk", "kind", "keys", "n"])


def _sum(t: pa.Table) -> pa.Table:
    """One bucket and kind: the corpus counts of every chunk's keys; chunk -1 holds the totals."""
    keys = [np.cumsum(unplanes(x, "<u8"), dtype=np.uint64) for x in t.column("keys").to_pylist()]
    n = [unplanes(x, "<u4") for x in t.column("n").to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(n), minlength=len(distinct)).astype("<u8")
    cut = np.cumsum([len(k) for k in keys])
    got = np.split(total[at], cut[:-1])
    kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
    rows = len(keys)
    return pa.table({
        "chunk": pa.array([*t.column("chunk").to_pylist(), -1], pa.int64()), "kind": pa.array([kind] * (rows + 1), pa.int32()),
        "bucket": pa.array([bucket] * (rows + 1), pa.int32()),
        "counts": pa.array([*(planes(x) for x in got), b""], pa.binary()),
        "types": pa.array([0] * rows + [int((total > 0).sum())], pa.int64()),
        "tokens": pa.array([0] * rows + [int(total.sum())], pa.int64())})


def counts_of(row: dict, kind: int) -> np.ndarray:
    parts = sorted((x for x in row["counts"] if x["kind"] == kind), key=lambda x: x["bucket"])
    return np.concatenate([unplanes(x["counts"], "<u8") for x in parts] or [np.zeros(0, np.uint64)])


def table_buckets(size: int) -> int:
    """Buckets of a table over so many bytes of text (100,000 is Spark's most)."""
    return int(min(100_000, max(8, size // (24 << 20))))


def bucketed(df: DataFrame, name: str, n: int) -> DataFrame:
    """A table stored in the shared folder in n buckets by chunk (joins on chunk need no shuffle)."""
    spark = df.sparkSession
    table = f"netwarden_{name}_{uuid.uuid4().hex[:12]}"
    path = scratch_path(spark, table)
    MADE.append((path, table))
    df.write.bucketBy(n, "chunk").option("path", path).option("compression", "zstd") \
        .format("parquet").saveAsTable(table)
    sweep(spark)
    return spark.table(table)


def chunked(docs: DataFrame, doc_id: str, text: str, train: Column) -> tuple[DataFrame, int, int]:
    """The stored chunks, the number of table buckets, and the bits of a key bucket."""
    t = F.col(f"`{text}`")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(t)), F.lit(0)).alias("n")).first().n
    files = table_buckets(size)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), train.alias("train"), t.alias("text"))
    return (bucketed(map_arrow(rows, _tokenize, CHUNKS), "chunks", files), files,
            max(3, int(size / 8 / BUCKET_KEYS).bit_length()))


def with_counts(chunks: DataFrame, emit, files: int) -> tuple[DataFrame, DataFrame]:
    """The chunks joined with the corpus counts of their keys (packed), and the totals of each bucket."""
    summed = map_arrow(chunks, emit, KEYS).groupBy("bucket", "kind").applyInArrow(
        _sum, "chunk bigint, kind int, bucket int, counts binary, types bigint, tokens bigint")
    counts = bucketed(summed, "counts", files)
    each = counts.filter("chunk >= 0").groupBy("chunk").agg(
        F.collect_list(F.struct("kind", "bucket", "counts")).alias("counts"))
    return chunks.join(each.hint("merge"), "chunk"), counts.filter("chunk = -1")
