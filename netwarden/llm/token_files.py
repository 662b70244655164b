"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

The documents are tokenized where they lie (the ids are stored once, two or four bytes
each); the ids are counted over the corpus and ranked, the most frequent first, so that
most ranks fit one byte. The narrow ids are range-partitioned by doc_id; files hold blocks
of documents: a control stream (two bits per id: the number of its bytes less one)
apart from the data stream, read back by a table of 256 control bytes in numpy.

File format (one binary record per block, in Parquet rows `part, seq, block`):
  magic "NWTK", uint32 documents, uint32 ids,
  uint32 ids per document, control bytes (4 ids each, low bits first), data bytes.
The rank table is the file set's `ranks` table (rank -> id).

Defined cases: a null text counts as empty and holds only the end id; documents are
ordered by doc_id (nulls first), equal ones by their token ids; an empty table gives empty files;
a text of any length is one document of one block.
"""
from __future__ import annotations

import hashlib
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netwarden.llm.common import MADE, map_arrow, map_batches, stored
from netwarden.session import scratch_path

MAGIC = b"NWTK"
#: Ids of one block, at most one document more.
BLOCK_IDS = 1 << 16
#: Chunks of one call of the library, and bytes of ids of one part of the files, about.
CALL, PART_BYTES = 64, 16 << 20
#: Chunks whose ids a worker keeps from batch to batch, and the longest of them in bytes.
KEPT, KEPT_BYTES = 1 << 20, 64

# --- variable-length coding ---------------------------------------------------
_SHIFT = np.arange(0, 8, 2, dtype=np.uint8)
#: control byte -> bytes of each of its four ids
LENGTHS = ((np.arange(256, dtype=np.uint8)[:, None] >> _SHIFT) & 3) + 1


def pack(values: np.ndarray) -> bytes:
    """control bytes, then data bytes, of unsigned 32-bit values"""
    v = values.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[:len(v)] = code
    control = (padded.reshape(-1, 4) << _SHIFT).sum(1).astype(np.uint8)
    used = np.arange(4) <= code[:, None]
    return control.tobytes() + v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(data: bytes, n: int, at: int = 0) -> np.ndarray:
    control = np.frombuffer(data, np.uint8, -(-n // 4), at)
    lens = LENGTHS[control].ravel()[:n].astype(np.int64)
    body = np.frombuffer(data, np.uint8, -1, at + len(control))
    body = np.concatenate([body, np.zeros(4, np.uint8)])
    start = np.cumsum(lens) - lens
    out = body[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lens > k)
        out[more] |= body[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(docs: list[np.ndarray]) -> bytes:
    sizes = np.array([len(x) for x in docs], "<u4")
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    head = np.array([len(sizes), len(ids)], "<u4")
    return MAGIC + head.tobytes() + sizes.tobytes() + pack(ids)


def read_block(block: bytes) -> list[np.ndarray]:
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    docs, n = np.frombuffer(block, "<u4", 2, 4).tolist()
    sizes = np.frombuffer(block, "<u4", docs, 12)
    ids = unpack(block, n, 12 + 4 * docs)
    return np.split(ids, np.cumsum(sizes)[:-1]) if docs else []


# --- tokenizing with the library, chunk by chunk --------------------------------
class Chunked:
    """The tokenizer drops white space and never joins across it, so a text's ids are the ids of its
    chunks. The distinct chunks of a batch are encoded many to a call, a blank between them; a call's ids
    are cut where as many bytes are used up as a chunk has. Where that does not come out (special tokens,
    white space inside a chunk, letters whose normal form is longer or shorter), the chunks of the call
    are encoded one by one. The ids of the first KEPT short chunks are kept for the batches that follow."""

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_str(spec.decode())
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab()
        suffix = json.loads(spec)["model"].get("end_of_word_suffix") or ""
        #: id -> bytes of text it stands for (one printable character each)
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.size[i] = len(token.removesuffix(suffix))
        #: chunks seen before, their ids one after another, and where each chunk's begin and how many they are
        self.known = pa.array([], pa.string())
        self.known_ids, self.known_first, self.known_n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks one after another, and where each chunk's end."""
        names = chunks.to_pylist()
        sizes = pc.binary_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        calls = [" ".join(names[k:k + CALL]) for k in range(0, len(names), CALL)]
        got = [e.ids for k in range(0, len(calls), 64)
               for e in self.lib.encode_batch_fast(calls[k:k + 64], add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(got), np.uint32)
        used = np.concatenate([[0], np.cumsum(self.size[ids])])
        want = np.cumsum(sizes)
        ends = np.searchsorted(used, want)
        if len(want) == 0 or (used[-1] == want[-1] and (used[ends] == want).all()):
            return ids, ends
        parts = [self._cut(got[k], names[k * CALL:(k + 1) * CALL], sizes[k * CALL:(k + 1) * CALL]) for k in range(len(got))]
        flat = [x for part in parts for x in part]
        return np.concatenate(flat), np.cumsum([len(x) for x in flat])

    def _cut(self, ids: list[int], names: list[str], sizes: np.ndarray) -> list[np.ndarray]:
        v = np.array(ids, np.uint32)
        used, want = np.concatenate([[0], np.cumsum(self.size[v])]), np.cumsum(sizes)
        ends = np.searchsorted(used, want)
        if used[-1] == want[-1] and (used[ends] == want).all():
            return np.split(v, ends[:-1])
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(names, add_special_tokens=False)]

    def _looked_up(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each chunk's begin in them and how many they are; only chunks not seen before are encoded."""
        place = pc.index_in(chunks, value_set=self.known)
        new = place.is_null()
        fresh, new = chunks.filter(new), new.to_numpy(zero_copy_only=False)
        got, ends = self._ids(fresh)
        starts = np.concatenate([[0], ends[:-1]])[:len(ends)].astype(np.int64)
        sizes = (ends - starts).astype(np.int64)
        ids = np.concatenate([self.known_ids, got])
        first, n = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        old = place.drop_null().to_numpy()
        first[~new], n[~new] = self.known_first[old], self.known_n[old]
        first[new], n[new] = len(self.known_ids) + starts, sizes
        short = pc.less_equal(pc.binary_length(fresh), KEPT_BYTES).to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(short)[:KEPT - len(self.known)]
        if len(keep):
            at = np.cumsum(sizes[keep]) - sizes[keep]
            self.known_first = np.concatenate([self.known_first, len(self.known_ids) + at])
            self.known_n = np.concatenate([self.known_n, sizes[keep]])
            self.known_ids = np.concatenate([self.known_ids, got[np.repeat(starts[keep] - at, sizes[keep]) + np.arange(sizes[keep].sum())]])
            self.known = pa.concat_arrays([self.known, fresh.take(pa.array(keep))])
        return ids, first, n

    def encode_all(self, texts: pa.Array | list[str]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers"""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))     # other white space stays in a chunk
        words = lists.flatten().dictionary_encode()
        pool, first, n = self._looked_up(words.dictionary)
        # the ids of all chunks one after another, then cut by text
        at = words.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(n[at])])
        ids = pool[np.repeat(first[at] - ends[:-1], n[at]) + np.arange(ends[-1])].astype("<u4")
        cut = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        return [ids[lo:hi].tobytes() for lo, hi in zip(cut, cut[1:])]


_LOADED: dict[bytes, Chunked] = {}


def loaded(spec: bytes) -> Chunked:
    key = hashlib.sha256(spec).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Chunked(spec)
    return _LOADED[key]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text") -> DataFrame:
    """doc_id, ids (binary) of every document, stored. The texts are not shuffled."""
    with open(tokenizer, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())      # the vocabulary file
    tail = np.array([end_id], "<u4").tobytes()

    def run(t: pa.Table) -> pa.Table:
        got = loaded(spec.value).encode_all(t.column("text").combine_chunks().fill_null(""))
        return pa.table({"doc_id": t.column("doc_id"), "ids": pa.array([_narrow(x + tail) for x in got], pa.binary())})

    return stored(map_batches(docs.selectExpr("doc_id", f"`{text}` AS text"), run, "doc_id bigint, ids binary",
                              rows=1 << 14, max_bytes=12 << 20), "token-ids")


def in_order(ids: DataFrame) -> DataFrame:
    """part, seq, doc_id, ids: the documents range-partitioned and sorted by doc_id, equal ones by their ids."""
    size = ids.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("n")).first().n
    return (ids.repartitionByRange(max(8, -(-size // PART_BYTES)), "doc_id").sortWithinPartitions("doc_id", "ids")
            .select(F.spark_partition_id().alias("part"),
                    F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("seq"), "doc_id", "ids"))


def _narrow(ids: bytes) -> bytes:
    """One marker byte, then the ids in two bytes each where they all fit."""
    v = np.frombuffer(ids, "<u4")
    return b"\2" + v.astype("<u2").tobytes() if v.max() < 1 << 16 else b"\4" + ids


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", -1, 1).astype(np.uint32)


def rank_table(ids: DataFrame, n_ids: int) -> DataFrame:
    """rank, id, n: all ids of the vocabulary by falling frequency (ties: smaller id first)."""

    def count(batches):
        total = np.zeros(n_ids, np.int64)
        for b in batches:
            for x in b.column("ids").to_pylist():
                total += np.bincount(_wide(x), minlength=n_ids) if len(x) > n_ids else 0
                if len(x) <= n_ids:
                    np.add.at(total, _wide(x), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])

    spark = ids.sparkSession
    counts = map_arrow(ids.select("ids"), count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    every = spark.range(n_ids).join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    # one row per vocabulary id: a window over the whole table is bounded by the vocabulary
    return stored(every.select(F.row_number().over(Window.orderBy(F.desc("n"), "id")).cast("long").alias("r"), "id", "n")
                  .select((F.col("r") - 1).alias("rank"), "id", "n"), "token-ranks")


def write_files(ids: DataFrame, ranks: DataFrame) -> str:
    """Write the blocks and the rank table; the folder."""
    spark = ids.sparkSession
    order = np.array([r.id for r in ranks.orderBy("rank").collect()], np.int64)       # bounded by the vocabulary
    to_rank = np.zeros(len(order), np.uint32)
    to_rank[order] = np.arange(len(order), dtype=np.uint32)
    table = spark.sparkContext.broadcast(to_rank)

    def blocks(batches):
        rank = table.value
        part, seq, docs, names, n = None, 0, [], [], 0

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([names], pa.list_(pa.int64())),
                 pa.array([write_block(docs)], pa.binary())], ["part", "seq", "doc_ids", "block"])

        for b in batches:
            for p, s, d, x in zip(*(b.column(k).to_pylist() for k in ("part", "seq", "doc_id", "ids"))):
                if docs and (p != part or n >= BLOCK_IDS):
                    yield done()
                    docs, names, n = [], [], 0
                if not docs:
                    part, seq = p, s
                docs.append(rank[_wide(x)])
                names.append(d)
                n += len(docs[-1])
        if docs:
            yield done()

    path = scratch_path(spark, "token-files")
    MADE.append((path, None))
    map_arrow(ids, blocks, "part int, seq bigint, doc_ids array<bigint>, block binary").write.parquet(f"{path}/blocks")
    ranks.write.parquet(f"{path}/ranks")
    return path


def read_files(spark, path: str) -> DataFrame:
    """part, seq, at, doc_id, ids (binary, little-endian unsigned 32-bit) of every document in the files."""
    order = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    table = spark.sparkContext.broadcast(order)

    def run(batches):
        ids = table.value
        for b in batches:
            for p, s, names, block in zip(*(b.column(k).to_pylist() for k in ("part", "seq", "doc_ids", "block"))):
                got = [ids[x].astype("<u4").tobytes() for x in read_block(block)]
                k = len(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * k, pa.int32()), pa.array([s] * k, pa.int64()), pa.array(range(k), pa.int32()),
                     pa.array(names, pa.int64()), pa.array(got, pa.binary())],
                    ["part", "seq", "at", "doc_id", "ids"])

    return map_arrow(
        spark.read.parquet(f"{path}/blocks"), run, "part int, seq bigint, at int, doc_id bigint, ids binary")


def file_report(docs: DataFrame, tokenizer: str, end_id: int, n_ids: int, text: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    ids = tokenized(docs, tokenizer, end_id, text)
    path = write_files(in_order(ids), rank_table(ids, n_ids))
    back = read_files(docs.sparkSession, path)
    rows = stored(back.select("part", "seq", "at", "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                              F.crc32("ids").alias("ids_crc32")), "token-rows")
    # ids before each part (a table bounded by the number of files), then before each document of the part
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq", "at")) - F.col("n_tokens")
    return (rows.withColumn("inside", inside).join(before, "part")
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))
