"""Alignment of two tokenizers over the corpus.

Both tokenizers cut the same bytes (a space, then the text). In every Arrow batch the id
lists are flattened, a segmented running sum of the tokens' byte lengths gives the offset at
which each token ends in its document, and an Acero hash join on (document, end) finds
the tokens that end together: the links, which also cut both sequences into groups. Links
are counted by id pair within a chunk of documents (`Table.group_by`), Spark merges the
chunks' counts, and every chunk gets the corpus counts of its own pairs back.

A chunk holds its documents' links as places in its list of distinct pairs, so that a pair
that is everywhere is one row per chunk, and no pass tokenizes again.

Defined cases: a null or empty text, or one whose bytes one tokenizer does not give back
(normalisation, the metaspace itself), has no tokens, hence zeros and no groups; strings of special
tokens are plain text; a text of any length is one document of one chunk; equal rows count
as often as they occur and give equal results; doc_id may be null or repeat; an empty table
gives an empty one; of other columns, also of such names as `links`, only doc_id and the
text are read.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.bpe import byte_letters
from netwarden.llm.common import map_arrow, stored
from netwarden.llm.packed import bucketed, planes, table_buckets, unplanes

#: Bytes of text of one chunk of documents, and of one call of the tokenizers (or one longer document).
CHUNK_BYTES, CALL_BYTES = 3 << 20, 1 << 19
#: Chunks of text kept by a Python worker.
CACHE = 250_000
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = f"[{_SPACES}]*[^{_SPACES}]*"
#: A blank and all up to the next one that follows other than white space.
CHUNK = re.compile(f" {_WORD}(?:[{_SPACES.replace(' ', '')}]{_WORD})*")


class Pair:
    """The two tokenizers, and the bytes and decimal forms of their ids."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        back = {c: b for b, c in enumerate(byte_letters())}
        vocab = json.loads(byte_level)["model"]["vocab"]
        table_a = [b""] * self.a.get_vocab_size()
        for token, i in vocab.items():
            table_a[i] = bytes([back[c] for c in token])
        table_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            table_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes_a, self.bytes_b = pa.array(table_a, pa.binary()), pa.array(table_b, pa.binary())
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t]) for t in (table_a, table_b))
        #: decimal ids, followed by nothing, a comma, a bar or a semicolon
        self.size = max(len(table_a), len(table_b))
        self.decimal = pa.array([f"{i}{mark}" for mark in ("", ",", "|", ";") for i in range(self.size)])

        # texts may be cut where a blank follows other than white space: the byte-level pattern starts a
        # pre-token there, and no piece holds the metaspace after another character (tried here; texts
        # are encoded whole for a model with such pieces, or one that normalises)
        whole = "".join([self.b.id_to_piece(i) for i in self.b.encode("  a   b  ")])
        self.cut = whole == "▁▁▁a▁▁▁b▁▁" and not any(
            "▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        self.blank = self.b.piece_to_id("▁")
        #: chunk (with the blank before it) -> its ids of both tokenizers, little-endian, 32 bits
        self.seen: dict[str, tuple[bytes, bytes]] = {}

    def _encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """ids of texts that begin with a blank"""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)                # it puts the blank there itself
        return a, [y if len(t) > 1 else [self.blank] for t, y in zip(texts, b)]

    def _learn(self, chunks: list[str]) -> None:
        """Many chunks to a text: their ids end where their bytes do. A chunk that ends in white space would
        join the next one's blank, and the metaspace loses bytes: those are encoded alone."""
        alone = [c for c in chunks if c[-1].isspace() or "▁" in c]
        chunks = [c for c in chunks if not c[-1].isspace() and "▁" not in c]
        for k in range(0, len(chunks), 4096):
            some = chunks[k:k + 4096]
            got = self._encode(["".join(some[j:j + 128]) for j in range(0, len(some), 128)])
            ends = np.cumsum([len(c.encode()) for c in some])
            cut = []
            for lists, sizes in zip(got, (self.sizes_a, self.sizes_b)):
                flat = np.fromiter(chain.from_iterable(lists), np.int64)
                at = np.cumsum(sizes[flat])
                places = np.searchsorted(at, ends)
                if at[-1] != ends[-1] or (at[places] != ends).any():
                    break
                data, places = flat.astype("<u4").tobytes(), ((places + 1) * 4).tolist()
                cut.append([data[x:y] for x, y in zip([0, *places], places)])
            if len(cut) == 2:
                self.seen.update(zip(some, zip(*cut)))
            else:
                alone += some
        for k in range(0, len(alone), 4096):
            some = alone[k:k + 4096]
            self.seen.update(zip(some, zip(*(list(map(_packed, x)) for x in self._encode(some)))))

    def _rows(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        try:
            return list(map(self.seen.__getitem__, chunks))
        except KeyError:
            need = set(chunks)
            new = [c for c in need if c not in self.seen]
            if len(self.seen) + len(new) > CACHE:
                self.seen = {c: self.seen[c] for c in need if c in self.seen}
            self._learn(new)
            return list(map(self.seen.__getitem__, chunks))

    def lists(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """The ids of both tokenizers; none for a text that one of them does not give back."""
        chunks = [CHUNK.findall(" " + t) if self.cut else [" " + t] for t in texts]
        ids: tuple[list, list] = ([], [])
        every = [c for x in chunks for c in x]
        for k in range(0, len(every), CACHE // 2):
            rows = self._rows(every[k:k + CACHE // 2])
            for out, side in zip(ids, (0, 1)):
                out += map(itemgetter(side), rows)
        of_text = np.concatenate([[0], np.cumsum([len(x) for x in chunks])])
        same = np.array([t != "" for t in texts])
        lists = []
        for got, table in zip(ids, (self.bytes_a, self.bytes_b)):
            ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, got), np.int64, len(got))) // 4])[of_text]
            flat = np.frombuffer(b"".join(got), "<u4").astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
            same &= [x == b" " + t.encode() for x, t in zip(_joined(lists[-1], table), texts)]
        if same.all():
            return tuple(lists)
        none = pa.scalar([], pa.list_(pa.int32()))
        return tuple(pc.if_else(pa.array(same), x, none) for x in lists)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _joined(lists: pa.ListArray, table: pa.Array) -> list[memoryview]:
    """The entries of every list one after another."""
    got = table.take(lists.flatten())
    _, at, data = got.buffers()
    at = np.frombuffer(at, np.int32, len(got) + 1) if len(got) else np.zeros(1, np.int32)
    cut = at[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
    view = memoryview(data).cast("B") if data is not None else memoryview(b"")
    return [view[x:y] for x, y in zip(cut, cut[1:])]


def _ends(lists: pa.ListArray, table: pa.Array) -> pa.Table:
    """doc, end, id, at of every token: the byte at which it ends in its document, and its place."""
    ids, doc = lists.flatten(), pc.list_parent_indices(lists)
    ends = pc.cumulative_sum(pc.binary_length(table).cast(pa.int64()).take(ids))
    first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    before = np.concatenate([[0], ends.to_numpy()])[first]          # bytes before each document
    ends = pc.subtract(ends, pa.array(before).take(doc.cast(pa.int64())))
    return pa.table({"doc": doc.cast(pa.int64()), "end": ends, "id": ids, "at": np.arange(len(ids))})


def align(pair: Pair, texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, list[str]]:
    """Per text n_a, n_b, n_groups and n_links; the links (a << 32 | b) of all texts in order; the groups."""
    lists = pair.lists(texts)
    a, b = (_ends(x, t) for x, t in zip(lists, (pair.bytes_a, pair.bytes_b)))
    links = a.join(b, keys=["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False)
    links = links.take(pc.sort_indices(links, sort_keys=[("at", "ascending"), ("at_b", "ascending")]))
    col = {k: links.column(k).to_numpy() for k in ("doc", "id", "id_b", "at", "at_b")}

    # a token that ends a group: the last one that ends at its place
    last = [np.zeros(len(t), bool) for t in (a, b)]
    for flags, at, t in zip(last, (col["at"], col["at_b"]), (a, b)):
        doc, end = t.column("doc").to_numpy(), t.column("end").to_numpy()
        flags[at] = True
        flags[:-1] &= (doc[1:] != doc[:-1]) | (end[1:] != end[:-1])
    group = [np.cumsum(f) - f for f in last]                        # groups before each token
    n_groups = int(last[0].sum())
    sizes = [np.bincount(g, minlength=n_groups) for g in group]
    # places of all tokens in the written order: a group's ids of A, then those of B
    ahead = [np.concatenate([[0], np.cumsum(s)]) for s in sizes]
    at_a = np.arange(len(a)) + ahead[1][group[0]]
    at_b = np.arange(len(b)) + ahead[0][group[1] + 1]
    kind = np.empty(len(a) + len(b), np.int64)
    ids = np.empty(len(a) + len(b), np.int64)
    ids[at_a], ids[at_b] = a.column("id").to_numpy(), b.column("id").to_numpy()
    kind[at_a] = np.where(last[0], 2, 1)
    last_of_doc = np.append(np.diff(b.column("doc").to_numpy()) != 0, True)[:len(b)]
    kind[at_b] = np.where(last[1], np.where(last_of_doc, 0, 3), 1)
    n = [x.value_lengths().to_numpy() for x in lists]
    cut = np.concatenate([[0], np.cumsum(n[0] + n[1])])
    written = pair.decimal.take(pa.array(kind * pair.size + ids))
    _, at, data = written.buffers()
    at = np.frombuffer(at, np.int32, len(written) + 1) if len(written) else np.zeros(1, np.int32)
    view = memoryview(data).cast("B") if data is not None else memoryview(b"")
    groups = [str(view[x:y], "ascii") for x, y in zip(at[cut[:-1]].tolist(), at[cut[1:]].tolist())]
    docs = len(texts)
    counts = {"n_a": n[0], "n_b": n[1], "n_links": np.bincount(col["doc"], minlength=docs),
              "n_groups": np.bincount(a.column("doc").to_numpy()[last[0]], minlength=docs)}
    return counts, (col["id"].astype(np.int64) << 32) | col["id_b"], groups


_LOADED: dict[bytes, Pair] = {}


def loaded(byte_level: bytes, pieces: bytes) -> Pair:
    key = hashlib.sha256(byte_level + pieces).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pair(byte_level, pieces)
    return _LOADED[key]


_PER_DOC = ("n_a", "n_b", "n_groups", "n_links")
CHUNKS = ("chunk bigint, doc_ids array<bigint>, " + ", ".join(f"{k} array<bigint>" for k in _PER_DOC)
          + ", groups_sha256 array<string>, pairs array<bigint>, pair_n array<bigint>, links binary")


def _files(spark, *paths: str):
    data = []
    for p in paths:
        with open(p, "rb") as f:
            data.append(f.read())
    return spark.sparkContext.broadcast(tuple(data))        # two vocabulary files, about 2 MB


def _calls(batches, text: str = "text"):
    """doc_ids and texts of bounded size."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column("doc_id"), batch.column(text)):
            t = t.as_py() or ""
            ids.append(d.as_py())
            texts.append(t)
            size += len(t) + 64
            if size >= CALL_BYTES:
                yield ids, texts, size
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, size


def aligned_chunks(docs: DataFrame, byte_level: str, pieces: str, text: str = "text") -> DataFrame:
    """The stored chunks (schema CHUNKS, bucketed by chunk): documents, their digests, and their links as
    places in the chunk's distinct pairs with the pairs' counts in the chunk."""
    files = _files(docs.sparkSession, byte_level, pieces)

    def run(batches):
        pair, chunk = loaded(*files.value), TaskContext.get().partitionId() << 32
        names, stats, links, digests, size = [], [], [], [], 0

        def row():
            coded = pa.array(np.concatenate(links)).dictionary_encode()
            n = pa.table({"at": coded.indices}).group_by("at").aggregate([([], "count_all")])
            n = n.take(pc.sort_indices(n, sort_keys=[("at", "ascending")])).column("count_all")
            cols = [[chunk], [names], *([np.concatenate([s[k] for s in stats])] for k in _PER_DOC), [digests],
                    [coded.dictionary.to_numpy()], [n.to_numpy()],
                    [planes(coded.indices.to_numpy().astype("<u4"))]]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                ["chunk", "doc_ids", *_PER_DOC, "groups_sha256", "pairs", "pair_n", "links"])

        for ids, texts, n in _calls(batches):
            counts, found, groups = align(pair, texts)
            names += ids
            stats.append(counts)
            links.append(found)
            digests += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            size += n
            if size >= CHUNK_BYTES:
                yield row()
                pa.default_memory_pool().release_unused()
                chunk, names, stats, links, digests, size = chunk + 1, [], [], [], [], 0
        if names:
            yield row()

    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).alias("n")).first().n
    return bucketed(map_arrow(docs.selectExpr("doc_id", f"`{text}` AS text"), run, CHUNKS), "aligned", table_buckets(size))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """a, b, n, best of every linked id pair: how many links hold it, and whether no pair with the
    same b has more (stored)."""
    part = chunks.select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("x")).select("x.*")
    total = stored(part.groupBy("pairs").agg(F.sum("pair_n").alias("n"))
                   .select("pairs", F.shiftright("pairs", 32).cast("int").alias("a"),
                           F.col("pairs").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n"), "pair-counts")
    top = total.groupBy("b").agg(F.max("n").alias("top"))
    return total.join(top, "b").select("pairs", "a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def _score(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            get = {c: batch.column(c)[k].values if pa.types.is_list(batch.column(c).type) else batch.column(c)[k]
                   for c in batch.schema.names}
            at, n, best = (get["counts"].field(f).to_numpy(zero_copy_only=False) if get["counts"] is not None
                           else np.zeros(0, np.int64) for f in ("at", "n", "best"))
            count, top = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            count[at], top[at] = n, best
            links = unplanes(get["links"].as_py(), "<u4")
            cut = np.concatenate([[0], np.cumsum(get["n_links"].to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(x[links])])[cut] for x in (top, count)]
            yield pa.RecordBatch.from_arrays(
                [get["doc_ids"].cast(pa.int64()), *(get[c] for c in _PER_DOC), *(pa.array(np.diff(x), pa.int64()) for x in sums),
                 get["groups_sha256"]],
                ["doc_id", *_PER_DOC, "n_best", "count_sum", "groups_sha256"])


def alignment_report(docs: DataFrame, byte_level: str, pieces: str, text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    chunks = aligned_chunks(docs, byte_level, pieces, text)
    own = chunks.select("chunk", F.posexplode("pairs").alias("at", "pairs"))
    back = (own.join(pair_counts(chunks).select("pairs", "n", "best"), "pairs").groupBy("chunk")
            .agg(F.collect_list(F.struct("at", "n", F.col("best").cast("bigint").alias("best"))).alias("counts")))
    each = chunks.select("chunk", "doc_ids", *_PER_DOC, "groups_sha256", "links").join(back.hint("merge"), "chunk", "left")
    return map_arrow(each.drop("chunk"), _score, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                     "n_best bigint, count_sum bigint, groups_sha256 string")
