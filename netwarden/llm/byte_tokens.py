"""Byte-level BPE by the tokenizers library over Arrow batches, with offsets.

A rank file (base64 token, rank) becomes a model of the library: every byte stands for
one printable character, a token is the string of its bytes' characters, and every way
to cut a token into two others is a merge, in the order of the ranks. The pattern cuts
texts before merging. The library gives the ids and, through its byte-to-character
mapping, the span of characters of every token; a token that holds only a part of a
character has that character's whole span. Decoding looks up the bytes of every id
(the byte table reversed) and joins them before they are read as UTF-8, so that a
character split over several tokens comes back whole.

The rank rule merges the leftmost pair of the lowest rank. The library ranks the
two cuts of one token apart, which can matter only where one token may be made at two
places of a pre-token by different cuts; then three bytes occur twice in it. Chunks in
which they do are encoded by the rank rule itself (`by_ranks`).

Texts are cut before runs of white space into chunks, which tokenize independently;
a Python worker keeps the chunks that it has seen in a dictionary of bounded size.

Defined cases: a null text counts as empty (no ids, no bytes); strings of special tokens
are plain text; texts of any length are encoded whole; equal rows give equal results; an
empty table gives an empty one; of other columns, also of such names as `ids`, only
doc_id and the text are read. Decoding: a null list counts as empty; bytes that are no
UTF-8 read as U+FFFD; an id outside the vocabulary is an error.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from netwarden.llm.bpe import byte_letters
from netwarden.llm.common import map_batches

#: White space of Unicode, which the patterns' \s means.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
#: Chunks kept by a Python worker.
CACHE = 300_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def by_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of one pre-token: the leftmost adjacent pair of the lowest rank is merged until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))      # parts by their first byte
    end.append(n)
    heap = []

    def offer(i):
        j = end[i] if i >= 0 else n
        if j < n and (rank := ranks.get(piece[i:end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    live = [True] * n
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if not live[i] or not live[j] or end[i] != j or end[j] != k:     # one of the parts has changed
            continue
        live[j], end[i] = False, k
        if k < n:
            before[k] = i
        offer(i)
        offer(before[i])
    return [ranks[piece[i:end[i]]] for i in range(n) if live[i]]


class Coder:
    def __init__(self, ranks_file: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers
        self.ranks = read_ranks(ranks_file)
        self.pattern = regex.compile(pattern)
        letters = byte_letters()
        name = {t: "".join([letters[b] for b in t]) for t in self.ranks}
        merges = [(name[t[:k]], name[t[k:]]) for t in sorted(self.ranks, key=self.ranks.get)
                  for k in range(1, len(t)) if t[:k] in name and t[k:] in name]
        self.lib = Tokenizer(models.BPE({name[t]: r for t, r in self.ranks.items()}, merges, ignore_merges=True))
        self.lib.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(letters)}
        size = max(self.ranks.values()) + 1
        names = [self.lib.id_to_token(i) for i in range(size)]
        #: id -> its bytes
        self.bytes_of = pa.array([None if t is None else bytes([back[c] for c in t]) for t in names], pa.binary())
        #: chunk -> ids (little-endian, 32 bits)
        self.seen: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        plain = []
        for c in chunks:
            if c.isascii() and len(set(c)) == len(c):
                plain.append(c)
                continue
            b = c.encode()
            if len({b[k:k + 3] for k in range(len(b) - 2)}) < len(b) - 2:
                ids = [i for piece in self.pattern.findall(c) for i in by_ranks(piece.encode(), self.ranks)]
                self.seen[c] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                plain.append(c)
        for k in range(0, len(plain), 4096):
            some = plain[k:k + 4096]
            for c, e in zip(some, self.lib.encode_batch_fast(some, add_special_tokens=False)):
                ids = e.ids                      # without offsets, see encode_spans
                self.seen[c] = struct.pack(f"<{len(ids)}I", *ids)

    def spans(self, data: bytes, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The span of characters of every token of a UTF-8 string."""
        char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.bytes_of[i].as_py()) for i in ids]).astype(np.int64)
        return char[np.concatenate([[0], ends[:-1]]).astype(np.int64)], char[ends - 1] + 1

    def _rows(self, chunks: list[str]) -> list[bytes]:
        try:
            return list(map(self.seen.__getitem__, chunks))
        except KeyError:
            need = set(chunks)
            new = [c for c in need if c not in self.seen]
            if len(self.seen) + len(new) > CACHE:
                self.seen = {c: self.seen[c] for c in need if c in self.seen}
            self._learn(new)
            return list(map(self.seen.__getitem__, chunks))

    def prepare(self, texts: list[str]) -> None:
        """Learn the new chunks of a batch together, as long as they fit the dictionary."""
        need: set[str] = set()
        for t in texts:
            need.update(CHUNK.findall(t))
            if len(need) > CACHE // 2:
                return
        self._rows(list(need))

    def encode(self, text: str) -> bytes:
        """ids of the text as little-endian unsigned 32-bit integers"""
        chunks = CHUNK.findall(text)
        return b"".join([row for k in range(0, len(chunks), CACHE // 2)
                         for row in self._rows(chunks[k:k + CACHE // 2])])

    def encode_spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the first character and the one after the last of every token (the library's
        offsets; counted from the tokens' bytes where the rank rule gave other ids)"""
        ids = np.frombuffer(self.encode(text), "<u4")
        e = self.lib.encode(text, add_special_tokens=False)
        if e.ids == ids.tolist():
            at = np.array(e.offsets, np.int64).reshape(-1, 2)
            return ids, at[:, 0], at[:, 1]
        return ids, *self.spans(text.encode(), ids.tolist())

    def decode(self, ids: list[np.ndarray]) -> list[memoryview]:
        """The bytes of every list of ids."""
        lens = np.array([len(x) for x in ids], np.int64)
        got = self.bytes_of.take(pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]), pa.uint32()))
        if got.null_count:
            raise ValueError("an id outside the vocabulary")
        _, offsets, data = got.buffers()
        at = np.frombuffer(offsets, np.int32, len(got) + 1, got.offset * 4) if len(got) else np.zeros(1, np.int32)
        cut = at[np.concatenate([[0], np.cumsum(lens)])].tolist()
        view = memoryview(data).cast("B") if data is not None else memoryview(b"")
        return [view[a:b] for a, b in zip(cut, cut[1:])]


_LOADED: dict[bytes, Coder] = {}


def loaded(ranks_file: bytes, pattern: str) -> Coder:
    """One model per Python worker, file and pattern."""
    key = hashlib.sha256(ranks_file + pattern.encode()).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Coder(ranks_file, pattern)
    return _LOADED[key]


def _vocabulary(df: DataFrame, ranks: str):
    with open(ranks, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())      # the vocabulary file, under 1 MB


def encode_documents(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, ids, starts, ends: the ids of each whole text and the characters that each id spans."""
    file = _vocabulary(docs, ranks)

    def run(t: pa.Table) -> pa.Table:
        coder = loaded(file.value, pattern)
        texts = [x or "" for x in t.column("text").to_pylist()]
        coder.prepare(texts)
        cols = list(zip(*(coder.encode_spans(x) for x in texts)))
        return pa.table({"doc_id": t.column("doc_id"), **{
            k: pa.array([x.astype(np.int32) for x in c], pa.list_(pa.int32()))
            for k, c in zip(("ids", "starts", "ends"), cols)}})

    return map_batches(docs.selectExpr("doc_id", f"`{text}` AS text"), run, max_bytes=4 << 20,
                       schema="doc_id bigint, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, data, text: the bytes that the ids stand for, and those bytes read as UTF-8."""
    file = _vocabulary(tokens, ranks)

    def run(t: pa.Table) -> pa.Table:
        got = loaded(file.value, pattern).decode(
            [np.array(x or [], np.uint32) for x in t.column("ids").to_pylist()])
        return pa.table({"doc_id": t.column("doc_id"), "data": pa.array(map(bytes, got), pa.binary()),
                         "text": [str(x, "utf-8", "replace") for x in got]})

    return map_batches(tokens.select("doc_id", "ids"), run, "doc_id bigint, data binary, text string", max_bytes=4 << 20)


def token_digests(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (32 bits each) and of the bytes that they decode to."""
    file = _vocabulary(docs, ranks)

    def run(t: pa.Table) -> pa.Table:
        coder = loaded(file.value, pattern)
        texts = [x or "" for x in t.column("text").to_pylist()]
        coder.prepare(texts)
        ids = [coder.encode(x) for x in texts]
        back = coder.decode([np.frombuffer(x, "<u4") for x in ids])
        return pa.table({"doc_id": t.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                         "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                         "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back]})

    return map_batches(docs.selectExpr("doc_id", f"`{text}` AS text"), run, max_bytes=4 << 20,
                       schema="doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
