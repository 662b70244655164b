"""Byte-level BPE encoding and decoding.

Each pre-token is merged with a segment tree over the ranks of adjacent pairs: the
root yields the leftmost lowest-rank merge, a merge changes two leaves and clears
one (logarithmic point updates), until no mergeable pair is left.

Texts are cut at blanks into chunks that tokenize independently of one another;
chunks and pre-tokens already seen by a Python worker are looked up in dictionaries
of bounded size (cleared when full, so that memory does not grow with the corpus).

Defined cases: a null text counts as empty (no ids, empty decoded text); special
tokens in a text become their ids as in the library; texts of any length are encoded
whole; repeated rows give repeated results.
"""
from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from netwarden.llm.common import map_batches

#: How the byte-level family cuts text before merging (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CHUNK = regex.compile(r"\s*\S+|\s+")
#: Entries of each dictionary, words merged in one matrix, and length of a text prepared alone.
CACHE, _ROWS, _LONG = 500_000, 20_000, 1 << 20
_NONE = 1 << 40


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in the vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Bpe:
    def __init__(self, spec: bytes):
        j = json.loads(spec)
        letters = byte_letters()
        vocab = j["model"]["vocab"]
        self.byte_id = [vocab[c] for c in letters]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(j["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        keys = np.array([(a << 32) | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_rank, self.pair_new = np.array(list(self.pairs.values()), np.int64)[order].T.copy()
        self.byte_ids = np.array(self.byte_id, np.int64)
        back = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *(t["id"] for t in j["added_tokens"])]) + 1
        self.token_bytes = [b""] * size
        for t, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in t)
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) \
            if self.special else None
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        n = len(ids)
        if n < 2:
            return ids
        pairs, size = self.pairs, 1
        while size < n:
            size *= 2
        none = 1 << 62
        tree = [none] * (2 * size)       # leaf i: rank of the pair that starts at i, then i
        made = [0] * n                   # what that pair becomes
        for i in range(n - 1):
            p = pairs.get((ids[i], ids[i + 1]))
            if p:
                tree[size + i] = p[0] * size + i
                made[i] = p[1]
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids = list(ids)

        def put(i, value):
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        def pair(i):
            j = after[i]
            p = pairs.get((ids[i], ids[j])) if j < n else None
            if p:
                made[i] = p[1]
                put(i, p[0] * size + i)
            elif tree[size + i] != none:
                put(i, none)

        while tree[1] != none:
            i = tree[1] % size
            j = after[i]
            ids[i] = made[i]
            if tree[size + j] != none:
                put(j, none)
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            pair(i)
            if before[i] >= 0:
                pair(before[i])
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _merge_many(self, words: list[bytes], size: int) -> list[bytes]:
        """The same merging for many short words at once: one row of a matrix is the
        segment tree of one word (``size`` leaves, a power of two above the longest)."""
        n = np.array([len(w) for w in words])
        rows = len(words)
        col = np.arange(size)
        inside = col < n[:, None]
        ids = np.full((rows, size), -1, np.int64)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((rows, 2 * size), _NONE, np.int64)
        made = np.zeros((rows, size), np.int64)
        rank, new = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        leaf = np.where(rank.reshape(rows, -1) < _NONE, rank.reshape(rows, -1) * size + col[:-1], _NONE)
        tree[:, size:2 * size - 1] = leaf
        made[:, :-1] = new.reshape(rows, -1)
        k = size // 2
        while k:
            tree[:, k:2 * k] = np.minimum(tree[:, 2 * k:4 * k:2], tree[:, 2 * k + 1:4 * k:2])
            k //= 2
        after = np.minimum(col + 1, n[:, None])
        before = np.broadcast_to(col - 1, (rows, size)).copy()
        tree, ids, made, after, before = tree.ravel(), ids.ravel(), made.ravel(), after.ravel(), before.ravel()
        wide = 2 * size

        def put(row, at, value):
            base, k = row * wide, size + at
            tree[base + k] = value
            k >>= 1
            while k[0]:                  # all leaves are equally deep
                tree[base + k] = np.minimum(tree[base + 2 * k], tree[base + 2 * k + 1])
                k >>= 1

        live = np.arange(rows)
        while True:
            root = tree[live * wide + 1]
            live, root = live[root < _NONE], root[root < _NONE]
            if not len(live):
                break
            base, i = live * size, root % size
            j = after[base + i]
            ids[base + i] = made[base + i]
            ids[base + j] = -1
            k = after[base + j]
            after[base + i] = k
            has = k < n[live]
            before[(base + k)[has]] = i[has]
            put(live, j, _NONE)
            for left, right, ok in ((i, k, has), (before[base + i], i, before[base + i] >= 0)):
                row, left, right = live[ok], left[ok], right[ok]
                if len(row):
                    b = row * size
                    rank, new = self._ranks(ids[b + left], ids[b + right])
                    made[b + left] = new
                    put(row, left, np.where(rank < _NONE, rank * size + left, _NONE))
            gone = ~has
            if gone.any():
                put(live[gone], i[gone], _NONE)
        kept = ids.reshape(rows, size) >= 0
        flat = ids.reshape(rows, size)[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rank (or _NONE) and merged id of each pair of ids"""
        key = (a << 32) | (b & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self.pair_rank[at], _NONE), self.pair_new[at]

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks not yet seen, all their words in a few matrix passes."""
        cut = {c: PATTERN.findall(c) for c in chunks}
        used = {w for ws in cut.values() for w in ws}
        words = used.difference(self.words)
        if len(self.words) + len(words) > CACHE:
            old = self.words
            self.words = {w: old[w] for w in used if w in old}
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(max(4, 1 << (len(w.encode()) - 1).bit_length()), []).append(w)
        for size, ws in by_size.items():
            if size > 64:
                for w in ws:
                    ids = self.merge([self.byte_id[b] for b in w.encode()])
                    self.words[w] = struct.pack(f"<{len(ids)}I", *ids)
                continue
            for k in range(0, len(ws), _ROWS):
                part = ws[k:k + _ROWS]
                self.words.update(zip(part, self._merge_many([w.encode() for w in part], size)))
        word = self.words.__getitem__
        for c, ws in cut.items():
            self.chunks[c] = b"".join(map(word, ws))

    def _parts(self, text: str) -> list[str]:
        if "  " in text or text[-1:] == " ":          # a run of blanks: cut at whole runs
            return CHUNK.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def _plain(self, text: str) -> bytes:
        out, parts = [], self._parts(text)
        for k in range(0, len(parts), CACHE // 2):    # one very long text stays within the dictionary too
            some = parts[k:k + CACHE // 2]
            try:
                out.append(b"".join(map(self.chunks.__getitem__, some)))
            except KeyError:
                self._need(set(some))
                out.append(b"".join(map(self.chunks.__getitem__, some)))
        return b"".join(out)

    def _need(self, chunks: set[str]) -> None:
        """Have all these chunks in the dictionary; when it is full, keep only what they use."""
        new = chunks.difference(self.chunks)
        if len(self.chunks) + len(new) > CACHE:
            old = self.chunks
            self.chunks = {c: old[c] for c in chunks if c in old}
        if new:
            self.learn(new)

    def prepare(self, texts: list[str]) -> None:
        """Learn the new chunks of a batch of texts together (texts with special tokens apart)."""
        need: set[str] = set()
        for t in texts:
            if len(t) < _LONG and not (self.special_re and self.special_re.search(t)):
                need.update(self._parts(t))
                if len(need) > CACHE // 2:
                    break
        self._need(need)

    def encode(self, text: str) -> bytes:
        """ids of the text as little-endian unsigned 32-bit integers"""
        if self.special_re is None or not self.special_re.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [self._plain(text[at:m.start()]), struct.pack("<I", self.special[m.group(0)])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        table = self.token_bytes
        return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[bytes, Bpe] = {}


def loaded(spec: bytes) -> Bpe:
    """One model per Python worker and vocabulary file."""
    key = hashlib.sha256(spec).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(spec)
    return _LOADED[key]


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded: the ids as an array and the
    text that they decode to. Columns that a query does not select cost no output."""
    return _coded(docs, tokenizer, text, True)


def encode_digest(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text."""
    return _coded(docs, tokenizer, text, False)


def _coded(docs: DataFrame, tokenizer: str, text: str, full: bool) -> DataFrame:
    with open(tokenizer, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())      # the vocabulary file, about 1.5 MB

    def run(t: pa.Table) -> pa.Table:
        bpe = loaded(spec.value)
        n, a, b, ids, dec = [], [], [], [], []
        texts = [x or "" for x in t.column("text").to_pylist()]
        bpe.prepare(texts)
        for x in texts:
            got = bpe.encode(x)
            back = bpe.decode(got)
            n.append(len(got) // 4)
            a.append(hashlib.sha256(got).hexdigest())
            b.append(hashlib.sha256(back.encode()).hexdigest())
            if full:
                ids.append(np.frombuffer(got, "<u4").astype(np.int32))
                dec.append(back)
        cols = {"doc_id": t.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": a, "decoded_sha256": b}
        if full:
            cols |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": dec}
        return pa.table(cols)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.selectExpr("doc_id", f"`{text}` AS text"), run, max_bytes=4 << 20, schema=
                       schema + (", ids array<int>, decoded string" if full else ""))
