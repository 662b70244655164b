"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared as letters and digits (lower case, ASCII punctuation and
white space removed, UTF-8 bytes). An occurrence of an item of m bytes with at most e
edits shares at least m + 1 - q - q e of its q-grams with the text, on diagonals that lie
within 2 e + 1 of each other; so shared q-grams are counted in overlapping diagonal bands
(width 4 e + 2, half overlapping), the bands that reach the bound are kept, and each is
verified by a banded alignment of the whole item. Short items for which that bound is
below 1 are looked for by e + 1 pieces, one of which e edits leave whole, and verified
alike.

The benchmark is the query set: it is broadcast in blocks of a bounded number of bytes,
and every text meets every block.

Defined cases: null or empty texts hold no leak; null or blank items, and items without
letters or digits, are never found; items shorter than q are found exactly; repeated rows
give repeated results; empty tables give an empty result; an item found several times in
a text counts once, with its fewest edits.
"""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import map_batches

Q = 8
#: Edits allowed, as a share of the item's normalised length.
MAX_EDITS = 0.1
#: Normalised benchmark bytes of one broadcast block.
BLOCK_BYTES = 16 << 20
_BITS = 22
_MULT = np.uint64(0x9E3779B97F4A7C15)
_DROP = bytes(b for b in range(128) if not chr(b).isalnum())


def normal(text: str) -> bytes:
    return text.lower().encode().translate(None, _DROP)


def codes(data: np.ndarray) -> np.ndarray:
    """The q-gram that starts at each byte, as an integer."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - Q + 1,), "<u8", data.tobytes(), 0, (1,))


def aligned(item: np.ndarray, text: np.ndarray, first: int, width: int, most: int) -> int:
    """Fewest edits of the item against a piece of the text that starts on one of the
    diagonals first .. first + width; most + 1 if above ``most``."""
    m, n = len(item), len(text)
    far = most + 1
    low, high = first - most, first + width + most          # diagonals in the band
    j = np.arange(low, high + 1)                            # text position at row 0
    step = np.arange(len(j))
    row = np.where((j >= 0) & (j <= n), 0, far)             # the item may start anywhere in the band
    padded = np.full(n + 1, 256, np.int16)
    padded[:n] = text
    for i in range(1, m + 1):
        at = j + i                                          # text characters used on each diagonal
        ok = (at >= 1) & (at <= n)
        sub = row + (padded[np.where(ok, at - 1, n)] != item[i - 1])
        up = np.append(row[1:], far) + 1                    # an item character without partner
        new = np.minimum(np.where(ok, sub, far), up)
        new = np.where((at >= 0) & (at <= n), new, far)
        new = np.minimum.accumulate(new - step) + step      # text characters without partner
        row = np.minimum(new, far)
        if row.min() > most:
            return far
    return int(row.min())


class Items:
    """A block of benchmark items, indexed by q-gram."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.bytes, self.edits = [], [], []
        self.short: list[int] = []
        for i, text in rows:
            b = normal(text or "")
            if b:
                if len(b) < Q:
                    self.short.append(len(self.ids))
                self.ids.append(i)
                self.bytes.append(b)
                self.edits.append(int(len(b) * MAX_EDITS))
        grams, item, pos = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, b in enumerate(self.bytes):
            c = codes(np.frombuffer(b, np.uint8))
            grams.append(c)
            item.append(np.full(len(c), k))
            pos.append(np.arange(len(c)))
        g = np.concatenate(grams)
        order = np.argsort(g, kind="stable")
        g, self.item, self.pos = g[order], np.concatenate(item)[order], np.concatenate(pos)[order]
        self.grams, self.start = np.unique(g, return_index=True)
        self.stop = np.append(self.start[1:], len(g))
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[self._slot(self.grams)] = True
        e = np.array(self.edits, np.int64)
        self.width = 2 * e + 1                               # bands of 2 widths, each starting a width later
        self.least = np.maximum(1, np.array([len(b) for b in self.bytes], np.int64) + 1 - Q - Q * e)
        # e edits leave one of e + 1 pieces whole: the filter of items whose bound is below 1
        self.pieces: list[tuple[int, int, bytes]] = []
        for k, b in enumerate(self.bytes):
            n = self.edits[k] + 1
            if len(b) >= Q and len(b) + 1 - Q * n < 1:
                cuts = [len(b) * x // n for x in range(n + 1)]
                self.pieces += [(k, lo, b[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]

    @staticmethod
    def _slot(c: np.ndarray) -> np.ndarray:
        return (c * _MULT) >> np.uint64(64 - _BITS)

    def hits(self, data: bytes) -> np.ndarray:
        """Positions of q-grams that some item has."""
        c = codes(np.frombuffer(data, np.uint8))
        out = []
        for k in range(0, len(c), 1 << 16):                  # pieces that stay in the processor's cache
            got = np.flatnonzero(self.filter[self._slot(c[k:k + (1 << 16)])])
            if len(got):
                out.append(got + k)
        if not out:
            return np.zeros(0, np.int64)
        at = np.concatenate(out)
        k = np.minimum(np.searchsorted(self.grams, c[at]), len(self.grams) - 1)
        return at[self.grams[k] == c[at]]

    def find(self, data: bytes) -> list[tuple[int, int]]:
        """(item, edits) of every item that the normalised text holds."""
        found = {k: 0 for k in self.short if self.bytes[k] in data}
        at = self.hits(data) if len(self.grams) else np.zeros(0, np.int64)
        if len(at):
            c = codes(np.frombuffer(data, np.uint8))[at]
            g = np.searchsorted(self.grams, c)
            many = self.stop[g] - self.start[g]
            ends = np.cumsum(many)
            post = np.repeat(self.start[g] - (ends - many), many) + np.arange(ends[-1])
            item = self.item[post]
            diag = np.repeat(at, many) - self.pos[post]
            lowest = -1 - int(self.width.max()) * 4 - max(map(len, self.bytes))
            band = (diag - lowest) // self.width[item]
            span = int(band.max()) + 2
            keys, count = np.unique(np.concatenate([item * span + band, item * span + band - 1]), return_counts=True)
            good = keys[count >= self.least[keys // span]]
            text = None
            for key in good.tolist():
                k, b = divmod(key, span)
                if found.get(k) == 0:
                    continue
                first, width = b * int(self.width[k]) + lowest, 2 * int(self.width[k])
                m, most = len(self.bytes[k]), self.edits[k]
                lo, hi = max(0, first - most), min(len(data), first + width + m + most)
                if self.bytes[k] in data[lo:hi]:
                    found[k] = 0
                    continue
                if text is None:
                    text = np.frombuffer(data, np.uint8)
                edits = aligned(np.frombuffer(self.bytes[k], np.uint8), text[lo:hi], first - lo, width, most)
                if edits <= most:
                    found[k] = min(edits, found.get(k, edits))
        for k, offset, piece in self.pieces:
            m, most, at = len(self.bytes[k]), self.edits[k], data.find(piece)
            while at >= 0 and found.get(k) != 0:
                first = at - offset - most
                lo, hi = max(0, first - most), min(len(data), first + 3 * most + m)
                edits = aligned(np.frombuffer(self.bytes[k], np.uint8), np.frombuffer(data[lo:hi], np.uint8),
                                first - lo, 2 * most, most)
                if edits <= most:
                    found[k] = min(edits, found.get(k, edits))
                at = data.find(piece, at + 1)
        return sorted(found.items())


def _blocks(benchmark: DataFrame, item: str, text: str) -> list:
    """The benchmark in broadcast blocks of bounded size."""
    items = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").alias("t")).filter("t IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    n = -(-size // BLOCK_BYTES) or 1
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast([(r.i, r.t) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()])
            for k in range(n)]


_INDEX: dict[str, Items] = {}


def _index(bc) -> Items:
    if bc.id not in _INDEX:
        _INDEX.clear()
        _INDEX[bc.id] = Items(bc.value)
    return _INDEX[bc.id]


class _Ref:
    """A broadcast block and the name under which workers keep its index: made afresh for every
    block, as workers outlive the handles."""

    def __init__(self, bc):
        self.bc, self.id = bc, uuid.uuid4().hex

    @property
    def value(self):
        return self.bc.value


def find_leaks(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_edits: a row for each document and item that it holds."""
    out = None
    for bc in _blocks(benchmark, item, "text"):
        def run(t: pa.Table, ref=_Ref(bc)) -> pa.Table:
            index, d, i, e = _index(ref), [], [], []
            for doc, x in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()):
                for k, edits in index.find(normal(x or "")):
                    d.append(doc)
                    i.append(index.ids[k])
                    e.append(edits)
            return pa.table({"doc_id": pa.array(d, pa.int64()), "item_id": pa.array(i, pa.int64()),
                             "n_edits": pa.array(e, pa.int64())})

        part = map_batches(docs.selectExpr("doc_id", f"`{text}` AS text"), run,
                           "doc_id bigint, item_id bigint, n_edits bigint")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    for bc in _blocks(benchmark, item, "text"):
        def run(t: pa.Table, ref=_Ref(bc)) -> pa.Table:
            index = _index(ref)
            return t.filter(pa.array([not index.find(normal(x or "")) for x in t.column(text).to_pylist()], pa.bool_()))

        docs = map_batches(docs, run, docs.schema)
    return docs
