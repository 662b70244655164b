"""Removal of repeated 200-byte strings by sorting suffixes.

1. Equal texts become one text with its number of rows; the distinct texts are stored in
   chunks. A text of several rows is repeated as a whole.
2. Every 200-byte window has an anchor: the leftmost of its 64-byte grams with the least
   hash. Equal windows have equal anchors at the same place, so only suffixes at anchors
   whose gram occurs twice or more in the corpus are candidates. (The gram counts are
   gathered in packed arrays, once per chunk.)
3. Sampled splitters range-partition the candidate suffixes by their leading bytes. A
   suffix carries the bytes of all windows with its anchor (up to 336).
4. A bucket sorts the windows of its suffixes by multikey quicksort, eight bytes a digit:
   first the anchor's gram and place, then the outermost digits, then the rest; groups of
   one are dropped as soon as they arise and only groups that still differ are sorted on.
   Windows left in a group of two or more are repeats.
5. A gram with very many suffixes is dealt over several buckets. Each of them sends its
   distinct windows on, and equal windows are found across these boundaries by a second
   aggregation (on a 128-bit hash).
6. The repeated windows of each text are cut out; results go back to the rows by the text's
   128-bit digest.

Matches never cross texts. Defined cases: a null text counts as empty; texts under 200 bytes
lose nothing; repeated rows are copies of each other and lose everything from 200 bytes on;
an empty table gives an empty result; text length is not limited.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import finished, map_arrow, stored
from netwarden.llm.packed import bucketed, counts_of, packed_rows, rows_of, table_buckets, with_counts

WINDOW, GRAM = 200, 64
#: Bytes of text of one chunk (or one longer text), window starts handled at once.
CHUNK_BYTES, TILE = 4 << 20, 1 << 19
#: Suffix bytes of one bucket; suffixes of one gram in one bucket; chunks and suffixes sampled for the splitters.
BUCKET_BYTES, HOT, SAMPLE_CHUNKS, SAMPLE_EACH = 12 << 20, 4096, 24, 4096
_M = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BYTE = np.array([(_M * (b + 1) ^ (b * 0xC2B2AE3D27D4EB4F)) & _MASK for b in range(256)], np.uint64)

TEXTS = "chunk bigint, names array<binary>, copies array<bigint>, lens array<int>, data binary"


# --- anchors ----------------------------------------------------------------------
def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 64 bytes at each position, by doubling."""
    h, k, power = _BYTE[data], 1, _M
    while k < GRAM:
        h = h[:-k] * np.uint64(power) + h[k:]
        power, k = power * power & _MASK, 2 * k
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(v)
    pad = -n % width
    rows = np.append(v, np.full(pad, _MASK, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(data: bytes, lens: np.ndarray):
    """gram hash, anchor, first and last window start of each run of windows with the same anchor
    (positions in ``data``; windows lie within one text)."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.cumsum(lens)
    valid = np.zeros(len(raw) + 1, np.int32)
    long = lens >= WINDOW
    valid[(ends - lens)[long]] += 1
    valid[ends[long] - WINDOW + 1] -= 1
    valid = np.cumsum(valid) > 0
    out = []
    width = WINDOW - GRAM + 1
    low = np.uint64(TILE + WINDOW).item().bit_length()
    for t in range(0, len(raw) - WINDOW + 1, TILE):
        ok = valid[t:t + TILE][:len(raw) - WINDOW + 1 - t]
        if not ok.any():
            continue
        h = gram_hashes(raw[t:t + TILE + WINDOW - 1])
        v = (h >> np.uint64(low) << np.uint64(low)) | np.arange(len(h), dtype=np.uint64)
        at = (_least(v, width) & np.uint64((1 << low) - 1)).astype(np.int64)
        edge = np.flatnonzero((at[1:] != at[:-1]) | (ok[1:] != ok[:-1])) + 1
        first = np.append(0, edge)
        last = np.append(edge - 1, len(at) - 1)
        keep = ok[first]
        first, last = first[keep], last[keep]
        p = at[first]
        out.append((h[p], p + t, first + t, last + t))
    if not out:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*out))


# --- chunks -------------------------------------------------------------------------
def _pack(batches):
    at = TaskContext.get().partitionId() << 32
    names, copies, texts, n = [], [], [], 0

    def row():
        cols = [[at], [names], [copies], [[len(x) for x in texts]], [b"".join(texts)]]
        kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          ["chunk", "names", "copies", "lens", "data"])

    for b in batches:
        for name, k, x in zip(*(b.column(c) for c in ("name", "copies", "text"))):
            names.append(name.as_py())
            copies.append(k.as_py())
            texts.append(x.as_py().encode())
            n += len(texts[-1])
            if n >= CHUNK_BYTES:
                yield row()
                at, names, copies, texts, n = at + 1, [], [], [], 0
    if names:
        yield row()


def _emit(bits: int):
    def run(batches):
        for row in rows_of(batches):
            h, *_ = anchors(row["data"], np.array(row["lens"], np.int64))
            keys, n = np.unique(h, return_counts=True)
            yield packed_rows(row["chunk"], [(1, keys, n)], bits)
    return run


def _candidates(row):
    """Anchors whose gram occurs twice or more in the corpus, with its count."""
    h, p, first, last = anchors(row["data"], np.array(row["lens"], np.int64))
    keys, at = np.unique(h, return_inverse=True)
    n = counts_of(row, 1)
    if len(n) != len(keys):
        raise ValueError("counts do not belong to this chunk")
    n = n[at].astype(np.int64)
    use = n > 1
    return h[use], p[use], first[use], last[use], n[use]


def _leads(data: bytes, p: np.ndarray) -> np.ndarray:
    """The eight bytes at each anchor as a number that sorts like them."""
    return np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))[p].astype(np.uint64)


def _sample(batches):
    for row in rows_of(batches):
        _, p, first, last, _ = _candidates(row)
        size = int((last - first + WINDOW).sum())
        step = max(1, len(p) // SAMPLE_EACH)
        yield pa.RecordBatch.from_arrays(
            [pa.array([size]), pa.array([_leads(row["data"], p[::step]).tobytes() if len(p) else b""], pa.binary())],
            ["bytes", "leads"])


SUFFIXES = "bucket bigint, gram bigint, salt int, chunk bigint, doc int, start int, place int, bytes binary"


def _suffixes(splitters: np.ndarray):
    def run(batches):
        for row in rows_of(batches):
            data, lens = row["data"], np.array(row["lens"], np.int64)
            h, p, first, last, n = _candidates(row)
            if not len(p):
                continue
            begin = np.cumsum(lens) - lens
            doc = np.searchsorted(begin, first, side="right") - 1
            while True:                    # an empty text before has the same begin
                wrong = first >= begin[doc] + lens[doc]
                if not wrong.any():
                    break
                doc[wrong] += 1
            bucket = np.searchsorted(splitters, _leads(data, p), side="right")
            parts = -(-n // HOT)
            salt = np.where(parts > 1, ((p * 40503 + row["chunk"] % 65521 * 7919) & 0x7FFFFFFF) % parts, -1)
            gram = np.where(parts > 1, h.view(np.int64), 0)
            for k in range(0, len(p), 8192):
                s = slice(k, k + 8192)
                some = [data[a:b + WINDOW] for a, b in zip(first[s].tolist(), last[s].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[s], pa.int64()), pa.array(gram[s]), pa.array(salt[s], pa.int32()),
                     pa.array([row["chunk"]] * len(some), pa.int64()), pa.array(doc[s], pa.int32()),
                     pa.array(first[s] - begin[doc[s]], pa.int32()), pa.array(p[s] - first[s], pa.int32()),
                     pa.array(some, pa.binary())],
                    ["bucket", "gram", "salt", "chunk", "doc", "start", "place", "bytes"])
    return run


# --- one bucket -----------------------------------------------------------------------
def repeated(classes: list[tuple[bytes, int]]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Windows of the classes (bytes, place of the anchor) that equal a window of another class:
    the first window of each class, whether each window is repeated, and its group (-1: none)."""
    data = b"".join(c for c, _ in classes) + bytes(8)
    sizes = np.array([len(c) for c, _ in classes], np.int64)
    place = np.array([k for _, k in classes], np.int64)
    windows = sizes - WINDOW + 1
    begin = np.cumsum(sizes) - sizes
    base = np.cumsum(windows) - windows
    total = int(windows.sum())
    cls = np.repeat(np.arange(len(classes)), windows)
    j = np.arange(total) - base[cls]
    pos = begin[cls] + j
    digit = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    depth = place[cls] - j                                  # of the anchor in the window
    # the gram is part of every window with it: its eight digits and the depth come first
    gram = begin + place
    _, name = np.unique(np.stack([digit[gram + 8 * k] for k in range(GRAM // 8)], 1), axis=0, return_inverse=True)
    group = name.ravel()[cls] * WINDOW + depth
    live = np.arange(total)

    def settle(live, group, key):
        """Sort by (group, key), number the groups anew, drop groups of one."""
        order = np.lexsort((key, group))
        live, group, key = live[order], group[order], key[order]
        new = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
        ids = np.cumsum(new) - 1
        many = np.bincount(ids)[ids] > 1
        return live[many], ids[many]

    live, group = settle(live, group, digit[pos])
    digits = [WINDOW - 8, *[8 * k for k in range(1, WINDOW // 8 - 1)]]
    for d in digits:
        if not len(live):
            break
        key = digit[pos[live] + d]
        same = np.append(False, group[1:] == group[:-1])
        differs = same & np.append(False, key[1:] != key[:-1])
        if not differs.any():
            continue
        mixed = np.zeros(int(group.max()) + 1, bool)
        mixed[group[differs]] = True
        go = mixed[group]
        high = int(group.max()) + 1
        a, g = settle(live[go], group[go], key[go])
        live, group = np.concatenate([live[~go], a]), np.concatenate([group[~go], g + high])
        order = np.argsort(group, kind="stable")
        live, group = live[order], group[order]
    flag = np.zeros(total, bool)
    flag[live] = True
    where = np.full(total, -1)
    where[live] = group
    return base.tolist(), flag, where


FOUND = "chunk bigint, doc int, start int, stop int, window binary, seen int"


def _sort_bucket(t: pa.Table) -> pa.Table:
    hot = t.column("salt")[0].as_py() >= 0
    chunk, doc, start = (t.column(c).to_numpy() for c in ("chunk", "doc", "start"))
    members: dict[tuple[bytes, int], list[int]] = {}
    for i, c in enumerate(zip(t.column("bytes").to_pylist(), t.column("place").to_pylist())):
        members.setdefault(c, []).append(i)
    classes = list(members)
    base, flag, group = repeated(classes)
    rows, lo, hi, refs, names, seen = [], [], [], [], [], []
    sent: set[int] = set()
    for c, b in zip(classes, base):
        n, own = len(c[0]) - WINDOW + 1, members[c]
        f = np.ones(n, bool) if len(own) > 1 else flag[b:b + n]
        if hot:
            for k in range(n):                             # one row for each distinct window
                g = int(group[b + k])
                if f[k] and g >= 0 and g in sent:
                    continue
                if g >= 0:
                    sent.add(g)
                refs.append((own[0], k))
                names.append(xxhash.xxh3_128_digest(c[0][k:k + WINDOW]))
                seen.append(2 if f[k] else 1)
        if f.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], f.view(np.int8), [0]])))
            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                rows += own
                lo += [x] * len(own)
                hi += [y - 1 + WINDOW] * len(own)
    rows, ref = np.array(rows, np.int64), np.array([r for r, _ in refs], np.int64)
    every = np.concatenate([rows, ref])
    lo, hi = np.array(lo + [k for _, k in refs], np.int64), np.array(hi + [k + WINDOW for _, k in refs], np.int64)
    return pa.table({
        "chunk": pa.array(chunk[every], pa.int64()), "doc": pa.array(doc[every], pa.int32()),
        "start": pa.array(start[every] + lo, pa.int32()), "stop": pa.array(start[every] + hi, pa.int32()),
        "window": pa.array([None] * len(rows) + names, pa.binary()), "seen": pa.array([0] * len(rows) + seen, pa.int32())})


# --- cutting -------------------------------------------------------------------------
def _cut(with_text: bool):
    def run(batches):
        for row in rows_of(batches):
            data, out, at = row["data"], [], 0
            runs: dict[int, list] = {}
            for r in row["found"] or ():
                runs.setdefault(r["doc"], []).append((r["start"], r["stop"]))
            for i, (n, k) in enumerate(zip(row["lens"], row["copies"])):
                text = data[at:at + n]
                at += n
                if n >= WINDOW and k > 1:
                    cuts = [(0, n)]
                else:
                    cuts = []
                    for a, b in sorted(runs.get(i, ())):
                        if cuts and a <= cuts[-1][1]:
                            cuts[-1] = (cuts[-1][0], max(b, cuts[-1][1]))
                        else:
                            cuts.append((a, b))
                parts, p = [], 0
                for a, b in cuts:
                    parts.append(text[p:a])
                    p = b
                kept = b"".join([*parts, text[p:]])
                out.append((row["names"][i], n, n - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8", "ignore") if with_text else None))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array(x, t) for x, t in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(cols, ["name", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def _name(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))


def cut_texts(docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """name (digest), n_bytes, n_removed, n_spans, kept_sha256, kept of each distinct text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(t)), F.lit(0)).alias("n")).first().n
    files = table_buckets(size)
    distinct = docs.select(_name(text).alias("name"), t.alias("text")).groupBy("name").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    chunks = bucketed(map_arrow(distinct, _pack, TEXTS), "texts", files)
    bits = max(3, int(size / 60 / 1_500_000).bit_length())
    joined, _ = with_counts(chunks, _emit(bits), files)
    n_chunks = chunks.select("chunk").count()
    every = max(1, n_chunks // SAMPLE_CHUNKS)
    sampled = map_arrow(joined.filter(F.pmod(F.xxhash64("chunk"), F.lit(every)) == 0), _sample,
                        "bytes bigint, leads binary").collect()          # at most SAMPLE_EACH leads of a chunk
    leads = np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r.leads, np.uint64) for r in sampled]]))
    n = int(max(8, sum(r.bytes for r in sampled) * every // BUCKET_BYTES))
    splitters = np.unique(leads[(np.arange(1, n) * len(leads)) // n]) if len(leads) else leads
    suffixes = map_arrow(joined, _suffixes(splitters), SUFFIXES)
    found = stored(suffixes.groupBy("bucket", "gram", "salt").applyInArrow(_sort_bucket, FOUND), "repeats")
    across = found.filter("window IS NOT NULL").groupBy("window").agg(
        F.sum("seen").alias("seen"), F.collect_list(F.when(F.col("seen") == 1, F.struct("chunk", "doc", "start", "stop")))
        .alias("refs")).filter("seen > 1").select(F.explode("refs").alias("r")).select("r.*")
    spans = found.filter("window IS NULL").select("chunk", "doc", "start", "stop").union(across)
    spans = spans.groupBy("chunk").agg(F.collect_list(F.struct("doc", "start", "stop")).alias("found"))
    return map_arrow(chunks.join(spans.hint("merge"), "chunk", "left"), _cut(with_text),
                     "name binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")


def dedup_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    cut = finished(lambda: cut_texts(docs, text).drop("kept"), "cut-texts")
    return docs.select("doc_id", _name(text).alias("name")).join(cut, "name", "left").drop("name")


def remove_repeats(docs: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The documents without their repeated strings (a character cut in half goes too). Documents of
    which nothing but white space is left are dropped if something was removed."""
    cut = finished(lambda: cut_texts(docs, text, True).select("name", "n_removed", "kept"), "cut-texts")
    name = "_name"
    while name in docs.columns:
        name += "_"
    cut = cut.select(F.col("name").alias(name), F.col("n_removed").alias(f"{name}n"), F.col("kept").alias(f"{name}k"))
    rest = docs.withColumn(name, _name(text)).drop(text).join(cut, name)
    rest = rest.filter((F.col(f"{name}n") == 0) | F.col(f"{name}k").rlike("[^\\x20\\x09-\\x0D]"))
    new = {text: F.col(f"{name}k")}
    if n_chars:
        new[n_chars] = F.length(f"{name}k").cast("long")
    return rest.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
