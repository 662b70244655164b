"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are classes of equal n-gram sets. A pair can only link if it
shares an n-gram among the rarest n - ceil(t n) + 1 of either set (the size-derived bound);
columns of that reduced matrix join classes into candidate clusters, and most classes have
no partner there. Within a cluster the product of the incidence blocks with their transposes
accumulates the overlaps, column block by column block; pairs below 100 I >= percent U are
discarded and every linked group of a block leaves as a star around its smallest class, never
as all pairs.

A cluster of more than ``BLOCK`` classes is cut into blocks. Every block is joined with
itself and with a few pivots of the cluster; then only classes outside the cluster's main
component are joined with all blocks (a pair inside it is connected already). No link
between different texts is lost, and no task holds more than two blocks.

n-grams are compared as 64-bit hashes, sets by a 128-bit hash.

Defined cases: a null or blank text has an empty set and links with nothing; a text of
fewer words than an n-gram has its whole sequence as one n-gram; repeated rows form one class;
an empty table gives an empty result; text length is not limited.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import map_arrow, small, stored
from netwarden.llm.components import components
from netwarden.llm.packed import chunked, counts_of, mix, packed_rows, rows_of, tokens_of, with_counts

#: Fixed by the contract of op3: words of an n-gram; two sets link when 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 4, 85
#: Classes of one block, pivots of a larger cluster, columns multiplied at once, classes of a bin of small clusters.
BLOCK, PIVOTS, COLUMNS, BIN = 1024, 8, 4096, 512


def shingles(row: dict, size: int, only: list[int] | None = None) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each document of a chunk (or of some of them)."""
    lens, words, tokens = tokens_of(row)
    seq = words[tokens]
    n = len(seq)
    grams = seq[:max(0, n - size + 1)]
    for k in range(1, size):
        grams = mix(grams, seq[k:n - size + 1 + k])
    ends = np.cumsum(lens)
    out = []
    for i in range(len(lens)) if only is None else only:
        hi, k = int(ends[i]), int(lens[i])
        if k >= size:
            out.append(np.unique(grams[hi - k:hi - size + 1]))
        elif k:
            g = np.array([k], np.uint64)
            for w in seq[hi - k:hi]:
                g = mix(g, np.array([w], np.uint64))
            out.append(g)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _emit(bits: int, size: int):
    def run(batches):
        for row in rows_of(batches):
            sets = shingles(row, size)
            keys, n = np.unique(np.concatenate(sets), return_counts=True)
            yield packed_rows(row["chunk"], [(1, keys, n)], bits)
    return run


def prefix(grams: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest n-grams that any linked partner must share one of (only those that occur twice at all)."""
    n = len(grams)
    take = n - -(-percent * n // 100) + 1
    first = np.lexsort((grams, counts))[:take]
    return grams[first[counts[first] > 1]]


def _measure(size: int, percent: int):
    def run(batches):
        for row in rows_of(batches):
            sets = shingles(row, size)
            every = np.concatenate(sets)
            keys, at = np.unique(every, return_inverse=True)
            counts = counts_of(row, 1)
            if len(counts) != len(keys):
                raise ValueError("counts do not belong to this chunk")
            counts, ends = counts[at], np.cumsum([len(s) for s in sets])
            heads = [prefix(s, counts[hi - len(s):hi], percent).view(np.int64) for s, hi in zip(sets, ends.tolist())]
            k = len(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(k, row["chunk"])), pa.array(range(k), pa.int32()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "chunk", "at", "n", "class", "head"])
    return run


def _sets(size: int):
    """The n-gram sets of the wanted documents of each chunk."""
    def run(batches):
        for row in rows_of(batches):
            want = row["want"]
            sets = shingles(row, size, [w["at"] for w in want])
            yield pa.RecordBatch.from_arrays(
                [pa.array([w["cluster"] for w in want], pa.binary()), pa.array([w["members"] for w in want], pa.int64()),
                 pa.array([w["class"] for w in want], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["cluster", "members", "class", "set"])
    return run


def groups(sets: list[np.ndarray], left: int, percent: int) -> list[list[int]]:
    """Components (of two or more rows) of the linked pairs of the sets; with ``left`` < len(sets)
    only pairs of one of the first ``left`` rows with any other count."""
    m = len(sets)
    if m < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    keys, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    shared = np.flatnonzero(np.bincount(at, minlength=len(keys)) > 1)      # other columns add nothing
    place = np.full(len(keys), -1)
    place[shared] = np.arange(len(shared))
    col = place[at]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    overlap = np.zeros((left, m), np.float32)
    for lo in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(col, (lo, lo + COLUMNS))
        block = np.zeros((m, min(COLUMNS, len(shared) - lo)), np.float32)
        block[row[a:b], col[a:b] - lo] = 1
        overlap += block[:left] @ block.T
    both = overlap.astype(np.int64)
    union = sizes[:left, None] + sizes[None, :] - both
    linked = 100 * both >= percent * union
    linked &= (both > 0) & (np.arange(m)[None, :] != np.arange(left)[:, None])
    # walk over the linked rows
    seen = np.zeros(m, bool)
    out: list[list[int]] = []
    for i in range(m):
        if seen[i]:
            continue
        seen[i] = True
        todo, group = [i], [i]
        while todo:
            x = todo.pop()
            near = linked[x].copy() if x < left else np.zeros(m, bool)
            near[:left] |= linked[:, x]
            fresh = np.flatnonzero(near & ~seen).tolist()
            seen[fresh] = True
            todo += fresh
            group += fresh
        if len(group) > 1:
            out.append(group)
    return out


def _link(t: pa.Table, percent: int) -> pa.Table:
    """The linked groups of every cluster in one unit, as stars. Rows with side 0 are joined with all rows; where no
    row has side 0, all rows are."""
    rows = t.select(["cluster", "side", "class", "set"]).to_pylist()
    by: dict[bytes, list] = {}
    for r in rows:
        by.setdefault(r["cluster"], []).append(r)
    a, b = [], []
    for members in by.values():
        left = {r["class"] for r in members if r["side"] == 0}
        unique = {r["class"]: r["set"] for r in members}               # a pivot may also be of the block
        names = sorted(unique, key=lambda c: (c not in left, c))
        sets = [np.frombuffer(unique[c], np.uint64) for c in names]
        for group in groups(sets, len(left) or len(names), percent):
            low, *others = sorted(names[x] for x in group)
            a += others
            b += [low] * len(others)
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _links(units: DataFrame, percent: int) -> DataFrame:
    def link(t: pa.Table) -> pa.Table:
        return _link(t, percent)

    return stored(units.groupBy("unit", "block", "other").applyInArrow(link, "a binary, b binary"), "links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component), class (a name of its n-gram set)."""
    chunks, files, bits = chunked(docs, doc_id, text, F.lit(False))
    joined, _ = with_counts(chunks, _emit(bits, size), files)
    rows = stored(map_arrow(joined, _measure(size, percent), "doc_id bigint, chunk bigint, at int, n bigint, class binary, head array<bigint>"),
                  "ngram-rows")
    # candidate clusters: classes that share a column of the reduced matrix
    classes = rows.filter("size(head) > 0").groupBy("class").agg(
        F.min(F.struct("chunk", "at")).alias("loc"), F.min_by("head", F.struct("chunk", "at")).alias("head"))
    posts = stored(classes.select("class", "loc", F.explode("head").alias("gram")), "ngram-posts")
    low = posts.groupBy("gram").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low != high")
    pairs = posts.join(low, "gram").filter("class != low").groupBy("class", "low").agg(F.lit(1))
    clusters = components(pairs.select(F.col("class").alias("a"), F.col("low").alias("b")))
    members = stored(clusters.withColumnsRenamed({"node": "class", "component": "cluster"}), "ngram-clusters")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    where = posts.groupBy("class").agg(F.min("loc").alias("loc"))
    want = members.join(sizes, "cluster").join(where, "class").groupBy(F.col("loc.chunk").alias("chunk")).agg(
        F.collect_list(F.struct(F.col("loc.at").alias("at"), "class", "cluster", "members")).alias("want"))
    sets = stored(map_arrow(chunks.drop("doc_ids", "train").join(want.hint("merge"), "chunk"), _sets(size),
                            "cluster binary, members bigint, class binary, set binary"), "ngram-sets")
    # a cluster joins itself whole, or block by block with its pivots
    n_bins = max(1, members.count() // BIN)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    is_big = F.col("members") > BLOCK
    placed = sets.withColumns({
        "unit": F.when(is_big, F.hex("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(n_bins)).cast("string")),
        "block": F.when(is_big, F.pmod(F.xxhash64("class"), blocks)).otherwise(0).cast("int"),
        "other": F.lit(0), "side": F.lit(1)})
    big = placed.filter(is_big)
    comps = components(_links(placed.drop("members").unionByName(_pivots(big)), percent))
    if big.limit(1).count():
        # classes outside the main component of a large cluster meet every class of it
        labels = stored(big.join(comps.select(F.col("node").alias("class"), "component"), "class", "left")
                        .withColumn("component", F.coalesce("component", "class")), "ngram-labels")
        main = labels.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("k")) \
            .groupBy("cluster").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
        rest = labels.join(main, "cluster").filter("component != main")
        split = rest.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rests"))
        keep = ["unit", "block", "other", "side", "cluster", "class", "set"]
        one = rest.join(split, "cluster").withColumns({
            "side": F.lit(0), "other": F.pmod(F.xxhash64("class"), F.col("rests")).cast("int"),
            "block": F.explode(F.sequence(F.lit(0), blocks - 1))}).select(*keep)
        two = labels.join(split, "cluster").withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).select(*keep)
        comps = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
                           .union(_links(one.unionByName(two), percent)))
    named = rows.groupBy("class").agg(F.min("doc_id").alias("low")).filter("class IS NOT NULL") \
        .join(comps.select(F.col("node").alias("class"), "component"), "class", "left") \
        .withColumn("component", F.coalesce("component", "class"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = named.join(lowest, "component").select("class", "component_id")
    return rows.select("doc_id", "n", "class").join(ids, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "class")


def _pivots(big: DataFrame) -> DataFrame:
    """The first classes of each large cluster (in hash order), copied into each of its blocks."""
    first = big.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_set(F.when(
        F.pmod(F.xxhash64("class"), F.greatest(F.lit(1), F.floor(F.col("members") / (4 * PIVOTS)))) == 0, F.col("class")))),
        1, PIVOTS).alias("classes"))
    some = first.select("cluster", F.explode("classes").alias("class"))
    copies = F.sequence(F.lit(0), F.ceil(F.col("members") / BLOCK).cast("int") - 1)
    return big.join(some, ["cluster", "class"]).withColumn("block", F.explode(copies)).drop("members")


def keep_one(docs: DataFrame, text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents with one of each component (the first in the input's row order); texts without
    words stay. The numbered rows are stored: numbers follow the partitions, which another read
    of the input may pack otherwise."""
    rid = "_row"
    while rid in docs.columns:
        rid += "_"
    rows = stored(docs.withColumn(rid, F.monotonically_increasing_id()), "ngram-input")
    found = near_duplicates(rows, rid, text, size, percent)
    gone = stored(found.filter("doc_id != component_id").select(F.col("doc_id").alias(rid)), "ngram-gone")
    return rows.join(small(gone), rid, "left_anti").drop(rid)
