"""Resharding by minimum-cost flow.

From the bytes in each old shard and the capacities of the new ones, a minimum-cost
flow says how many bytes go from where to where (keeping a byte where it is costs
nothing, moving it costs one). Inside an old shard the rows lie in hashed blocks in a
fixed order, so that the flow cuts that order into consecutive runs, one per new shard.
Only the blocks that a cut runs through are looked at row by row; every other row finds
its new shard from its block. Only the shards that the flow touches are rewritten.

Rows are laid in tiers, the long ones first: a tier takes its share of every run of the flow
over all bytes that are left, and the flow is solved again for the rest with what the tier
really took, so that the last cuts fall between short rows.

Only totals and runs per shard (at most old x new numbers a tier) reach the driver.

Defined cases: a null text counts no bytes (size 1), a null old shard is shard 0, repeated
rows are placed one by one (a row is known by its file and its place in it), an empty table
gives an empty result, other columns of any name are carried along.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netwarden.llm.common import MADE, small, stored
from netwarden.session import scratch_path

N_SHARDS = 8
#: Bytes of text in one hashed block of an old shard (blocks grow in number, not in size).
BLOCK_BYTES = 4 << 20
#: Least size of a row of each tier but the last, as a share of a new shard.
TIERS = (0.02, 0.002)
#: Bytes of text in one written file.
FILE_BYTES = 128 << 20


def min_cost_flow(have: list[int], room: list[int], cost) -> list[list[int]]:
    """Bytes from each old shard i to each new shard j, all of them, at the least total
    cost(i, j): successive shortest augmenting paths (Bellman-Ford) on the small graph of
    old and new shards. ``sum(room)`` must be at least ``sum(have)``."""
    n, m = len(have), len(room)
    flow = [[0] * m for _ in range(n)]
    left, free = list(have), list(room)
    while any(left):
        dist = [0.0 if x else float("inf") for x in left] + [float("inf")] * m
        back = [-1] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost(i, j) < dist[n + j] - 1e-9:
                        dist[n + j], back[n + j], changed = dist[i] + cost(i, j), i, True
                    if flow[i][j] and dist[n + j] - cost(i, j) < dist[i] - 1e-9:
                        dist[i], back[i], changed = dist[n + j] - cost(i, j), n + j, True
            if not changed:
                break
        ends = [n + j for j in range(m) if free[j] and dist[n + j] < float("inf")]
        if not ends:
            raise ValueError("the new shards are too small")
        end = min(ends, key=lambda v: (dist[v], v))
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0]], free[end - n])
        for a, b in zip(path, path[1:]):
            if a >= n:
                amount = min(amount, flow[b][a - n])
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        free[end - n] -= amount
    return flow


def _even(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


def _lowered(rest: list[int], need: int) -> list[int]:
    """The highest capacities lowered until they hold just ``need`` bytes together."""
    rest = list(rest)
    over = sum(rest) - need
    while over > 0:
        top = max(rest)
        cut = min(over, max(1, (top - max([x for x in rest if x < top], default=0)) * rest.count(top)))
        tops = [j for j, x in enumerate(rest) if x == top]
        for k, j in enumerate(tops):
            rest[j] -= cut // len(tops) + (k < cut % len(tops))
        over -= cut
    return rest


def _runs(row: list[int], old: int, size: int) -> list[tuple[int, int]]:
    """(end, new shard) of the runs in which ``size`` bytes of an old shard follow its row of the flow: what
    stays lies first, every run has its share of the bytes."""
    order = [j for j in [old, *[j for j in range(len(row)) if j != old]] if j < len(row) and row[j]]
    total, so_far, out = sum(row), 0, []
    for j in order:
        so_far += row[j]
        out.append((size * so_far // total, j))
    return out


def moves(rows: DataFrame, n_old: int, n_new: int = N_SHARDS) -> Callable[[DataFrame], DataFrame]:
    """Solves the flow for rows with the columns old_shard, size, h (a hash), file and place (its key); the
    result adds the column new_shard to rows with these columns."""
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    least = [max(2, int(total / n_new * share)) for share in TIERS]
    blocks = max(16, -(-total // (n_old * BLOCK_BYTES)))
    tier = F.lit(len(least))
    for t in reversed(range(len(least))):
        tier = F.when(F.col("size") >= least[t], t).otherwise(tier)

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("tier", tier).withColumn("block", F.pmod("h", F.lit(blocks)).cast("long"))

    per_block = keyed(rows).groupBy("tier", "old_shard", "block").agg(F.sum("size").alias("bytes"))
    per_block = stored(per_block.withColumn("end", F.sum("bytes").over(
        Window.partitionBy("tier", "old_shard").orderBy("block"))), "reshard-blocks")
    sums = {(r.tier, r.old_shard): r.b for r in
            per_block.groupBy("tier", "old_shard").agg(F.sum("bytes").alias("b")).collect()}       # tiers x old shards
    room, used, whole, cut = _even(total, n_new), [0] * n_new, [], []

    def at(place: str) -> Column:
        return F.expr(f"get(filter(runs, r -> {place} < r.end), 0).j")

    for t in range(len(least) + 1):
        left = [sum(b for (k, i), b in sums.items() if k >= t and i == old) for old in range(n_old)]
        here = [i for i in range(n_old) if sums.get((t, i))]
        if not here:
            continue
        rest = _lowered([max(0, c - u) for c, u in zip(room, used)], sum(left))
        flow = min_cost_flow(left, rest, lambda i, j: 0 if i == j else 1)
        runs = spark.createDataFrame([(i, _runs(flow[i], i, sums[t, i])) for i in here],
                                     "old_shard int, runs array<struct<end: bigint, j: int>>")
        found = per_block.filter(F.col("tier") == t).join(F.broadcast(runs), "old_shard") \
            .withColumn("first", at("end - bytes")).withColumn("last", at("end - 1"))
        for r in found.filter("first = last").groupBy("old_shard", "first").agg(
                F.min("block").alias("lo"), F.max("block").alias("hi"), F.sum("bytes").alias("b")).collect():
            whole.append((t, r.old_shard, r.lo, r.hi, r.first))
            used[r.first] += r.b
        # a cut block for every run but the first of an old shard, at most
        through = found.filter("first != last").select("old_shard", "block", "runs", (F.col("end") - F.col("bytes")).alias("ahead"))
        order = Window.partitionBy("old_shard", "block").orderBy("h", "file", "place").rowsBetween(Window.unboundedPreceding, 0)
        split = keyed(rows).filter(F.col("tier") == t).join(F.broadcast(through), ["old_shard", "block"]) \
            .withColumn("middle", F.col("ahead") + F.sum("size").over(order) - F.col("size") / 2)
        split = stored(split.select("old_shard", "file", "place", "size", at("middle").alias("j")), "reshard-split")
        for r in split.groupBy("j").agg(F.sum("size").alias("b")).collect():
            used[r.j] += r.b
        cut.append(split.drop("size"))

    if not cut:                          # no rows at all
        return lambda df: df.withColumn("new_shard", F.lit(0))
    ranges: dict[tuple, list] = {}
    for t, i, lo, hi, j in whole:
        ranges.setdefault((t, i), []).append((lo, hi, j))
    table = spark.createDataFrame([(*k, v) for k, v in ranges.items()],
                                  "tier int, old_shard int, ranges array<struct<lo: bigint, hi: bigint, j: int>>")
    singly = cut[0]
    for more in cut[1:]:
        singly = singly.unionByName(more)
    singly = small(singly)

    def place(df: DataFrame) -> DataFrame:
        by_block = F.expr("get(filter(ranges, r -> block BETWEEN r.lo AND r.hi), 0).j")
        return keyed(df).join(F.broadcast(table), ["tier", "old_shard"], "left") \
            .join(singly, ["old_shard", "file", "place"], "left") \
            .withColumn("new_shard", F.coalesce("j", by_block)).drop("tier", "block", "ranges", "j")

    return place


def _keyed_rows(docs: DataFrame, shard: str, text: str) -> DataFrame:
    """key (file, place, old_shard, size, h) and row (all columns but the shard) of every row of Parquet files."""
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    out = docs.select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"),
        F.coalesce(F.col(f"`{shard}`"), F.lit(0)).cast("int").alias("old_shard"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != shard]).alias("row"))
    return out.withColumn("h", F.xxhash64("old_shard", "file", "place"))


def rewrite(source: str, target: str, spark: SparkSession, n_new: int = N_SHARDS, text: str = "text",
            shard: str = "shard", schema: StructType | None = None) -> dict[int, list[str]]:
    """Reshard a data set stored as ``source/<shard>=<k>``: the folders of every new shard that has rows. A
    shard that neither loses nor gains rows keeps its folder; the others are written anew below ``target``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    docs = reader.parquet(source)
    rows = stored(_keyed_rows(docs, shard, text).drop("row"), "reshard-rows")
    have = rows.groupBy("old_shard").agg(F.sum("size").alias("b")).collect()                       # old shards
    n_old = max((r.old_shard for r in have), default=0) + 1
    place = moves(rows, n_old, n_new)
    pairs = place(rows).groupBy("old_shard", "new_shard").agg(F.sum("size").alias("b")).collect()  # old x new
    touched = sorted({x for r in pairs if r.old_shard != r.new_shard for x in (r.old_shard, r.new_shard)})
    out = {r.old_shard: [f"{source}/{shard}={r.old_shard}"] for r in have if r.old_shard not in touched}
    if touched:
        files = max(1, -(-max(sum(r.b for r in pairs if r.new_shard == j) for j in touched) // FILE_BYTES))
        rewritten = place(_keyed_rows(docs.filter(F.coalesce(F.col(f"`{shard}`"), F.lit(0)).isin(touched)), shard, text))
        part = F.pmod(F.xxhash64("h"), F.lit(files))
        rewritten.repartition(n_new * files, "new_shard", part).select("row.*", F.col("new_shard").alias(shard)) \
            .write.option("compression", "zstd").partitionBy(shard).parquet(target)
        out |= {j: [f"{target}/{shard}={j}"] for j in sorted({r.new_shard for r in pairs} & set(touched))}
    return out


def shard_report(docs: DataFrame, old_shard: Column, n_new: int = N_SHARDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row, read from the files of the new
    shards: docs are laid out by their old shard and resharded; a slot is a row's place in its shard's files."""
    spark, shard = docs.sparkSession, "shard"
    while shard in {c.lower() for c in docs.columns}:
        shard += "_"
    laid = docs.withColumn(shard, F.coalesce(old_shard, F.lit(0)).cast("int"))
    source, target = scratch_path(spark, "reshard-old"), scratch_path(spark, "reshard-new")
    MADE.extend([(source, None), (target, None)])
    laid.write.option("compression", "zstd").partitionBy(shard).parquet(source)
    folders = rewrite(source, target, spark, n_new, text, shard, laid.schema)
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    out = None
    for base in (source, target):
        mine = [j for j, paths in folders.items() if paths[0].startswith(f"{base}/")]
        if mine or (base == source and not folders):
            rows = spark.read.schema(laid.schema).parquet(base).filter(F.col(f"`{shard}`").isin(mine)).select(
                "doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
                F.col(f"`{shard}`").alias("shard"), F.col("_metadata.file_name").alias("file"),
                F.col("_metadata.row_index").alias("place"))
            out = rows if out is None else out.unionByName(rows)
    out = stored(out, "reshard-report")
    counts = out.groupBy("shard", "file").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("shard", "file", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("file")) - F.col("n")).alias("ahead"))
    return out.join(small(stored(ahead, "reshard-files")), ["shard", "file"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("ahead") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
