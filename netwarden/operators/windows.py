"""Connection-window features: per row, how many connections the same host /
service saw in the trailing ``interval`` (inclusive), and the error and
same-service shares among them.

A plain ``Window.partitionBy(host).orderBy(ts).rangeBetween`` puts every row of a busy host
in one task. Here time is cut into slices of the interval: a frame is a part of two slices,
summed in the partition (key, slice), and the carried totals of the whole slices between
them. Rows of one microsecond are summed first, so that no partition grows with a burst.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MICROS = {"s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}


def _micros(df: DataFrame, ts_col: str):
    """Event time in microseconds, independent of the session time zone."""
    from netwarden.functions.scalar import ntz_micros
    if dict(df.dtypes)[ts_col] == "timestamp_ntz":
        return ntz_micros(ts_col)
    return F.unix_micros(F.col(ts_col).cast("timestamp"))


def interval_micros(interval: str | int) -> int:
    if isinstance(interval, int):
        return interval
    n, unit = interval[:-1], interval[-1]
    return int(float(n) * MICROS[unit])


def trailing_window_sums_ranked(df: DataFrame, key_cols: list[str], ts_col: str, interval,
                                sum_cols: dict[str, str] | None = None, count_col: str = "n",
                                row_key: str = "row_id") -> DataFrame:
    """Add ``count_col`` (= rows with the same key in [ts - interval, ts]) and, for each ``{out: col}`` in
    ``sum_cols``, the sum of ``col`` over that frame.

    Every row emits two probes next to itself in one global order
    ``(key, time, kind, row_key)``: one just before the rows at ``ts - interval``
    and one just after the rows at ``ts``.  Running totals of the real rows
    come from the range-partitioned prefix sum (``ordered_running``), and a
    row's frame total is the difference between its two probes.  Range
    partitioning splits even a single key's burst over many tasks.
    """
    from netwarden.operators.ordered import ordered_running
    width = interval_micros(interval)
    sums = dict(sum_cols or {})
    t = _micros(df, ts_col)
    kind = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    base = df.select(row_key, *key_cols, t.alias("_t0"), *[F.col(c).alias(f"_v{i}")
                                                            for i, c in enumerate(sums.values())])
    u = base.withColumn("_kind", kind).withColumns({
        "_t": F.when(F.col("_kind") == 0, F.col("_t0") - F.lit(width)).otherwise(F.col("_t0")),
        "_real": (F.col("_kind") == 1).cast("long"),
        **{f"_v{i}": F.when(F.col("_kind") == 1, F.col(f"_v{i}")).otherwise(F.lit(0)).cast("long")
           for i in range(len(sums))}})
    vals = ["_real"] + [f"_v{i}" for i in range(len(sums))]
    ranked = ordered_running(u.drop("_t0"), [*key_cols, "_t", "_kind", row_key], vals)
    probes = ranked.where(F.col("_kind") != 1)

    def diff(c):
        return (F.sum(F.when(F.col("_kind") == 2, F.col(f"cum_{c}")))
                - F.sum(F.when(F.col("_kind") == 0, F.col(f"cum_{c}"))))

    per_row = probes.groupBy(row_key).agg(
        diff("_real").alias(count_col),
        *[diff(f"_v{i}").alias(out) for i, out in enumerate(sums)])
    return df.join(per_row, row_key)


#: Slices of one interval, at most (as many as divide it).
SLICES = 64


def _sliced_sums(cells: DataFrame, keys: list[str], width: int, sums: dict[str, str]) -> DataFrame:
    """Add {out: col} sums over [t - width, t] of the same keys to rows (keys, ``_t``, ``_slice``, cols).

    With ``k`` slices to an interval a frame is the row's own slice up to t, the k - 1 slices
    before it whole, and the slice k before it from t - width on. The first and the last part are
    two running sums in the partition (keys, slice), in which each row is also a copy k
    slices later; the whole slices between are carried as their totals."""
    k = max(d for d in range(1, SLICES + 1) if width % d == 0)
    both = cells.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({
        "_at": F.col("_t") + F.col("_copy") * F.lit(width), "_in": F.col("_slice") + F.col("_copy") * F.lit(k)})
    w = Window.partitionBy(*keys, "_in").orderBy("_at")
    upto, on = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    own = {out: F.sum(F.when(F.col("_copy") == 0, F.col(c))).over(upto)
           + F.coalesce(F.sum(F.when(F.col("_copy") == 1, F.col(c))).over(on), F.lit(0)) for out, c in sums.items()}
    rows = both.withColumns(own).where("_copy = 0").drop("_copy", "_at", "_in")
    # whole slices, by buckets of one interval: each total also stands, as context, in the next bucket
    total = cells.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_slice").alias("_of")).agg(
        *[F.sum(c).alias(f"_w_{out}") for out, c in sums.items()])
    names = [f"_k{i}" for i in range(len(keys))]
    total = total.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_bucket", F.floor(F.col("_of") / F.lit(k)) + F.col("_copy"))
    between = Window.partitionBy(*names, "_bucket").orderBy("_of").rangeBetween(-(k - 1), -1)
    total = total.select(*names, "_of", "_copy", *[F.coalesce(F.sum(f"_w_{out}").over(between), F.lit(0)).alias(f"_b_{out}")
                                                   for out in sums]).where("_copy = 0").drop("_copy")
    on_keys = F.col("_slice") == F.col("_of")
    for i, c in enumerate(keys):
        on_keys = on_keys & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(total, on_keys)
    return joined.withColumns({out: F.col(out) + F.col(f"_b_{out}") for out in sums}).drop(
        *names, "_of", *[f"_b_{out}" for out in sums])


def _sliced(x: DataFrame, host: str, service: str, ts_col: str, width: int, flags: list[str]) -> DataFrame:
    """The rows with ``_count``, ``_srv_count``, ``_same`` and the flags' sums ``_host<flag>``, ``_srv<flag>``.

    Rows of one host, service and microsecond are summed first, so a (key, slice) holds at
    most the slice's microseconds times the services or hosts, however many rows fall into it: a burst of one
    key spreads over the slices of its interval."""
    k = max(d for d in range(1, SLICES + 1) if width % d == 0)
    t = _micros(x, ts_col)
    cells = x.select(F.col(host).alias("_h"), F.col(service).alias("_v"), t.alias("_t"), *flags).where("_t IS NOT NULL") \
        .groupBy("_h", "_v", "_t").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f).alias(f) for f in flags]) \
        .withColumn("_slice", F.floor(F.col("_t") / F.lit(width // k)))
    cells = _sliced_sums(cells, ["_h"], width, {"_count": "_n", **{f"_host{f}": f for f in flags}})
    cells = _sliced_sums(cells, ["_h", "_v"], width, {"_same": "_n"})
    cells = _sliced_sums(cells, ["_v"], width, {"_srv_count": "_n", **{f"_srv{f}": f for f in flags}})
    cells = cells.drop("_slice", "_n", *flags).withColumnRenamed("_t", "_ct")
    same = F.col("_row_t").eqNullSafe(F.col("_ct")) & F.col(host).eqNullSafe(F.col("_h")) & F.col(service).eqNullSafe(F.col("_v"))
    return x.withColumn("_row_t", t).join(cells, same, "left").drop("_row_t", "_ct", "_h", "_v")


def flow_window_features(df: DataFrame, host_col: str, service_col: str, ts_col: str = "ts",
                         error_col: str = "is_error", interval="2s", method: str = "sliced",
                         row_key: str = "row_id", reject_col: str | None = None) -> DataFrame:
    """``count``, ``srv_count``, ``serror_rate``, ``srv_serror_rate``, with ``reject_col`` also ``rerror_rate`` and
    ``srv_rerror_rate``, ``same_srv_rate``, ``diff_srv_rate`` for every row (6 dp).

    ``sliced`` (default): frames as running sums within slices of the interval and carried
    totals of whole slices; the host and host+service frames share one exchange. A row without a time
    has NULL features. ``ranked``: differences of global running totals.
    """
    flags = {"_err": error_col} | ({"_rej": reject_col} if reject_col else {})
    x = df.withColumns({f: F.col(c).cast("long") for f, c in flags.items()})
    if method == "ranked":
        x = trailing_window_sums_ranked(x, [host_col], ts_col, interval, {f"_host{f}": f for f in flags}, "_count", row_key)
        x = trailing_window_sums_ranked(x, [service_col], ts_col, interval, {f"_srv{f}": f for f in flags},
                                        "_srv_count", row_key)
        x = trailing_window_sums_ranked(x, [host_col, service_col], ts_col, interval, None, "_same",
                                        row_key)
    else:
        x = _sliced(x, host_col, service_col, ts_col, interval_micros(interval), list(flags))

    def rate(a, b):
        return F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)

    rejected = [rate("_host_rej", "_count").alias("rerror_rate"),
                rate("_srv_rej", "_srv_count").alias("srv_rerror_rate")] if reject_col else []
    return x.select(
        *df.columns, F.col("_count").cast("long").alias("count"),
        F.col("_srv_count").cast("long").alias("srv_count"),
        rate("_host_err", "_count").alias("serror_rate"),
        rate("_srv_err", "_srv_count").alias("srv_serror_rate"), *rejected,
        rate("_same", "_count").alias("same_srv_rate"),
        F.round(F.lit(1.0) - F.try_divide(F.col("_same").cast("double"), F.col("_count").cast("double")), 6)
        .alias("diff_srv_rate"))
