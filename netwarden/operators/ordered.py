"""Global order statistics without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` pulls every row into one task.
Instead: range-sort once, materialise (``checkpoint`` to the shared folder, so
ids are stable across retries and stages), count rows per sorted partition,
prefix-sum those few per-partition totals, and add the offset back.  The
offset table has one row per partition — a bound fixed by the shuffle width,
not by the data — so broadcasting it is safe.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window  # noqa: F401
from pyspark.sql import functions as F

from netwarden.session import checkpoint_dir
from netwarden.sources.local import local_table

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | position


def ordered_running(df: DataFrame, order_cols: list, sum_cols: list[str] = (),
                    rn_col: str = "rn", cum_prefix: str = "cum_") -> DataFrame:
    """Add a 1-based global row number and inclusive running sums in ``order_cols`` order.

    ``order_cols`` must define a total order (append a key to break ties) so
    the result is deterministic.
    """
    checkpoint_dir(df.sparkSession)
    s = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    s = s.checkpoint(eager=True)
    part = F.shiftrightunsigned(F.col("_mid"), _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))

    totals = s.groupBy(part.alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    # One row per partition: prefix-summed on the driver, shipped back as a
    # local (broadcast) relation.
    rows = sorted(totals.collect(), key=lambda r: r["_p"])
    acc = [0] * (1 + len(sum_cols))
    off_rows = []
    for r in rows:
        off_rows.append((r["_p"], *acc))
        acc[0] += r["_n"]
        for i, c in enumerate(sum_cols):
            acc[i + 1] += r[f"_t_{c}"] or 0
    types = dict(s.dtypes)
    schema = ", ".join(["_p long", "_off_n long"]
                       + [f"_off_{c} {'double' if types[c] in ('double', 'float') else 'long'}"
                          for c in sum_cols])
    offsets = local_table(df.sparkSession, off_rows, schema)
    out = s.join(F.broadcast(offsets), part == F.col("_p"))
    out = out.withColumn(rn_col, F.col("_off_n") + local + F.lit(1))
    if sum_cols:
        within = Window.partitionBy("_p").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({f"{cum_prefix}{c}": F.col(f"_off_{c}") + F.sum(c).over(within)
                               for c in sum_cols})
    return out.drop("_mid", "_p", "_off_n", *[f"_off_{c}" for c in sum_cols])
