"""Monitoring tables over the alert log (one function per dashboard panel).

Each is a single aggregate plan: partial aggregation runs map-side, so a hot
source or severity never concentrates raw rows in one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.schema import SEVERITY_ORDER
from netwarden.sources.local import local_table


def time_range(alerts: DataFrame, since=None, until=None, ts_col: str = "timestamp",
               date_col: str = "alert_date") -> DataFrame:
    """Alerts with ``since <= ts < until``.  On a log written by
    ``write_alert_log`` the same bounds are applied to the date partition
    column as well, so the scan skips whole days (partition pruning)."""
    out = alerts
    has_date = date_col in alerts.columns
    if since is not None:
        out = out.where(F.col(ts_col) >= F.lit(since).cast("timestamp_ntz"))
        if has_date:
            out = out.where(F.col(date_col) >= F.to_date(F.lit(since).cast("timestamp_ntz")))
    if until is not None:
        out = out.where(F.col(ts_col) < F.lit(until).cast("timestamp_ntz"))
        if has_date:
            out = out.where(F.col(date_col) <= F.to_date(F.lit(until).cast("timestamp_ntz")))
    return out


def alert_kpis(alerts: DataFrame, approx_sources: bool = False) -> DataFrame:
    """Totals per severity, distinct sources, mean (1 dp) and max confidence; 0 when empty."""
    sev = F.col("severity")
    distinct = (F.approx_count_distinct("source_ip") if approx_sources
                else F.countDistinct("source_ip"))
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(sev == "CRITICAL").alias("critical"),
        F.count_if(sev == "HIGH").alias("high"),
        F.count_if(sev == "MEDIUM").alias("medium"),
        F.count_if(sev == "LOW").alias("low"),
        distinct.cast("long").alias("unique_src_ips"),
        F.coalesce(F.round(F.avg("confidence_score"), 1), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.max("confidence_score"), F.lit(0.0)).alias("max_confidence"),
    )


def severity_distribution(alerts: DataFrame, fill_zero: bool = True) -> DataFrame:
    """Counts per severity.  ``fill_zero`` gives all four levels in fixed order."""
    counts = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n_alerts"))
    if not fill_zero:
        return counts
    spark = alerts.sparkSession
    dim = local_table(spark, [(s, i) for i, s in enumerate(SEVERITY_ORDER)],
                      "severity string, severity_rank int")
    # The dimension has four rows by construction: broadcasting it is safe.
    return (F.broadcast(dim).join(counts, "severity", "left")
            .select("severity", "severity_rank",
                    F.coalesce(F.col("n_alerts"), F.lit(0)).cast("long").alias("n_alerts")))


def value_counts_topk(df: DataFrame, column: str, k: int | None = None,
                      count_name: str = "n") -> DataFrame:
    """Counts per non-null value, descending, ties by value; top ``k`` if given."""
    counts = (df.where(F.col(column).isNotNull()).groupBy(column)
              .agg(F.count(F.lit(1)).alias(count_name)))
    ordered = counts.orderBy(F.col(count_name).desc(), F.col(column).asc())
    return ordered.limit(k) if k else ordered


def timeline_minute_of_day(alerts: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """Counts per ``HH:mm`` label (all dates folded together), sorted by label."""
    return (alerts.where(F.col(ts_col).isNotNull())
            .groupBy(F.date_format(ts_col, "HH:mm").alias("minute_label"))
            .agg(F.count(F.lit(1)).alias("n_alerts")).orderBy("minute_label"))


def timeline_hourly(alerts: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """Counts per calendar hour."""
    hour = F.date_trunc("hour", F.col(ts_col)).cast("timestamp_ntz")
    return (alerts.where(F.col(ts_col).isNotNull()).groupBy(hour.alias("hour_start"))
            .agg(F.count(F.lit(1)).alias("n_alerts")).orderBy("hour_start"))
