"""Streaming jobs.  Each writes to a sink with a checkpoint folder, so a
restarted query resumes where it stopped and replays batches idempotently."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netwarden.operators.alerts import ALERT_COLUMNS


def flow_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """File stream (parquet / csv / json); ``format='kafka'`` works the same way
    when its package is on the classpath."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


def _trigger(w, available_now: bool, processing_time: str | None):
    if available_now:
        return w.trigger(availableNow=True)
    if processing_time:
        return w.trigger(processingTime=processing_time)
    return w


def stream_detect(flows: DataFrame, to_alerts: Callable[[DataFrame], DataFrame], out_path: str,
                  checkpoint: str, available_now: bool = True,
                  processing_time: str | None = None) -> StreamingQuery:
    """New flows -> detection -> alert rows appended to a parquet table.

    ``to_alerts`` is any stateless DataFrame function (e.g. ``detect`` followed
    by ``generate_alerts``); ``mapInArrow`` and ``mapInPandas`` scoring
    both run on streams.
    """
    alerts = to_alerts(flows)
    w = (alerts.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return _trigger(w, available_now, processing_time).start()


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


# --- versioned result tables: v=<batch> folders and a pointer to the one to read ---
def _versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions; pruning bounds how many there are."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(st.getPath().suffix("/_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def publish(df: DataFrame, root: str, version: int, keep: int = 3) -> None:
    """Write a version, point to it, drop all but the newest ``keep``.

    The pointer is one small file that replaces the old one by an atomic rename, after the version is
    complete: a reader sees the version before or this one, never a part. A replayed
    batch rewrites its own version. A reader that holds an older version has ``keep`` - 1
    publications until its files go."""
    spark = df.sparkSession
    fs, folder = _fs(spark, root)
    known = [v for v in _versions(spark, root) if v < version]
    current = _pointed(spark, root)
    # a replayed batch must not rewrite the version that readers are in
    if current != version:
        df.write.mode("overwrite").parquet(f"{root}/v={version}")
        _point(spark, root, version)
    for v in known[:max(0, len(known) + 1 - keep)]:
        fs.delete(folder.suffix(f"/v={v}"), True)


def _point(spark: SparkSession, root: str, version: int) -> None:
    jvm, (fs, folder) = spark._jvm, _fs(spark, root)
    tmp, to = folder.suffix(f"/current.{version}.tmp"), folder.suffix("/current.txt")
    out = fs.create(tmp, True)
    out.writeBytes(str(version))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark._jsc.hadoopConfiguration()).rename(tmp, to, how)


def _pointed(spark: SparkSession, root: str) -> int | None:
    fs, folder = _fs(spark, root)
    at = folder.suffix("/current.txt")
    if not fs.exists(at):
        return None
    lines = spark.read.text(f"{root}/current.txt").collect()
    return int(lines[0][0])


def current(spark: SparkSession, root: str, schema) -> DataFrame:
    """The published version of a versioned table; empty before the first one."""
    v = _pointed(spark, root)
    return spark.createDataFrame([], schema) if v is None else spark.read.schema(schema).parquet(f"{root}/v={v}")


latest_recent = current


def stream_kpis(alerts: DataFrame, out_root: str, checkpoint: str, available_now: bool = True,
                processing_time: str | None = None, keep: int = 3) -> StreamingQuery:
    """Running alert count per severity (complete mode), as a versioned table: every batch publishes
    its whole result, readers take ``current``."""
    counts = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n_alerts"))

    def write(batch: DataFrame, batch_id: int):
        publish(batch.coalesce(1), out_root, batch_id, keep)

    w = (counts.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint))
    return _trigger(w, available_now, processing_time).start()


def stream_recent(alerts: DataFrame, out_root: str, checkpoint: str, n: int = 12,
                  ts_col: str = "timestamp", key: str = "row_id", available_now: bool = True,
                  processing_time: str | None = None, keep: int = 3) -> StreamingQuery:
    """Keep the newest ``n`` alerts.  Batch ``b`` publishes version ``b`` from the newest version before it
    plus the batch, so a replay gives the same rows; readers take ``current``, old versions go."""
    spark = alerts.sparkSession
    schema = alerts.schema

    def write(batch: DataFrame, batch_id: int):
        prior = [v for v in _versions(spark, out_root) if v < batch_id]
        cur = batch
        if prior:
            cur = spark.read.schema(schema).parquet(f"{out_root}/v={prior[-1]}").unionByName(batch)
        top = cur.orderBy(F.col(ts_col).desc_nulls_last(), F.col(key).desc()).limit(n)
        publish(top.coalesce(1), out_root, batch_id, max(2, keep))

    w = (alerts.writeStream.outputMode("append").foreachBatch(write)
         .option("checkpointLocation", checkpoint))
    return _trigger(w, available_now, processing_time).start()


# --- closing a finished source ---
_END = "2262-01-01 00:00:00"


def _markers(spark: SparkSession, checkpoint: str) -> str:
    """The folder of a query's closing marker, beside its checkpoint."""
    return f"{checkpoint.rstrip('/')}-closing"


def with_closing(rows: DataFrame, checkpoint: str, watermark: str) -> DataFrame:
    """The stream (with its event time ``_ets``) united with the closing marker's, ``_closing`` true there,
    under one watermark: once the marker is written, the watermark passes every real row."""
    spark = rows.sparkSession
    folder = _markers(spark, checkpoint)
    fs, p = _fs(spark, folder)
    fs.mkdirs(p)
    end = spark.readStream.schema("_ets timestamp").parquet(folder).withColumn("_closing", F.lit(True))
    return rows.withColumn("_closing", F.lit(False)).unionByName(end, allowMissingColumns=True).withWatermark("_ets", watermark)


def run_finished(spark: SparkSession, start: Callable[[], StreamingQuery], checkpoint: str) -> None:
    """Drain a source that will get no more rows, then close it: ``start`` (an availableNow query over
    ``with_closing``) runs once over the rows and once over the marker, whose watermark
    lets the last windows and timers out. The sink stays idempotent: the marker is one more
    batch of the same query, and closing again finds it written. Later rows would be late."""
    run_to_end(start())
    folder = _markers(spark, checkpoint)
    if spark.read.schema("_ets timestamp").parquet(folder).isEmpty():
        spark.range(1).select(F.to_timestamp(F.lit(_END)).alias("_ets")).coalesce(1).write.mode("append").parquet(folder)
    run_to_end(start())


def stream_timeline(alerts: DataFrame, out_path: str, checkpoint: str, window: str = "1 hour",
                    watermark: str = "10 minutes", ts_col: str = "timestamp",
                    available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Alerts per event-time window; a window is written once the watermark
    (max event time - ``watermark``) passes its end, later rows are dropped. ``run_finished``
    lets the last windows of a finished source out.

    Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): a wall-clock column is read
    as UTC by interval arithmetic, so windows align to wall-clock hours in any
    session time zone.
    """
    from netwarden.functions.scalar import ntz_as_utc
    ntz = dict(alerts.dtypes)[ts_col] == "timestamp_ntz"
    ts = ntz_as_utc(ts_col) if ntz else F.col(ts_col)
    back = (lambda c: F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + ({c} - timestamp_seconds(0))")
            if ntz else F.col(c))
    counted = (with_closing(alerts.select(ts.alias("_ets")), checkpoint, watermark)
               .groupBy(F.window("_ets", window).alias("w"))
               .agg(F.count_if(~F.col("_closing")).alias("n_alerts")).where("n_alerts > 0")
               .select(back("w.start").alias("window_start"), back("w.end").alias("window_end"),
                       "n_alerts"))
    w = (counted.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return _trigger(w, available_now, processing_time).start()


def stream_window_counts(flows: DataFrame, key_col: str, out_path: str, checkpoint: str,
                         window: str = "2 seconds", slide: str | None = None,
                         watermark: str = "10 seconds", ts_col: str = "ts",
                         error_col: str | None = None, available_now: bool = True,
                         processing_time: str | None = None) -> StreamingQuery:
    """Streaming form of the connection-window features: connections (and
    errors) per key in sliding event-time windows, each window appended once
    the watermark passes its end.  State is keyed by (key, window) and
    dropped after the watermark, so it stays bounded on an endless stream."""
    from netwarden.functions.scalar import ntz_as_utc
    ntz = dict(flows.dtypes)[ts_col] == "timestamp_ntz"
    ts = ntz_as_utc(ts_col) if ntz else F.col(ts_col)
    back = (lambda c: F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + ({c} - timestamp_seconds(0))")
            if ntz else F.col(c))
    win = F.window("_ets", window, slide) if slide else F.window("_ets", window)
    aggs = [F.count_if(~F.col("_closing")).alias("n")]
    if error_col:
        aggs.append(F.sum(F.col(error_col).cast("long")).alias("n_errors"))
    rows = flows.select(key_col, ts.alias("_ets"), *([error_col] if error_col else []))
    counted = (with_closing(rows, checkpoint, watermark)
               .groupBy(F.col(key_col), win.alias("w")).agg(*aggs).where("n > 0")
               .select(key_col, back("w.start").alias("window_start"), back("w.end").alias("window_end"),
                       *[a for a in ("n", "n_errors") if a == "n" or error_col]))
    w = (counted.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return _trigger(w, available_now, processing_time).start()


def stream_trailing_sums(flows: DataFrame, key_cols: list[str], out_path: str, checkpoint: str, interval: str = "2s",
                         sums: dict[str, str] | None = None, watermark: str = "10 seconds", ts_col: str = "ts",
                         row_key: str = "row_id", count_col: str = "n", available_now: bool = True,
                         processing_time: str | None = None) -> StreamingQuery:
    """Every arriving row with its trailing count (and the sums of ``{out: col}``) over [t - interval, t] of
    its key: the live form of the connection-window features.

    State per key: the rows of the last interval before the watermark, and the rows after it, which wait
    until the watermark has passed their time (an event-time timer), when no row of their
    frame can be missing. A key's state is bounded by what arrives within interval plus
    watermark. Late rows are dropped; ``run_finished`` lets the last rows out."""
    import numpy as np
    import pandas as pd
    from netwarden.functions.scalar import ntz_as_utc, ntz_micros
    from netwarden.operators.windows import interval_micros
    width, outs = interval_micros(interval), list((sums or {}).items())
    ntz = dict(flows.dtypes)[ts_col] == "timestamp_ntz"
    us = ntz_micros(ts_col) if ntz else F.unix_micros(F.col(ts_col).cast("timestamp"))
    ets = ntz_as_utc(ts_col) if ntz else F.col(ts_col)
    rows = flows.select(*key_cols, F.col(row_key).cast("long").alias("_id"), us.alias("_us"), ets.alias("_ets"),
                        *[F.col(c).cast("long").alias(f"_v{i}") for i, (_, c) in enumerate(outs)])
    values = [f"_v{i}" for i in range(len(outs))]

    def step(key, frames, state):
        old = state.get[:-1] if state.exists else ([], [], *[[] for _ in values])
        done = state.get[-1] if state.exists else -(1 << 62)         # rows before it have been given out
        cols = [list(x) for x in old]                                # times, ids, values
        if not state.hasTimedOut:
            for f in frames:
                f = f[~f["_closing"].astype(bool)]
                for c, name in zip(cols, ("_us", "_id", *values)):
                    c += f[name].fillna(0).astype("int64").tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        t = np.array(cols[0], np.int64)
        order = np.argsort(t, kind="stable")
        t = t[order]
        cols = [np.array(c, np.int64)[order] for c in cols]
        ready = (t >= done) & (t < mark)
        if len(t):
            lo, hi = np.searchsorted(t, t - width), np.searchsorted(t, t, side="right")
            run = {count_col: hi - lo}
            for i, (name, _) in enumerate(outs):
                total = np.concatenate([[0], np.cumsum(cols[2 + i])])
                run[name] = total[hi] - total[lo]
            if ready.any():
                yield pd.DataFrame({row_key: cols[1][ready], **{k: v[ready] for k, v in run.items()}})
        left = t >= max(mark, done) - width
        pending = t[t >= max(mark, done)]
        if not left.any():
            if state.exists:
                state.remove()
            return
        state.update((*[c[left].tolist() for c in cols], max(mark, done)))
        # the next waiting row's time, or else when the kept rows are no longer needed
        due = int(pending[0]) if len(pending) else int(t[left][-1]) + width
        state.setTimeoutTimestamp(max(due // 1000 + 1, mark // 1000 + 1))

    arrays = ", ".join(["t array<bigint>", "id array<bigint>", *[f"{v} array<bigint>" for v in values]])
    out = ", ".join([f"{row_key} bigint", f"{count_col} bigint", *[f"{k} bigint" for k, _ in outs]])
    live = with_closing(rows, checkpoint, watermark).groupBy(*key_cols).applyInPandasWithState(
        step, out, f"{arrays}, done bigint", "append", "EventTimeTimeout")
    w = (live.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return _trigger(w, available_now, processing_time).start()


def run_to_end(q: StreamingQuery, timeout_s: int | None = None) -> None:
    """Wait for an availableNow query to drain (without a limit unless one is given);
    raise its error if it failed."""
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError("stream did not drain in time")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


__all__ = ["flow_stream", "stream_detect", "stream_kpis", "stream_recent", "stream_timeline",
           "stream_window_counts", "stream_trailing_sums", "publish", "current", "latest_recent",
           "with_closing", "run_finished", "run_to_end", "ALERT_COLUMNS"]
