"""File sources and sinks: CSV flow files, alert log, metrics records, tables."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from netwarden.schema import ALERT_SCHEMA, METRICS_SCHEMA

ALERT_COLUMNS = [f.name for f in ALERT_SCHEMA.fields]


def strip_column_names(df: DataFrame) -> DataFrame:
    """Trim blanks around header names (raw CICIDS headers carry leading blanks)."""
    return df.toDF(*[c.strip() for c in df.columns])


#: Session settings of the header job: one split per file, of which a task reads one line.
_ONE_LINE = {"spark.sql.files.maxPartitionBytes": str(1 << 62), "spark.sql.files.openCostInBytes": str(1 << 62),
             "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def header_catalogue(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """header, files: the first line of every file under the paths (files, folders or globs), and the files that
    share it. One task per file reads its first line; empty files have none and are left out."""
    def first(batches):
        for b in batches:
            if b.num_rows:
                yield b.slice(0, 1)
                return

    with _settings(spark, _ONE_LINE):
        lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("header"))
        found = lines.mapInArrow(first, "file string, header string").collect()      # one row per file
    rows = [(r.file, r.header.removeprefix("\ufeff").rstrip("\r")) for r in found]
    return spark.createDataFrame(rows, "file string, header string").groupBy("header").agg(
        F.sort_array(F.collect_list("file")).alias("files"))


def _columns(spark: SparkSession, header: str, sep: str) -> list[str]:
    """The names in a header line, as the CSV reader splits it."""
    n = len(header.split(sep))
    cells = ", ".join(f"c{i} string" for i in range(n))
    row = spark.range(1).select(F.from_csv(F.lit(header), cells, {"sep": sep}).alias("x")).select("x.*").first()
    return [c or "" for c in row if c is not None]


def read_flows_csv(spark: SparkSession, path: str | list[str], schema=None, infer_schema: bool = True,
                   strip_names: bool = True, sep: str = ",") -> DataFrame:
    """CSV with headers: a file, a folder, a glob, or several of them. ``Inf``/``Infinity``/``NaN`` parse as doubles.

    Files are grouped by their own header line and each group is one scan, so that files with other
    columns or another order are read by name; a column that a group lacks is NULL
    there. Pass a ``schema`` (names as they are after trimming, or as in the files) at scale:
    inference costs a pass. With a schema its columns come out, in its order.
    """
    heads = [(r.header, r.files) for r in header_catalogue(spark, path).orderBy("header").collect()]
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    types = {f.name.strip(): f.dataType for f in wanted.fields} if wanted is not None else {}
    out = None
    for header, files in heads:                                   # one scan per distinct header
        reader = spark.read.option("header", True).option("sep", sep)
        if wanted is not None:
            names = _columns(spark, header, sep)
            reader = reader.schema(T.StructType([T.StructField(c, types.get(c.strip(), T.StringType())) for c in names]))
        else:
            reader = reader.option("inferSchema", infer_schema)
        df = reader.csv(files)
        if strip_names:
            df = strip_column_names(df)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], wanted or T.StructType([]))
    if wanted is not None:
        have = {c.strip(): c for c in out.columns}
        out = out.select(*[F.col(f"`{have[n]}`") if n in have else F.lit(None).cast(t).alias(n) for n, t in types.items()])
    return out


def read_flows_dir(spark: SparkSession, paths: str | list[str], **kw) -> DataFrame:
    """All CSV files of a folder (or of several folders, files or globs); their headers may differ."""
    if not paths:
        raise FileNotFoundError("no input files")
    return read_flows_csv(spark, paths, **kw)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_alert_log(alerts: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Alert log partitioned by alert date, so time-bounded panels prune files."""
    out = alerts.withColumn("alert_date", F.to_date("timestamp"))
    return write_table(out, path, mode=mode, partition_by=["alert_date"])


def read_alert_log(spark: SparkSession, path: str, keep_partition: bool = False) -> DataFrame:
    """Read the alert log with its fixed schema; a missing log is an empty table.

    ``keep_partition`` keeps the ``alert_date`` column so time-bounded panels
    (``panels.time_range``) prune whole days."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], ALERT_SCHEMA)
        raise
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in ALERT_SCHEMA.fields]
    if keep_partition and "alert_date" in df.columns:
        cols.append(F.col("alert_date"))
    return df.select(*cols)


def write_metrics_json(metrics: DataFrame, path: str) -> str:
    metrics.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """One metrics record per model; a missing file gives an empty table."""
    try:
        return spark.read.schema(METRICS_SCHEMA).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], METRICS_SCHEMA)
        raise
