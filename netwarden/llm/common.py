"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.session import scratch_path, table_path

#: White space that separates words (fixed by the query contracts).
SPACE = "[\\x20\\x09-\\x0D]+"

#: Rows up to which a materialised, counted table may be broadcast.
BROADCAST_ROWS = 100_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def words(text: Column) -> Column:
    """Array of the words of a text (null text: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, other letters untouched."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


#: Folders and catalogue tables that this driver has stored and not released, in order.
MADE: list[tuple[str, str | None]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back: the
    lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    MADE.append((path, None))
    df.write.option("compression", "zstd").parquet(path)
    sweep(spark)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Ask both collectors to drop the plans that are done, and with them their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that `make` plans, stored; all that was stored on the way to it is deleted, and the
    collector is asked to drop the shuffles that no plan holds any more."""
    mark = len(MADE)
    out = stored(make(), name)
    spark, kept = out.sparkSession, MADE.pop()
    for path, table in MADE[mark:]:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    MADE[mark:] = [kept]
    sweep(spark)
    return out


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a stored table whose counted size allows it; a larger
    one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` whose workers can import this package: the folder it was loaded from
    joins their PYTHONPATH (on a cluster the package is installed there, or sent with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
    return df.mapInArrow(fn, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str,
                rows: int = 4096, max_bytes: int = 8 << 20) -> DataFrame:
    """``mapInArrow`` with slices bounded by rows and by bytes, so that a batch of
    very long texts does not set the memory of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = min(rows, batch.num_rows - at)
                while n > 1 and batch.slice(at, n).nbytes > max_bytes:
                    n = (n + 1) // 2
                out = fn(pa.Table.from_batches([batch.slice(at, n)]))
                at += n
                for piece in out.to_batches():
                    if piece.num_rows:
                        yield piece

    return map_arrow(df, run, schema)
