"""Key-based pairings that replace the reference's positional alignment."""
from __future__ import annotations

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netwarden.operators.detect import combine_verdicts
from netwarden.schema import SEVERITY_ORDER
from netwarden.sources.local import local_table


#: What a job that checks its alignment ends with.
AlignmentError = SparkRuntimeException


def align_predictions(predictions: DataFrame, flows: DataFrame, key: str = "row_id",
                      check: bool = True, complete: bool = False) -> DataFrame:
    """Predictions with their flow rows, joined on the row key.

    With ``check`` (the key-based form of a length check) the same join asserts that predictions match flows one
    to one: a prediction without a flow, a key that is missing or occurs twice on a side, and with
    ``complete`` a flow without a prediction, stops the job with an ``AlignmentError``. Rows of a key are counted in the
    join's own partitions: no further exchange, no job before it."""
    if not check:
        return predictions.join(flows, key, "inner")
    per_key = Window.partitionBy(key)
    p = predictions.withColumn("_np", F.count(F.lit(1)).over(per_key))
    f = flows.withColumn("_nf", F.count(F.lit(1)).over(per_key))
    k = F.coalesce(F.col(key).cast("string"), F.lit("NULL"))
    wrong = (F.when(F.col(key).isNull(), F.lit("a row without a key"))
             .when(F.col("_nf").isNull(), F.concat(F.lit("prediction without a flow row: "), k))
             .when(F.col("_np").isNull(), F.concat(F.lit("flow row without a prediction: "), k))
             .when(F.col("_np") > 1, F.concat(F.lit("several predictions for one row: "), k))
             .when(F.col("_nf") > 1, F.concat(F.lit("several flow rows with one key: "), k)))
    joined = p.join(f, key, "full_outer" if complete else "left").withColumn("_wrong", wrong)
    checked = joined.where(F.when(F.col("_wrong").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("_wrong")).cast("boolean")))
    return checked.drop("_np", "_nf", "_wrong")


#: Bits of the key filter: its table has at most FILTER_BITS / 8 bytes (16 MB), whatever the number of keys.
FILTER_BITS = 1 << 27


def reduce_by_keys(rows: DataFrame, keys: DataFrame, key: str = "row_id") -> DataFrame:
    """The rows whose key may occur among the keys: all that do, and of the others those whose hash meets one
    of the keys' (at most keys / 2^27 of them). Nothing is exchanged but the filter, a bitmap over key hashes of
    fixed size that is broadcast; rows with a null key go. Join by the key afterwards."""
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS)) + 1
    bitmap = keys.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.col("_bucket").isNotNull() & (F.getbit(byte, (at % 8).cast("int")) == 1)
    found = rows.where(F.col(key).isNotNull()).withColumn("_bucket", F.bitmap_bucket_number(bit)) \
        .join(F.broadcast(bitmap), "_bucket").where(hit)
    return found.select(*[F.col(f"`{c}`") for c in rows.columns])


def assemble_detections(rf: DataFrame, iso: DataFrame, key: str = "row_id",
                        mode: str = "combined") -> DataFrame:
    """Forest and isolation results scored in separate jobs, joined on the key."""
    return combine_verdicts(rf.join(iso, key, "inner"), mode)


def lookup_severity_rank(df: DataFrame, col: str = "severity") -> DataFrame:
    """Dictionary lookup as a broadcast join of a fixed four-row table."""
    dim = local_table(df.sparkSession, [(s, i) for i, s in enumerate(SEVERITY_ORDER)],
                      f"{col} string, severity_rank int")
    return df.join(F.broadcast(dim), col, "left")
