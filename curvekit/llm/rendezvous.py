"""Sharding by rendezvous hashing: the key and the list of shards decide, nothing else."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_PER_BUCKET = 50_000


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard that wins for the key: the largest -weight / ln(u), u = hash of (key, shard) in (0, 1).

    A shard of weight w gets the share w / sum(weights) of the keys. A shard added at the
    end takes keys from the others and moves none between them. Ties go to the lowest shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scored = F.transform(
        F.array(*[F.lit(float(w)) for w in weights]),
        lambda w, i: F.struct(
            (-w / F.ln((F.shiftrightunsigned(F.xxhash64(key, i), 11) + F.lit(0.5)) / F.lit(2.0**53))),
            -i,
        ),
    )
    return (-F.array_max(scored)["col2"]).cast("int")


def with_slots(rows: DataFrame, shard: str = "shard", key: str = "doc_id", tie: Sequence[str] = ()) -> DataFrame:
    """Add `slot`, the gapless place of each row in its shard.

    A shard is cut into hash buckets, their number growing with the number of rows; places
    count inside a bucket and start behind the buckets before it. No task sees a whole shard.
    Rows equal in key and ties are interchangeable, so any order among them is the same result.
    """
    buckets = max(1, -(-rows.count() // ROWS_PER_BUCKET))
    cut = rows.withColumn("_bucket", F.pmod(F.xxhash64(key, *tie), F.lit(buckets)))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(F.col(shard).alias("_shard"), F.col("_bucket").alias("_place"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumnRenamed("_place", "_bucket")
        .select("_shard", F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(shard, "_bucket").orderBy(key, *tie)
    placed = cut.withColumn("_row", F.row_number().over(inside) - 1)
    return placed.join(
        starts, (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_of"))
    ).withColumn("slot", (F.col("_start") + F.col("_row")).cast("long")).drop(
        "_bucket", "_row", "_shard", "_of", "_start"
    )


def assign_shards(
    docs: DataFrame,
    weights: Sequence[float],
    grown_weight: float = 1.0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Place every row: key, size, text_crc32, law, shard, slot, grown_shard (with one shard more).

    size is the text's UTF-8 bytes plus 1; a null text counts as empty (size 1, crc 0). Null
    keys hash like any other key and share one shard, as do repeated keys. An empty table
    gives no rows. Columns of `docs` other than key and text are not read.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(value) + F.lit(1)).cast("long").alias("size"),
        F.crc32(value).alias("text_crc32"),
    )
    placed = sized.select(
        "*",
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"),
    )
    return with_slots(placed, tie=["text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
