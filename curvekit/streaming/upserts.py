"""A table kept by upserts: every batch writes the rows it changed, and readers take the newest of each key.

Changes are folders `level=l/slot=s`. A batch writes one folder of level 0. After every MERGE folders of a level
these are merged into one folder of the next, as carrying a digit: a version is made of the folders that the digits of its
number name, fewer than MERGE on each level. A batch thus writes its own changes, and now and then those of the
last 8, 64, ... batches once more; never the whole table because it is large. Slots are reused, so the number of files
does not grow with the number of batches, and a folder stays for a whole turn after it has been merged, for
readers under way.

Writing a batch again after a failure replaces its own folders, so each batch counts once. The number of the
newest whole version is kept in two small folders, written by turns: one of them is always whole.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders merged into one, and slots of a level: a slot is written again a whole turn after its merge.
MERGE, SLOTS = 8, 16
VERSION = "_version"
_PUBLISHED = "_published"


def publish(spark: SparkSession, target: str, version: int) -> None:
    """Name `version` as whole. The other folder holds the one before, should this write be under way."""
    named = spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
    named.coalesce(1).write.mode("overwrite").parquet(f"{target}/{_PUBLISHED}/turn={version % 2}")


def published(spark: SparkSession, target: str) -> int:
    """The newest whole version."""
    return spark.read.schema("version bigint").parquet(f"{target}/{_PUBLISHED}").agg(F.max("version")).first()[0]


def _folder(target: str, level: int, number: int) -> str:
    return f"{target}/level={level}/slot={number % SLOTS}"


def _folders(target: str, version: int) -> list[str]:
    """The folders that make up a version: on each level those after its last merge."""
    found, level, done = [], 0, version + 1
    while done:
        found += [_folder(target, level, number) for number in range(done // MERGE * MERGE, done)]
        level, done = level + 1, done // MERGE
    return found


def _newest(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in changes.columns if c not in keys]
    newest = F.max_by(F.struct(*values), VERSION).alias("_row")
    return changes.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])


def upsert(changes: DataFrame, target: str, keys: Sequence[str], version: int) -> None:
    """Write the changed rows of a version (0, 1, 2, ...), one row per key, and merge what its number completes.

    The rows are not readable as this version before publish().
    """
    spark, schema = changes.sparkSession, None
    numbered = changes.withColumn(VERSION, F.lit(version).cast("bigint"))
    numbered.write.mode("overwrite").parquet(_folder(target, 0, version))
    level, number = 0, version
    while (number + 1) % MERGE == 0:
        schema = schema or numbered.schema
        parts = [_folder(target, level, number - i) for i in range(MERGE)]
        level, number = level + 1, number // MERGE
        merged = _newest(spark.read.schema(schema).parquet(*parts), keys)
        merged.write.mode("overwrite").parquet(_folder(target, level, number))


def rows_of(spark: SparkSession, target: str, keys: Sequence[str], version: int | None = None) -> DataFrame:
    """The whole table in its newest (or a given, not much older) version."""
    version = published(spark, target) if version is None else version
    return _newest(_read(spark, target, version), keys).drop(VERSION)


def changes_of(spark: SparkSession, target: str, version: int) -> DataFrame:
    """All rows that a version is made of, of which the newest of a key counts."""
    return _read(spark, target, version).drop(VERSION)


def _read(spark: SparkSession, target: str, version: int) -> DataFrame:
    return spark.read.parquet(*_folders(target, version))


def changed_in(spark: SparkSession, target: str, version: int) -> DataFrame:
    """The rows that a version (the newest, or one of the last turn) changed."""
    return spark.read.parquet(_folder(target, 0, version)).drop(VERSION)
