"""Deterministic nested training subsets.

A seed gives every example a place: the order of md5(seed:id). The first N places are the
subset of size N, so subsets of one seed are nested. Places are counted per hash range:
a histogram over ranges tells how many examples precede a range, ranks are needed only
inside a range, and ranges beyond the largest N are never shuffled. While a needed range
is too large for one task, the needed ranges are split again, so a task that holds most of
the rows is spread over as many ranges as it takes.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvekit.session import materialize

FIRST_DIGITS = 2  # hex digits of the hash that name a range: 256 ranges per task and seed
MOST_DIGITS = 8
RANGE_ROWS = 1_000_000  # a range of this many rows is ranked by one task

GROUP = ["task", "seed"]


def _histogram(keyed: DataFrame) -> DataFrame:
    """Rows per hash range and how many rows of the group precede it."""
    upto = Window.partitionBy(*GROUP).orderBy("range")
    before = F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    return materialize(
        keyed.groupBy(*GROUP, "range")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(before, F.lit(0))),
        "hash-ranges",
    )


def placed(
    examples: DataFrame, seeds: Sequence[int], largest: int, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Place (from 1) of every example per seed, up to `largest`, and the split size.

    `examples` has columns task and example_id. Returns task, seed, example_id, place,
    split_size. The histograms are written tables, so the planner knows their size and
    broadcasts them to filter the scan only when they are small.
    """
    digits = FIRST_DIGITS
    keyed = (
        examples.select("task", "example_id")
        .withColumn("seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])))
        .withColumn("hash", F.md5(F.concat_ws(":", "seed", "example_id")))
        .withColumn("range", F.substring("hash", 1, digits))
    )
    ranges = _histogram(keyed)
    sizes = ranges.groupBy(*GROUP).agg(F.sum("n").alias("split_size"))
    needed = ranges.where(F.col("before") < largest)
    while digits < MOST_DIGITS and (needed.agg(F.max("n")).first()[0] or 0) > range_rows:
        digits += 2
        keyed = keyed.join(needed.select(*GROUP, "range"), [*GROUP, "range"], "left_semi")
        keyed = keyed.withColumn("range", F.substring("hash", 1, digits))
        needed = _histogram(keyed).where(F.col("before") < largest)
    within = Window.partitionBy(*GROUP, "range").orderBy("hash", "example_id")
    return (
        keyed.join(needed.join(sizes, GROUP).drop("n"), [*GROUP, "range"])
        .withColumn("place", F.col("before") + F.row_number().over(within))
        .where(F.col("place") <= largest)
        .select(*GROUP, "example_id", "place", "split_size")
    )


def seeded_subset(examples: DataFrame, seed: int, size: int) -> DataFrame:
    """The first min(size, split size) examples of each task in the order of the seed.

    A size of at least the split size keeps the whole split. The requested size stays in
    `train_subset_size`; `effective_n` is the number of examples really there.
    """
    return placed(examples, [seed], size).select(
        "task",
        "seed",
        "example_id",
        "place",
        F.lit(size).cast("bigint").alias("train_subset_size"),
        F.least(F.lit(size), "split_size").alias("effective_n"),
    )


def subset_grid(examples: DataFrame, seeds: Sequence[int], sizes: Sequence[int]) -> DataFrame:
    """Subsets of all seeds and sizes from one ranking."""
    requested = F.explode(F.array(*[F.lit(n).cast("bigint") for n in sizes]))
    return (
        placed(examples, seeds, max(sizes))
        .withColumn("train_subset_size", requested)
        .where("place <= train_subset_size")
        .withColumn("effective_n", F.least("train_subset_size", "split_size"))
        .drop("split_size")
    )


def evaluation_split(examples: DataFrame) -> DataFrame:
    """All validation examples."""
    return examples.where(F.col("split") == "validation")
