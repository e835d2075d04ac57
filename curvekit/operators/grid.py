"""The planned experiment grid, its coverage by runs, duplicates and counts."""

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvekit import fixed_values as fv
from curvekit.schema import RUN_KEY

BROADCAST_CELLS = 100_000


@dataclass(frozen=True)
class Plan:
    """Lists whose combinations are the planned runs of one architecture."""

    architecture: str
    methods: Sequence[str]
    tasks: Sequence[str]
    models: Sequence[str]
    sizes: Sequence[int]
    seeds: Sequence[int]

    @property
    def cells(self) -> int:
        lists = (self.methods, self.tasks, self.models, self.sizes, self.seeds)
        return math.prod(map(len, lists))


ENCODER_PLAN = Plan(
    "encoder", fv.METHODS, fv.TASKS, fv.ENCODER_MODELS, fv.ENCODER_SIZES, fv.ENCODER_SEEDS
)
DECODER_PLAN = Plan(
    "decoder",
    fv.DECODER_GRID_METHODS,
    fv.DECODER_TASKS,
    fv.DECODER_MODELS,
    fv.DECODER_SIZES,
    fv.DECODER_SEEDS,
)
PLANS = (ENCODER_PLAN, DECODER_PLAN)


def planned_cells(spark: SparkSession, plans: Sequence[Plan] = PLANS) -> DataFrame:
    """One row per planned run: the plan's lists exploded one after the other."""
    rows = [
        (p.architecture, list(p.methods), list(p.models), list(p.tasks), list(p.sizes), list(p.seeds))
        for p in plans
    ]
    cells = spark.createDataFrame(
        rows,
        "architecture string, method array<string>, model_name array<string>, "
        "task_name array<string>, train_subset_size array<bigint>, seed array<bigint>",
    )
    for name in RUN_KEY:
        cells = cells.withColumn(name, F.explode(name))
    return cells


def _bounded(cells: DataFrame, plans: Sequence[Plan]) -> DataFrame:
    """Broadcast planned cells only while their number, known from the lists, is small."""
    return F.broadcast(cells) if sum(p.cells for p in plans) <= BROADCAST_CELLS else cells


def runs_per_cell(runs: DataFrame, plans: Sequence[Plan] = PLANS) -> DataFrame:
    """Planned cells with the number of runs found for each."""
    found = runs.groupBy(*RUN_KEY).agg(F.count(F.lit(1)).alias("n_runs"))
    return (
        planned_cells(runs.sparkSession, plans)
        .join(found, RUN_KEY, "left")
        .withColumn("n_runs", F.coalesce("n_runs", F.lit(0).cast("bigint")))
    )


def missing_cells(runs: DataFrame, plans: Sequence[Plan] = PLANS) -> DataFrame:
    """Planned cells without any run."""
    return planned_cells(runs.sparkSession, plans).join(
        runs.select(*RUN_KEY).distinct(), RUN_KEY, "left_anti"
    )


def off_grid_runs(runs: DataFrame, plans: Sequence[Plan] = PLANS) -> DataFrame:
    """Runs whose cell is not planned; the runs are not shuffled."""
    cells = planned_cells(runs.sparkSession, plans).select(*RUN_KEY)
    return runs.join(_bounded(cells, plans), RUN_KEY, "left_anti")


def duplicate_groups(
    runs: DataFrame, keys: Sequence[str] = tuple(RUN_KEY), order: str = "run_dir"
) -> DataFrame:
    """Configurations with more than one run: how many, and the first and last of them."""
    return (
        runs.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_runs"),
            F.min(order).alias("first_run"),
            F.max(order).alias("last_run"),
        )
        .where("n_runs > 1")
    )


def deduplicate(
    runs: DataFrame,
    keys: Sequence[str] = tuple(RUN_KEY),
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Keep one run per configuration, by default the one with the last run name.

    Runs of the same name are told apart by a hash of their plain columns, so the choice is
    stable; select the columns you need first, as all that are left are read for it.
    Every map task already reduces a configuration to its best row, so even a
    configuration that holds most rows moves only one row per task.
    """
    plain = [name for name, kind in runs.dtypes if "map<" not in kind and kind != "variant"]
    ranking = order or [F.col("run_dir").desc(), F.xxhash64(*plain)]
    best_first = Window.partitionBy(*keys).orderBy(*ranking)
    return (
        runs.withColumn("_rank", F.row_number().over(best_first))
        .where("_rank = 1")
        .drop("_rank")
    )


def duplicate_count(runs: DataFrame, keys: Sequence[str] = tuple(RUN_KEY)) -> DataFrame:
    """One row: all runs, unique configurations, surplus runs."""
    groups = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum("n").alias("n_runs"),
        F.count(F.lit(1)).alias("n_unique"),
        (F.sum("n") - F.count(F.lit(1))).alias("n_surplus"),
    )


def run_counts(runs: DataFrame) -> DataFrame:
    """Runs per architecture and in total (the row of architecture 'all')."""
    return (
        runs.rollup("architecture")
        .agg(F.count(F.lit(1)).alias("n_runs"), F.grouping("architecture").alias("is_total"))
        .select(
            F.when(F.col("is_total") == 1, "all").otherwise(F.col("architecture")).alias("architecture"),
            "n_runs",
        )
    )


def methods_in_order(runs: DataFrame, order: str) -> DataFrame:
    """Distinct methods and where each is first seen."""
    return runs.groupBy("method").agg(F.min(order).alias("first_seen"))
