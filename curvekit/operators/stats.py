"""Comparisons of methods with the baseline."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvekit import fixed_values as fv
from curvekit.functions.distributions import t_two_sided
from curvekit.functions.numeric import skip_nan
from curvekit.operators.curves import learning_curve
from curvekit.operators.grid import deduplicate
from curvekit.schema import RUN_KEY

CELL = ("task_name", "model_name")


def welch(
    runs: DataFrame, cell: Sequence[str] = CELL, baseline: str = fv.BASELINE_METHOD
) -> DataFrame:
    """Welch t, degrees of freedom and two-sided p of every method against the baseline per cell and N.

    Works on the curve: a cell of the window has one row per method. Without any deviation
    on both sides t, df and p are null.
    """
    curve = learning_curve(runs, [*cell, "method"])
    peers = Window.partitionBy(*cell, "n")
    base = F.max(
        F.when(F.col("method") == baseline, F.struct("mean", "std", "cnt"))
    ).over(peers)
    return (
        curve.withColumn("base", base)
        .where(F.col("method") != baseline)
        .where("cnt > 1 and base.cnt > 1")
        .selectExpr(
            *cell, "n", "method", "mean - base.mean as difference",
            "std * std / cnt as v", "base.std * base.std / base.cnt as w",
            "cnt", "base.cnt as base_cnt",
        )
        .selectExpr(
            *cell, "n", "method", "difference",
            "try_divide(difference, sqrt(v + w)) as t",
            "try_divide((v + w) * (v + w), v * v / (cnt - 1) + w * w / (base_cnt - 1)) as df",
        )
        .withColumn("p", F.expr(t_two_sided("t", "df")))
    )


def paired_by_seed(
    runs: DataFrame, cell: Sequence[str] = CELL, baseline: str = fv.BASELINE_METHOD
) -> DataFrame:
    """Mean and deviation of method minus baseline over seeds, how often it wins, and the paired t test.

    t, df and the two-sided p are null for a single pair and for differences that are all equal.
    Duplicate runs are removed first, so a (cell, N, seed) has one row per method. Only the
    columns used are read and compared.
    """
    used = list(dict.fromkeys([*RUN_KEY, *cell, "run_dir", "primary_metric"]))
    one_each = deduplicate(runs.select(*used)).select(
        *cell, "train_subset_size", "seed", "method", skip_nan("primary_metric").alias("metric")
    )
    peers = Window.partitionBy(*cell, "train_subset_size", "seed")
    base = F.max(F.when(F.col("method") == baseline, F.col("metric"))).over(peers)
    return (
        one_each.withColumn("difference", F.col("metric") - base)
        .where((F.col("method") != baseline) & F.col("difference").isNotNull())
        .groupBy(*cell, "train_subset_size", "method")
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.avg("difference").alias("mean_difference"),
            F.stddev_samp("difference").alias("sd_difference"),
            F.avg((F.col("difference") > 0).cast("double")).alias("win_rate"),
        )
        .withColumns(
            {
                "t": F.expr("try_divide(mean_difference * sqrt(n_pairs), sd_difference)"),
                "df": F.expr("if(sd_difference > 0, double(n_pairs - 1), null)"),
            }
        )
        .withColumn("p", F.expr(t_two_sided("t", "df")))
    )
