"""Learning curves: grouped aggregation of runs by sample size."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvekit import fixed_values as fv
from curvekit.functions.numeric import error_rate, skip_nan
from curvekit.session import materialize


def _present(names: Sequence[str]) -> Column:
    return reduce(and_, [F.col(name).isNotNull() for name in names])


def _measures(metric: str) -> list[Column]:
    value = skip_nan(F.col(metric).cast("double"))
    return [
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.count(value).alias("cnt"),
    ]


def learning_curve(
    runs: DataFrame,
    keys: Sequence[str] = ("method",),
    size: str = "train_subset_size",
    metric: str = "primary_metric",
) -> DataFrame:
    """Mean, sample deviation, count and error rate per group and sample size.

    Rows with a null key are dropped and null or NaN metrics skipped. Partial
    aggregation leaves one row per (keys, N) and map task, however skewed the keys.
    """
    return (
        runs.where(_present([*keys, size]))
        .groupBy(*keys, F.col(size).cast("double").alias("n"))
        .agg(*_measures(metric))
        .withColumn("error", error_rate(F.col("mean")))
    )


def learning_curve_levels(
    runs: DataFrame,
    levels: Sequence[Sequence[str]] = (("method",), ("architecture", "method")),
    size: str = "train_subset_size",
    metric: str = "primary_metric",
) -> DataFrame:
    """Curves at several grouping levels in one pass; `level` names the keys used.

    A run without a key is left out of the levels that use this key, and of no other.
    """
    keys = list(dict.fromkeys(k for level in levels for k in level))
    clean = runs.where(_present([size])).select(*keys, F.col(size).cast("double").alias("n"), metric)
    whole = reduce(and_, [(F.grouping(k) == 1) | F.col(k).isNotNull() for k in keys])
    level = F.concat_ws(
        "+", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys]
    )
    return (
        clean.groupingSets([[F.col(k) for k in [*lv, "n"]] for lv in levels], *keys, "n")
        .agg(level.alias("level"), whole.alias("_whole"), *_measures(metric))
        .where("_whole")
        .drop("_whole")
        .withColumn("error", error_rate(F.col("mean")))
    )


def error_bars(curve: DataFrame) -> DataFrame:
    """Points with error bars: the curve without counts and error rate."""
    return curve.drop("cnt", "error")


def ranked_means(
    curve: DataFrame,
    order: Sequence[str] = tuple(fv.FIGURE_METHOD_ORDER),
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean-only curves of the listed methods, with their drawing position (baseline last)."""
    position = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    return (
        curve.where(F.col("method").isin(*order))
        .select(*by, "method", "n", "mean", position.cast("int").alias("draw_order"))
    )


def mean_performance_and_share(
    runs: DataFrame,
    keys: Sequence[str] = ("method",),
    size: str = "train_subset_size",
) -> DataFrame:
    """Mean performance and mean trainable percentage per group and sample size."""
    return (
        runs.where(_present([*keys, size]))
        .groupBy(*keys, F.col(size).cast("double").alias("n"))
        .agg(
            F.avg(skip_nan("primary_metric")).alias("perf"),
            F.avg(skip_nan("trainable_percentage")).alias("params"),
        )
    )


#: Powers of two that share a bin of an exact sum, and the smallest bin; smaller values lose digits there.
_BIN, _LEAST_BIN = 8, -118


def _exact_total(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum of a double column per group whose last bit depends on the rows alone, not on their order.

    Rows are binned by magnitude. In a bin all values are integers of at most 62 bits times one power
    of two, so their partial sums are exact; only the few bins of a group are added as doubles, in order.
    """
    x = F.col(value)
    size = F.floor(F.log2(F.abs(x)) / _BIN)
    bin_ = F.when(x == 0, _LEAST_BIN).otherwise(F.greatest(size, F.lit(_LEAST_BIN))).cast("int")
    units = (x * F.pow(F.lit(2.0), 54 - _BIN * F.col("_bin"))).cast("bigint").cast("decimal(20,0)")
    sums = (
        rows.where(F.abs(x) < float("inf"))
        .withColumn("_bin", bin_)
        .groupBy(*keys, "_bin")
        .agg(F.sum(units).alias("_units"), F.count(F.lit(1)).alias("_rows"))
    )
    part = F.col("_units").cast("double") * F.pow(F.lit(2.0), _BIN * F.col("_bin") - 54)
    parts = F.array_sort(F.collect_list(F.struct("_bin", part.alias("part"))))
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["part"])
    return sums.groupBy(*keys).agg(total.alias("total"), F.sum("_rows").alias("cnt"))


def exact_learning_curve(
    runs: DataFrame,
    keys: Sequence[str] = ("method",),
    size: str = "train_subset_size",
    metric: str = "primary_metric",
) -> DataFrame:
    """learning_curve() whose values are the same to the last bit however the runs are partitioned.

    Means come from exact sums. Deviations come from exact sums of squared distances to the mean, so the runs are
    read twice, the second time with the (small) table of means. Infinite metrics are left out of the moments, as null
    and NaN are; a point without any finite metric has null moments and a count of 0.
    """
    value = skip_nan(F.col(metric).cast("double"))
    points = runs.where(_present([*keys, size])).select(*keys, F.col(size).cast("double").alias("n"), value.alias("_x"))
    by = [*keys, "n"]
    means = _exact_total(points, by, "_x").withColumn("mean", F.col("total") / F.col("cnt")).select(*by, "mean", "cnt")
    means = materialize(means, "exact-means")
    distance = F.col("_x") - F.col("mean")
    squares = _exact_total(points.join(means, by).withColumn("_square", distance * distance), by, "_square")
    spread = squares.select(*by, F.col("total").alias("_squares"))
    std = F.when(F.col("cnt") > 1, F.sqrt(F.col("_squares") / (F.col("cnt") - 1)))
    return (
        points.select(*by).distinct()
        .join(means, by, "left")
        .join(spread, by, "left")
        .select(*by, "mean", std.alias("std"), F.coalesce("cnt", F.lit(0).cast("bigint")).alias("cnt"))
        .withColumn("error", error_rate(F.col("mean")))
    )
