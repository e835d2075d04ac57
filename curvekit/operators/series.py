"""Figure data as tables: efficiency matrix, method deltas, curves and markers."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvekit import fixed_values as fv
from curvekit.operators.config import method_colour, method_label
from curvekit.operators.curves import error_bars, mean_performance_and_share, ranked_means
from curvekit.operators.fit import fitted_curve
from curvekit.session import materialize


def efficiency(runs: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """Mean performance over mean trainable percentage, per group and sample size."""
    return mean_performance_and_share(runs, keys).withColumn(
        "efficiency", F.col("perf") / (F.col("params") + F.lit(fv.EFFICIENCY_EPSILON))
    )


def efficiency_matrix(
    efficiencies: DataFrame, sizes: Sequence[int] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Methods by sample sizes, both sorted, missing cells null; with display labels.

    Sizes become columns. Without `sizes` they are those of the table, which is then written
    first, since it is read twice. Given sizes must cover all that occur: one that they omit is an
    error in the row that has it. `by` are further group keys; a table with other keys than
    these and `method` has several values for a cell, which is an error, too.
    """
    if sizes is None:
        efficiencies = materialize(efficiencies, "efficiencies")
        sizes = [row["n"] for row in efficiencies.select("n").distinct().collect()]
    ordered = sorted(int(s) if s == int(s) else s for s in sizes)
    known = F.when(F.col("n").isin([float(s) for s in ordered]), F.col("n")).otherwise(
        F.raise_error(F.format_string("no column for size %s", F.col("n"))).cast("double")
    )
    cells = [F.max(F.when(F.col("_n") == s, F.col("efficiency"))).alias(f"n{s}") for s in ordered]
    once = F.when(F.count("_n") == F.count_distinct("_n"), F.lit(True)).otherwise(
        F.raise_error(F.lit("several values for a cell; name the other keys in `by`")).cast("boolean")
    )
    return (
        efficiencies.withColumn("_n", known)
        .groupBy(*by, "method")
        .agg(*cells, once.alias("_once"))
        .where("_once")
        .drop("_once")
        .withColumn("label", method_label())
        .orderBy(*by, "method")
    )


def method_delta(
    curve: DataFrame, method: str, reference: str, by: Sequence[str] = ()
) -> DataFrame:
    """mean(method) - mean(reference) at the sample sizes both have.

    Computed by one grouping of the curve instead of joining it with itself.
    """
    picked = [
        F.max(F.when(F.col("method") == name, F.col("mean"))).alias(column)
        for name, column in ((method, "mean_method"), (reference, "mean_reference"))
    ]
    return (
        curve.where(F.col("method").isin(method, reference))
        .groupBy(*by, "n")
        .agg(*picked)
        .where("mean_method is not null and mean_reference is not null")
        .withColumn("delta", F.col("mean_method") - F.col("mean_reference"))
    )


def delta_bars(delta: DataFrame) -> DataFrame:
    """Delta in percent points and the bucket that colours the bar."""
    gain = F.col("delta") >= 0
    return delta.withColumns(
        {
            "delta_points": F.col("delta") * 100,
            "bucket": F.when(gain, "gain").otherwise("loss"),
        }
    )


def crossover_markers(keyed: DataFrame) -> DataFrame:
    """Vertical markers and their text for crossover rows (pair, n_cross)."""
    return keyed.withColumn("text", F.format_string("N=%.0f", F.rint("n_cross")))


def log_position(series: DataFrame, x: str = "n") -> DataFrame:
    """Position on a logarithmic axis."""
    return series.withColumn("log_x", F.log10(x))


def figure_series(
    curve: DataFrame, fits: DataFrame, keyed: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Observed points, fitted lines, mean-only lines and crossover markers in one table.

    `by` are the group keys besides the method; they come first in every row.
    """
    shown = {"label": method_label(), "colour": method_colour()}
    observed = (
        error_bars(curve)
        .withColumns(shown)
        .selectExpr("'observed' as series", *by, "method", "label", "colour", "n as x", "mean as y", "std as y_error")
    )
    fitted = (
        fitted_curve(fits, [*by, "method"])
        .withColumns(shown)
        .selectExpr("'fitted' as series", *by, "method", "label", "colour", "n as x", "performance as y")
    )
    means = (
        ranked_means(curve, by=by)
        .withColumns(shown)
        .selectExpr("'mean' as series", *by, "method", "label", "colour", "n as x", "mean as y", "draw_order")
    )
    markers = crossover_markers(keyed).selectExpr(
        "'crossover' as series", *by, "pair as method", "n_cross as x", "text"
    )
    together = observed
    for part in (fitted, means, markers):
        together = together.unionByName(part, allowMissingColumns=True)
    return log_position(together, "x")
