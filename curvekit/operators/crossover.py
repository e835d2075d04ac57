"""Sample sizes at which two fitted error curves are equal."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvekit import fixed_values as fv
from curvekit.functions.numeric import power_law, sign_change_root, skip_nan
from curvekit.operators.fit import SHIPPED_BOUNDS, Bounds
from curvekit.operators.fit_batch import fit_many_groups
from curvekit.session import materialize

#: Standard deviations that hold 95 % of a normal distribution.
TWO_SIDED_95 = 1.959963984540054
#: Values that a quantile sketch tells apart.
QUANTILE_ACCURACY = 10_000


def error_gap(n: str, left: str = "fit", right: str = "base") -> str:
    """Difference of two fitted error curves (structs a, b, c) at N, as SQL text."""
    curves = [power_law(n, f"{fit}.a", f"{fit}.b", f"{fit}.c") for fit in (left, right)]
    return f"(({curves[0]}) - ({curves[1]}))"


def with_baseline(
    fits: DataFrame,
    by: Sequence[str] = (),
    baseline: str = fv.BASELINE_METHOD,
    more: Sequence[str] = (),
) -> DataFrame:
    """Pair every other fit with the baseline fit of its group, as structs fit and base.

    The structs hold a, b, c and the columns `more`. `fits` has one baseline row per group and is best a written table, for it is read
    twice. Without groups that row is a scalar; with groups it is joined by them. Groups
    without a usable baseline give no row.
    """
    usable = fits.where(F.col("a").isNotNull()).select(
        *by, "method", F.struct("a", "b", "c", *more).alias("fit")
    )
    base = usable.where(F.col("method") == baseline).select(*by, F.col("fit").alias("base"))
    others = usable.where(F.col("method") != baseline)
    if by:
        return others.join(base, list(by))
    # Exploding a one-element array keeps the scalar from being copied into every use of it.
    return (
        others.withColumn("bases", F.array(base.scalar()))
        .withColumn("base", F.explode("bases"))
        .drop("bases")
        .where(F.col("base").isNotNull())
    )


def crossovers(
    fits: DataFrame,
    by: Sequence[str] = (),
    baseline: str = fv.BASELINE_METHOD,
    low: float = fv.CROSSOVER_RANGE[0],
    high: float = fv.CROSSOVER_RANGE[1],
) -> DataFrame:
    """Crossover of every method with the baseline on [low, high].

    n_cross is null without a sign change. Identical curves agree everywhere: they yield
    the left end and are flagged as degenerate.
    """
    return with_baseline(fits, by, baseline).select(
        *by,
        "method",
        F.lit(baseline).alias("baseline"),
        F.expr(sign_change_root(error_gap, f"{low!r}D", f"{high!r}D")).alias("n_cross"),
        F.expr("fit = base").alias("degenerate"),
    )


def sign_changes(
    fits: DataFrame,
    by: Sequence[str] = (),
    baseline: str = fv.BASELINE_METHOD,
    low: float = fv.CROSSOVER_RANGE[0],
    high: float = fv.CROSSOVER_RANGE[1],
) -> DataFrame:
    """The bracket test on its own: error gaps at both ends and whether they differ in sign."""
    gaps = [
        F.expr(error_gap(f"{end!r}D")).alias(name)
        for end, name in ((low, "gap_low"), (high, "gap_high"))
    ]
    return (
        with_baseline(fits, by, baseline)
        .select(*by, "method", *gaps)
        .withColumn("changes_sign", F.col("gap_low") * F.col("gap_high") <= 0)
    )


def crossover_keys(found: DataFrame) -> DataFrame:
    """Result keys `<method>_vs_<baseline>`; pairs without a crossover are left out."""
    others = [c for c in found.columns if c not in ("method", "baseline", "n_cross", "degenerate")]
    return found.where(F.col("n_cross").isNotNull()).select(
        *others, F.concat("method", F.lit("_vs_"), "baseline").alias("pair"), "n_cross"
    )


_SPREAD = ("se_a", "se_b", "se_c", "cov_ab", "cov_ac", "cov_bc")


def _curve_variance(fit: str, log_n: str) -> str:
    """Variance of a fitted curve's value at N, from the covariance of its parameters, as SQL.

    The gradient over (a, b, c) is (u, -a*u*ln N, 1) with u = N^(-b).
    """
    u = f"exp(-({fit}.b) * {log_n})"
    v = f"(-({fit}.a) * {log_n} * {u})"
    squares = (
        f"{u} * {u} * {fit}.se_a * {fit}.se_a + {v} * {v} * {fit}.se_b * {fit}.se_b"
        f" + {fit}.se_c * {fit}.se_c"
    )
    mixed = f"{u} * {v} * {fit}.cov_ab + {u} * {fit}.cov_ac + {v} * {fit}.cov_bc"
    return f"if({fit}.cov_ab is null, double('inf'), greatest({squares} + 2 * ({mixed}), 0D))"


def _curve_slope(fit: str, log_n: str) -> str:
    """Derivative of a fitted curve by ln N, as SQL."""
    return f"(-({fit}.a) * {fit}.b * exp(-({fit}.b) * {log_n}))"


def crossover_uncertainty(
    fits: DataFrame,
    by: Sequence[str] = (),
    baseline: str = fv.BASELINE_METHOD,
    low: float = fv.CROSSOVER_RANGE[0],
    high: float = fv.CROSSOVER_RANGE[1],
    deviations: float = TWO_SIDED_95,
    every_root: bool = False,
) -> DataFrame:
    """Crossovers with the standard error of ln N and the bounds `deviations` of it away.

    Where the gap g(ln N; both fits) is zero, ln N moves by -dg/d(parameters) / (dg/d ln N), so
    its variance is that of g over the squared slope of g. The fits are independent of each
    other, their parameters are not: the whole covariance of each is used. Returns by,
    method, baseline, n_cross, degenerate, gap_slope (by ln N), se_log_n, n_low and n_high, for the
    one root of crossovers() or, with `every_root`, for all of all_crossovers().

    A fit of three points has no residual left: se_log_n is infinite, n_low 0 and n_high infinite.
    Without a crossover, for curves that touch without crossing and for identical curves, they are null.
    """
    find = _all_roots if every_root else _one_root
    paired = find(with_baseline(fits, by, baseline, _SPREAD), low, high)
    return (
        paired.selectExpr(
            *[f"`{key}`" for key in by], "method", f"'{baseline}' as baseline", "n_cross", "degenerate",
            f"({_curve_slope('fit', 'ln(n_cross)')} - {_curve_slope('base', 'ln(n_cross)')}) as gap_slope",
            f"sqrt({_curve_variance('fit', 'ln(n_cross)')} + {_curve_variance('base', 'ln(n_cross)')}) as se_gap",
        )
        .withColumn("se_log_n", F.expr("if(degenerate, null, try_divide(se_gap, abs(gap_slope)))"))
        .drop("se_gap")
        .withColumns(
            {
                "n_low": F.expr(f"n_cross * exp(-{deviations!r}D * se_log_n)"),
                "n_high": F.expr(f"n_cross * exp({deviations!r}D * se_log_n)"),
            }
        )
    )


_SAME = "fit.a = base.a and fit.b = base.b and fit.c = base.c"


def _one_root(paired: DataFrame, low: float, high: float) -> DataFrame:
    """n_cross and degenerate beside fit and base: the root that crossovers() finds."""
    root = sign_change_root(error_gap, f"{low!r}D", f"{high!r}D")
    return paired.withColumns({"n_cross": F.expr(root), "degenerate": F.expr(_SAME)})


def all_crossovers(
    fits: DataFrame,
    by: Sequence[str] = (),
    baseline: str = fv.BASELINE_METHOD,
    low: float = fv.CROSSOVER_RANGE[0],
    high: float = fv.CROSSOVER_RANGE[1],
) -> DataFrame:
    """Every crossover in the range: the gap has at most one turning point, so at most two.

    Curves with the same parameters meet everywhere: their row is flagged `degenerate`.
    """
    return _all_roots(with_baseline(fits, by, baseline), low, high).select(
        *by, "method", F.lit(baseline).alias("baseline"), "n_cross", "degenerate"
    )


def _all_roots(paired: DataFrame, low: float, high: float) -> DataFrame:
    """A row with n_cross and degenerate beside fit and base for every root."""
    turn = (
        "pow(try_divide(fit.a * fit.b, base.a * base.b), try_divide(1D, fit.b - base.b))"
    )
    ends = {"lo": f"{low!r}D", "hi": f"{high!r}D"}
    spans = (
        "if(turn between {lo} and {hi}, array(named_struct('lo', {lo}, 'hi', turn), "
        "named_struct('lo', turn, 'hi', {hi})), array(named_struct('lo', {lo}, 'hi', {hi})))"
    ).format(**ends)
    return (
        paired.withColumn("turn", F.expr(turn))
        .withColumn("span", F.expr(f"explode({spans})"))
        .withColumn("n_cross", F.expr(sign_change_root(error_gap, "span.lo", "span.hi")))
        .withColumn("degenerate", F.expr(_SAME))
        .drop("turn", "span")
        .where(F.col("n_cross").isNotNull())
        .distinct()
    )


def crossover_spread(
    runs: DataFrame,
    baseline: str = fv.BASELINE_METHOD,
    bounds: Bounds = SHIPPED_BOUNDS,
    size: str = "train_subset_size",
    metric: str = "primary_metric",
) -> DataFrame:
    """Range and quantiles of each crossover when one seed at a time is left out.

    The runs are read once: sums per (method, N, seed), joined to those per (method, N), give
    every leave-one-out mean, a row each, and all refits are made in batches, so the number of seeds is not
    limited by any row or task. n_median is exact; n_05 and n_95 come from a mergeable sketch whose ranks are
    within 1 / QUANTILE_ACCURACY of the asked ones (exact up to that many refits).
    """
    curve = materialize(leave_one_out(runs, size, metric), "leave-one-out-curves")
    fits = materialize(fit_many_groups(curve, ["held_out", "method"], bounds), "leave-one-out-fits")
    return (
        crossovers(fits, ["held_out"], baseline)
        .groupBy("method")
        .agg(
            F.count(F.lit(1)).alias("n_refits"),
            F.count("n_cross").alias("n_found"),
            F.min("n_cross").alias("n_min"),
            F.percentile_approx("n_cross", 0.05, QUANTILE_ACCURACY).alias("n_05"),
            F.percentile("n_cross", F.lit(0.5)).alias("n_median"),
            F.percentile_approx("n_cross", 0.95, QUANTILE_ACCURACY).alias("n_95"),
            F.max("n_cross").alias("n_max"),
        )
    )


def leave_one_out(runs: DataFrame, size: str = "train_subset_size", metric: str = "primary_metric") -> DataFrame:
    """Learning curves (held_out, method, n, error) without the runs of one seed, for every seed of the runs.

    A method without runs of a seed keeps its whole curve there; points that only this seed has are absent.
    """
    value = skip_nan(metric)
    present = F.col("method").isNotNull() & F.col(size).isNotNull() & F.col("seed").isNotNull()
    own = materialize(
        runs.where(present)
        .groupBy("method", F.col(size).cast("double").alias("n"), "seed")
        .agg(F.sum(value).alias("own_s"), F.count(value).alias("own_k")),
        "seed-sums",
    )
    cells = materialize(
        own.groupBy("method", "n").agg(F.sum("own_s").alias("s"), F.sum("own_k").alias("k")), "cell-sums"
    )
    methods = cells.select(F.collect_set("method")).scalar()  # as many as there are methods, not seeds
    held = own.select("seed").distinct().withColumn("method", F.explode(methods))
    left_k = F.col("k") - F.coalesce("own_k", F.lit(0))
    left_s = F.coalesce("s", F.lit(0.0)) - F.coalesce("own_s", F.lit(0.0))
    return (
        held.join(cells, "method")
        .join(own, ["method", "n", "seed"], "left")
        .where(left_k > 0)
        .select(F.col("seed").alias("held_out"), "method", "n", (1 - left_s / left_k).alias("error"))
    )
