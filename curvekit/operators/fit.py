"""Bounded power-law fits E(N) = a*N^(-b) + c for all groups at once.

For a fixed b the model is a line in u = N^(-b), so a group is solved by profiling b:
a log grid over the range of b, a finer grid around its best value, a parabola through
the three best values, and the exact line for the resulting b. Each step is a grouped
aggregation of (group, b) with partial sums before its exchange; points are dealt out by
group and N, so the trials of one group with very many points are evaluated by many tasks.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvekit import fixed_values as fv
from curvekit.functions.numeric import bounded_line, power_law
from curvekit.session import materialize

COARSE_STEPS = 192
FINE_STEPS = 32
SMALLEST_B = 1e-4
POINTS_PER_TASK = 500  # each point is evaluated for COARSE_STEPS + 2 * FINE_STEPS values of b


@dataclass(frozen=True)
class Bounds:
    """Box of the parameters. b is searched from SMALLEST_B on: a smaller one is a constant curve."""

    a: tuple[float, float] = fv.A_BOUNDS
    b: tuple[float, float] = fv.B_BOUNDS
    c: tuple[float, float] = fv.C_BOUNDS

    @property
    def b_start(self) -> float:
        return max(self.b[0], SMALLEST_B)

    @property
    def log_step(self) -> float:
        return math.log(self.b[1] / self.b_start) / (COARSE_STEPS - 1)


SHIPPED_BOUNDS = Bounds()
SIGNED_OFFSET_BOUNDS = Bounds(c=(-1.0, 1.0))


_MOMENTS = """
    double(count(*)) as k,
    count_if(not coalesce(abs(error) < double('inf') and n > 0, false)) as bad,
    avg(u) as mu, avg(error) as my, var_pop(u) * count(*) as suu,
    var_pop(error) * count(*) as syy, covar_pop(u, error) * count(*) as suy"""


def _profile(trials: str, keys: str, bounds: Bounds) -> str:
    """Smallest squared error per group and trial value of b; unfit groups drop out."""
    lines, errors = bounded_line(bounds.a, bounds.c)
    return f"""
        select {keys}, b, least({", ".join(ssr for ssr, _, _ in errors)}) as ssr
        from (
            select *, {lines} from (
                select {keys}, b, {_MOMENTS}
                from (select *, pow(n, -b) as u from {trials}) group by {keys}, b
            ) where k >= 3 and bad = 0
        )"""


def _best_exponents(keys: str, bounds: Bounds) -> str:
    """CTEs that lead from `points` to `exponents`: the best b of each group."""
    step, fine = bounds.log_step, bounds.log_step / FINE_STEPS
    b_low, b_high = bounds.b_start * (1 - 1e-12), bounds.b[1] * (1 + 1e-12)
    return f"""
        coarse as (
            select *, explode(transform(sequence(0, {COARSE_STEPS - 1}),
                i -> {bounds.b_start!r}D * exp(i * {step!r}D))) as b
            from points
        ), start as (
            select {keys}, min(struct(ssr, b)).b as b0
            from ({_profile("coarse", keys, bounds)}) group by {keys}
        ), near as (
            select * from (
                select *,
                    explode(transform(sequence(-{FINE_STEPS}, {FINE_STEPS}),
                        j -> b0 * exp(j * {fine!r}D))) as b
                from points join start using ({keys})
            ) where b between {b_low!r}D and {b_high!r}D
        ), beside as (
            select *, lag(ssr) over along as below, lead(ssr) over along as above
            from ({_profile("near", keys, bounds)})
            window along as (partition by {keys} order by b)
        ), bent as (
            select {keys}, ssr, b, if(below - 2 * ssr + above > 0,
                greatest(-1D, least(1D, (below - above) / (2 * (below - 2 * ssr + above)))),
                0D) as shift
            from beside
        ), exponents as (
            select {keys}, least(best.b * exp(best.shift * {fine!r}D), {bounds.b[1]!r}D) as b
            from (
                select {keys}, min(struct(ssr, b, shift)) as best from bent group by {keys}
            )
        )"""


def fit_power_law(
    curve: DataFrame,
    keys: Sequence[str] = ("method",),
    bounds: Bounds = SHIPPED_BOUNDS,
    partitions: int | None = None,
) -> DataFrame:
    """One fit per group of a learning curve (columns keys, n, error).

    Returns keys, fit_status, a, b, c, r2, se_a, se_b, se_c, cov_ab, cov_ac, cov_bc, n_points
    and the arrays sample_sizes, error_rates, fitted_values. The covariances are null where
    the standard errors are infinite. A group that cannot be fitted keeps its
    row with null parameters and the reason in `fit_status`; null keys are dropped. A curve that
    is no written table is written first, as every step reads it. The points are spread over
    `partitions` (default: one per POINTS_PER_TASK points, however many that gives) by
    group and N; their bytes say little about the work, so the number is not left to AQE.
    """
    if partitions is None:
        curve = materialize(curve, "curve")
        partitions = max(1, math.ceil(curve.count() / POINTS_PER_TASK))
    keys = list(keys)
    names = ", ".join(f"`{key}`" for key in keys)
    lines, errors = bounded_line(bounds.a, bounds.c)
    candidates = ", ".join(f"struct({ssr} as ssr, {a} as a, {c} as c)" for ssr, a, c in errors[1:])
    free = "struct({} as ssr, {} as a, {} as c)".format(*errors[0])
    return curve.sparkSession.sql(
        f"""
        with points as (
            select {names}, n, error from {{points}}
        ), {_best_exponents(names, bounds)},
        summed as (
            select {names}, {_MOMENTS}, max(b) as b, avg(w) as mw,
                var_pop(w) * count(*) as sww, covar_pop(u, w) * count(*) as suw,
                array_sort(collect_list(struct(n, error))) as points
            from (
                select *,
                    pow(n, -b) as u, pow(n, -b) * ln(n) as w
                from points left join exponents using ({names})
            ) group by {names}
        ), lines as (
            select *, suu * sww - suw * suw as det,
                if(b is null, null, array_min(array({candidates}))) as edge,
                if(b is null, null, {free}) as free
            from (select *, {lines} from summed)
        ), chosen as (
            select *, if(free.ssr <= edge.ssr, free, edge) as line from lines
        ), solved as (
            select *, line.a as a, line.c as c, line.ssr as ssr,
                if(k > 3 and line.a <> 0 and det > 0, line.ssr / (k - 3) / det,
                    double('inf')) as scale
            from chosen
        )
        select {names},
            case when k < 3 then 'too_few_points' when bad > 0 or a is null then 'non_finite'
                when syy = 0 or a = 0 then 'degenerate' else 'ok' end as fit_status,
            a, b, c,
            case when syy > 0 then 1 - ssr / syy when a is not null then 0D end as r2,
            if(a is null, null, sqrt(scale * sww)) as se_a,
            if(a is null, null, sqrt(scale * try_divide(suu, a * a))) as se_b,
            if(a is null, null, if(scale < double('inf'), sqrt(scale * (det / k
                + mu * mu * sww - 2 * mu * mw * suw + mw * mw * suu)), scale)) as se_c,
            if(scale < double('inf'), scale * suw / a, null) as cov_ab,
            if(scale < double('inf'), scale * (mw * suw - mu * sww), null) as cov_ac,
            if(scale < double('inf'), scale * (mw * suu - mu * suw) / a, null) as cov_bc,
            bigint(k) as n_points,
            points.n as sample_sizes, points.error as error_rates,
            if(a is null, null, transform(points, p -> {power_law("p.n")})) as fitted_values
        from solved
        """,
        points=curve.select(*keys, "n", "error").dropna(subset=keys).repartition(partitions, *keys, "n"),
    )


def fit_written_curve(
    curve: DataFrame,
    keys: Sequence[str] = ("method",),
    bounds: Bounds = SHIPPED_BOUNDS,
) -> DataFrame:
    """Fits of a curve that is a written table: counting it is cheap and sets the parallelism."""
    return fit_power_law(curve, keys, bounds, max(1, math.ceil(curve.count() / POINTS_PER_TASK)))


def fitted_curve(
    fits: DataFrame, keys: Sequence[str] = ("method",), points: int = fv.FITTED_CURVE_POINTS
) -> DataFrame:
    """Evenly spaced samples of each fitted curve between its smallest and largest N."""
    low, high = "array_min(sample_sizes)", "array_max(sample_sizes)"
    return (
        fits.where("a is not null")
        .selectExpr(*keys, "a", "b", "c", "sample_sizes", f"explode(sequence(0, {points - 1})) as i")
        .withColumn("n", F.expr(f"{low} + i * ({high} - {low}) / {points - 1}"))
        .selectExpr(*keys, "i", "n", f"1 - ({power_law('n')}) as performance")
    )
