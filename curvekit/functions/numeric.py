"""Numeric expressions: missing values, the power law, box-bounded lines, roots.

The longer formulas are SQL expression texts: one parse builds what would otherwise take
hundreds of Column calls, and building the plan is what a small fit spends its time on.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def skip_nan(value: Column | str) -> Column:
    """NaN becomes null, so that aggregates skip both."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value), value)


def error_rate(performance: Column) -> Column:
    return F.lit(1.0) - performance


def power_law(n: str, a: str = "a", b: str = "b", c: str = "c") -> str:
    """Error rate at N as SQL text."""
    return f"{a} * pow({n}, -({b})) + {c}"


def bounded_line(a_box: tuple[float, float], c_box: tuple[float, float]) -> tuple[str, list]:
    """Best line y = a*u + c in a box, as SQL over its moments k, mu, my, suu, syy, suy.

    Returns a select list that names the candidate lines and the list of their squared
    errors paired with (a, c). The problem is convex: the optimum is the free solution if
    it lies in the box, else it lies on an edge, where one parameter is fixed and the
    other is clipped.
    """
    names = ["free"] + [f"edge{i}" for i in range(4)]
    free = "try_divide(suy, suu)"
    slopes = [free]
    offsets = [f"my - {free} * mu"]
    for c in c_box:
        through = f"try_divide(suy + k * mu * (my - {c!r}D), suu + k * mu * mu)"
        slopes.append(f"least(greatest({through}, {a_box[0]!r}D), {a_box[1]!r}D)")
        offsets.append(f"{c!r}D")
    for a in a_box:
        slopes.append(f"{a!r}D")
        offsets.append(f"least(greatest(my - {a!r}D * mu, {c_box[0]!r}D), {c_box[1]!r}D)")
    columns = ", ".join(
        f"{a} as a_{name}, {c} as c_{name}" for name, a, c in zip(names, slopes, offsets)
    )
    inside = (
        f"a_free between {a_box[0]!r}D and {a_box[1]!r}D "
        f"and c_free between {c_box[0]!r}D and {c_box[1]!r}D"
    )
    errors = []
    for name in names:
        a, c = f"a_{name}", f"c_{name}"
        ssr = (
            f"greatest(syy - 2 * {a} * suy + {a} * {a} * suu"
            f" + k * (my - {a} * mu - {c}) * (my - {a} * mu - {c}), 0D)"
        )
        errors.append((f"if({inside}, {ssr}, null)" if name == "free" else ssr, a, c))
    return columns, errors


def sign_change_root(gap, low: str, high: str, steps: int = 80) -> str:
    """Root of `gap` (N text -> SQL text) between two ends, by bisection on ln N, as SQL.

    Null without a sign change or when an end is not a number; an end that is
    itself a root is returned first, the lower end before the upper.
    """
    middle = "(s.lo + s.hi) / 2"
    same = f"signum({gap(f'exp({middle})')}) = signum({gap(low)})"
    span = (
        f"aggregate(sequence(1, {steps}), named_struct('lo', ln({low}), 'hi', ln({high})), "
        f"(s, i) -> if({same}, named_struct('lo', {middle}, 'hi', s.hi), "
        f"named_struct('lo', s.lo, 'hi', {middle})), s -> exp({middle}))"
    )
    return (
        f"case when not coalesce(abs({gap(low)}) < double('inf') "
        f"and abs({gap(high)}) < double('inf'), false) then null "
        f"when {gap(low)} = 0 then {low} when {gap(high)} = 0 then {high} "
        f"when signum({gap(low)}) <> signum({gap(high)}) then {span} end"
    )
