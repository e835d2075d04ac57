"""Tail probabilities as SQL expression texts.

Spark SQL has no gamma, beta or t distribution function. A t probability needs the regularised incomplete beta
function I_x(a, 1/2) only, which is a power times a continued fraction that converges quickly on
its side of the mean, and the ratio of two gamma functions half apart, which has a series.
"""

#: Levels of the continued fraction. On the side of the mean where it is used, so many are enough for
#: ten digits whatever the degrees of freedom (tested from 0.05 to 10**9).
LEVELS = 80
#: Shift of the argument at which the series of the gamma ratio is taken; its error is then below 1e-11.
SHIFT = 16


def gamma_half_ratio(a: str) -> str:
    """Gamma(a + 1/2) / Gamma(a) for a > 0: by its series at a + SHIFT, and the recurrence down from there."""
    z = f"({a} + {SHIFT})"
    terms = "0D"
    # Coefficients of the series in 1/z, from the sixth power down to the first.
    for numerator, denominator in ((869, 4194304), (-399, 262144), (-21, 32768), (5, 1024), (1, 128), (-1, 8)):
        terms = f"(({numerator}D / {denominator}D + {terms}) / {z})"
    down = " * ".join(f"(1 - 0.5D / ({a} + {i}.5D))" for i in range(SHIFT))
    return f"(sqrt({z}) * (1 + {terms}) * {down})"


def beta_fraction(x: str, a: str, b: str, levels: int = LEVELS) -> str:
    """The continued fraction of I_x(a, b) * a * B(a, b) / (x^a (1-x)^b), evaluated from its end."""
    odd = f"-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1))"
    even = f"(m + 1) * ({b} - m - 1) * {x} / (({a} + 2 * m + 1) * ({a} + 2 * m + 2))"
    step = f"1D + ({odd}) / (1D + ({even}) / f)"
    return f"(1D / aggregate(transform(sequence({levels}, 0, -1), i -> double(i)), 1D, (f, m) -> {step}))"


def t_two_sided(t: str, df: str) -> str:
    """P(|T| >= |t|) of Student's t with df > 0 degrees of freedom, also fractional and below 1, as SQL.

    Null where t or df is null, NaN or df is not positive; 0 for an infinite t.
    """
    tail = "try_divide(x.df, x.df + x.t * x.t)"  # I_tail(df/2, 1/2) is the probability
    rest = "(x.t * x.t / (x.df + x.t * x.t))"
    half = "(x.df / 2)"
    # tail^a * rest^(1/2) / B(a, 1/2), without cancellation for large df
    front = (
        f"(exp(-{half} * log1p(x.t * x.t / x.df)) * x.t / sqrt(x.df + x.t * x.t)"
        f" * {gamma_half_ratio(half)} / sqrt(pi()))"
    )
    direct = f"({front} / {half} * {beta_fraction(tail, half, '0.5D')})"
    other = f"(1 - {front} / 0.5D * {beta_fraction(rest, '0.5D', half)})"
    value = (
        f"case when x.t = double('inf') then 0D when x.t * x.t * (x.df + 2) > 3 * x.df then {direct} else greatest({other}, 0D) end"
    )
    usable = f"if(({df}) > 0 and ({t}) is not null and not isnan({t}) and ({df}) < double('inf'), named_struct('t', abs({t}), 'df', double({df})), null)"
    # A one-element array binds x, so that t and df are not copied into every use of them.
    return f"element_at(transform(array({usable}), x -> if(x is null, null, {value})), 1)"
