"""Student t probabilities against closed forms and a numeric integral in DuckDB."""

import math

import duckdb
import pytest

from curvekit.functions.distributions import beta_fraction, gamma_half_ratio, t_two_sided
from registry.check_sql import t_integral

T = [0.0, 1e-6, 0.1, 1.0, 1.7, 1.74, 2.5, 6.0, 31.0, 200.0, 1e5]
DF = [0.2, 0.5, 0.9, 1.0, 2.0, 3.7, 10.0, 150.0, 1e4]


def probabilities(spark, pairs):
    df = spark.createDataFrame(pairs, "t double, df double")
    return {(r.t, r.df): r.p for r in df.selectExpr("t", "df", f"{t_two_sided('t', 'df')} as p").collect()}


def test_equal_to_a_numeric_integral_in_all_digits_that_matter(spark):
    pairs = [(t, df) for t in T for df in DF]
    got = probabilities(spark, pairs)
    db = duckdb.connect()
    db.execute("create table x (t double, df double)")
    db.executemany("insert into x values (?, ?)", pairs)
    for t, df, want in db.execute(f"with {t_integral('x', 's.t, s.df')} select * from tailed").fetchall():
        assert got[t, df] == pytest.approx(want, rel=1e-6, abs=1e-290), (t, df)


def test_closed_forms_and_ends(spark):
    got = probabilities(spark, [(t, df) for t in T for df in (0.05, 1.0, 2.0, 1e9)])
    for t in T:
        assert got[t, 1.0] == pytest.approx(1 - 2 / math.pi * math.atan(t) if t < 10 else 2 / math.pi * math.atan(1 / t), rel=1e-9)
        root = math.sqrt(2 + t * t)
        assert got[t, 2.0] == pytest.approx(2 / (root * (root + t)), rel=1e-9)
        # The normal tail, but for the first term of the difference, t^4 / (4 df) in relation.
        assert got[t, 1e9] == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-8 + t**4 / 1e9, abs=1e-290)
    falling = [got[t, 0.05] for t in T]
    assert falling == sorted(falling, reverse=True) and falling[0] == 1 and 0.4 < falling[-1] < 1
    # the largest df and t that occur: no overflow, no NaN
    odd = probabilities(spark, [(float("inf"), 3.0), (1e200, 3.0), (-2.0, 5.0), (2.0, 5.0), (1.0, 1e15)])
    assert odd[float("inf"), 3.0] == 0 and odd[1e200, 3.0] == 0
    assert odd[-2.0, 5.0] == odd[2.0, 5.0] == pytest.approx(0.101939478, rel=1e-6)
    assert odd[1.0, 1e15] == pytest.approx(math.erfc(1 / math.sqrt(2)), rel=1e-9)
    none = spark.createDataFrame([(None, 3.0), (1.0, None), (1.0, 0.0), (1.0, -2.0), (float("nan"), 2.0)], "t double, df double")
    assert [r.p for r in none.selectExpr(f"{t_two_sided('t', 'df')} as p").collect()] == [None] * 5


def test_parts(spark):
    ratios = [0.01, 0.3, 1.0, 7.5, 100.0]
    rows = spark.createDataFrame([(a,) for a in ratios], "a double").selectExpr("a", f"{gamma_half_ratio('a')} as r").collect()
    for row in rows:
        assert row.r == pytest.approx(math.gamma(row.a + 0.5) / math.gamma(row.a), rel=1e-11)
    # I_x(a, 1) = x^a, and a * B(a, 1) = 1: the fraction is 1 / (1 - x)
    assert spark.sql(f"select {beta_fraction('0.2D', '2.5D', '1D')} as f").first().f == pytest.approx(1 / 0.8, rel=1e-12)
