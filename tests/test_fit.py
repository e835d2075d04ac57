import itertools
import math
import random

import numpy as np
import pytest

from curvekit.operators import fit as L

SIZES = [50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0]


def curve_rows(group, a, b, c, noise=lambda n: 0.0, sizes=SIZES):
    return [(group, n, a * n**-b + c + noise(n)) for n in sizes]


def frame(spark, rows):
    return spark.createDataFrame(rows, "method string, n double, error double")


def squared_error(rows, a, b, c):
    return sum((y - (a * n**-b + c)) ** 2 for _, n, y in rows)


def test_recovers_noise_free_curves(spark):
    truth = {"x": (1.169, 0.251, 0.087), "y": (1.168, 0.253, 0.09), "z": (2.4, 0.42, 0.08)}
    data = [row for g, p in truth.items() for row in curve_rows(g, *p)]
    for fit in L.fit_power_law(frame(spark, data)).collect():
        assert fit.fit_status == "ok"
        assert (fit.a, fit.b, fit.c) == pytest.approx(truth[fit.method], abs=1e-3)
        assert fit.r2 == pytest.approx(1.0, abs=1e-9)
        assert fit.sample_sizes == SIZES
        assert fit.fitted_values == pytest.approx(fit.error_rates, abs=1e-5)


def test_squared_error_is_minimal_in_the_box(spark):
    draw = random.Random(5)
    data = {}
    for g in range(25):
        p = (draw.uniform(0.2, 3), draw.uniform(0.02, 1.5), draw.uniform(0, 0.5))
        data[f"g{g}"] = curve_rows(f"g{g}", *p, noise=lambda n: draw.gauss(0, 0.02))
    fits = L.fit_power_law(frame(spark, [r for rows in data.values() for r in rows])).collect()
    assert len(fits) == 25
    b_grid = np.exp(np.linspace(math.log(1e-4), math.log(5), 1500))
    for fit in fits:
        rows = data[fit.method]
        assert 0 <= fit.a <= 100 and 0 < fit.b <= 5 and 0 <= fit.c <= 1
        best = squared_error(rows, fit.a, fit.b, fit.c)
        # Brute force: for every b and every c of a grid the best a has a closed form.
        n, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        u = n[None, :] ** -b_grid[:, None]
        for c in np.linspace(0, 1, 201):
            a = np.clip((u * (y - c)).sum(1) / (u * u).sum(1), 0, 100)
            others = ((y - a[:, None] * u - c) ** 2).sum(1)
            assert best <= others.min() + 1e-9
        for da, db, dc in itertools.product((-1e-3, 0, 1e-3), repeat=3):
            a, b, c = fit.a + da, fit.b + db, fit.c + dc
            if 0 <= a <= 100 and 0 < b <= 5 and 0 <= c <= 1:
                assert best <= squared_error(rows, a, b, c) + 1e-9


def test_statuses_keep_their_rows(spark):
    nan = float("nan")
    data = (
        curve_rows("ok", 1.0, 0.3, 0.1)
        + curve_rows("two", 1.0, 0.3, 0.1, sizes=[50.0, 100.0])
        + [("nan", 50.0, nan), ("nan", 100.0, 0.4), ("nan", 200.0, 0.3)]
        + [("null", 50.0, None), ("null", 100.0, 0.4), ("null", 200.0, 0.3)]
        + [("zero", 0.0, 0.5), ("zero", 100.0, 0.4), ("zero", 200.0, 0.3)]
        + [("flat", n, 0.25) for n in SIZES]
        + [("rising", n, 0.1 + n / 10000) for n in SIZES]
    )
    fits = {f.method: f for f in L.fit_power_law(frame(spark, data)).collect()}
    status = {m: f.fit_status for m, f in fits.items()}
    assert status == {
        "ok": "ok",
        "two": "too_few_points",
        "nan": "non_finite",
        "null": "non_finite",
        "zero": "non_finite",
        "flat": "degenerate",
        "rising": "degenerate",
    }
    for failed in ("two", "nan", "null", "zero"):
        assert (fits[failed].a, fits[failed].b, fits[failed].r2) == (None, None, None)
        assert fits[failed].fitted_values is None
    assert (fits["flat"].r2, fits["flat"].c) == (0.0, 0.25)
    assert fits["rising"].a == 0.0


def test_standard_errors_match_the_normal_matrix(spark):
    data = curve_rows("m", 1.2, 0.3, 0.1, noise=lambda n: 0.001 * math.sin(n))
    fit = L.fit_power_law(frame(spark, data)).first()
    n, y = np.array(SIZES), np.array([r[2] for r in data])
    u = n**-fit.b
    jacobian = np.stack([u, -fit.a * np.log(n) * u, np.ones_like(n)], 1)
    residual = y - fit.a * u - fit.c
    covariance = np.linalg.inv(jacobian.T @ jacobian) * (residual @ residual) / (len(n) - 3)
    assert (fit.se_a, fit.se_b, fit.se_c) == pytest.approx(
        tuple(np.sqrt(np.diag(covariance))), rel=1e-5
    )


def test_three_points_have_infinite_standard_errors(spark):
    fit = L.fit_power_law(frame(spark, curve_rows("m", 1, 0.3, 0.1, sizes=SIZES[:3]))).first()
    assert (fit.se_a, fit.se_b, fit.se_c) == (math.inf,) * 3


def test_published_curve_lands_on_the_bound(spark):
    data = curve_rows("bitfit", 1.068, 0.124, -0.129) + curve_rows("full_ft", 1.922, 0.054, -0.998)
    fits = {f.method: f for f in L.fit_power_law(frame(spark, data)).collect()}
    # The best b of these curves for c = 0, from a grid of step 1e-7.
    for method, best in (("bitfit", (1.019883, 0.166514, 0.0)), ("full_ft", (1.213892, 0.193345, 0.0))):
        fit = fits[method]
        assert (fit.a, fit.b, fit.c) == pytest.approx(best, abs=1e-5)
    signed = L.fit_power_law(frame(spark, data), bounds=L.SIGNED_OFFSET_BOUNDS).collect()
    for fit in signed:
        assert fit.c < -0.12 and fit.r2 > 0.999999


def test_fitted_curve_ends_and_spacing(spark):
    fits = L.fit_power_law(frame(spark, curve_rows("m", 1.0, 0.3, 0.1)))
    points = sorted(L.fitted_curve(fits).collect(), key=lambda r: r.i)
    assert len(points) == 100
    assert [points[0].n, points[-1].n] == [50.0, 5000.0]
    assert points[1].n == pytest.approx(100.0)
    assert points[0].performance == pytest.approx(1 - (50**-0.3 + 0.1), abs=1e-5)


def test_several_keys_and_null_free_groups(spark):
    rows = [(g % 3, f"m{g}", n, y) for g in range(9) for _, n, y in curve_rows("", 1.0, 0.2 + g / 20, 0.05)]
    curve = spark.createDataFrame(rows, "task int, method string, n double, error double")
    fits = L.fit_power_law(curve, ["task", "method"]).collect()
    assert len(fits) == 9
    for fit in fits:
        assert fit.b == pytest.approx(0.2 + int(fit.method[1:]) / 20, abs=1e-4)


def test_one_group_of_many_sizes_and_many_groups(spark):
    from pyspark.sql import functions as F

    curve = spark.range(200_000).selectExpr("'one' as method", "double(50 + id) as n").union(
        spark.range(100_000).selectExpr("string(id) as method", "explode(array(50D, 100D, 200D, 500D)) as n"))
    curve = curve.withColumn("error", F.expr("1.5D * pow(n, -0.3D) + 0.05D"))
    few = L.fit_power_law(curve.where("method = 'one' or int(method) < 2000"))
    got = few.agg(F.count("*").alias("k"), F.min("b").alias("low"), F.max("b").alias("high")).first()
    assert got.k == 2001 and got.low == pytest.approx(0.3, abs=1e-3) and got.high == pytest.approx(0.3, abs=1e-3)


def test_the_plan_has_no_join_hints(spark):
    curve = spark.createDataFrame([("m", float(n), n ** -0.3) for n in (50, 100, 200)], "method string, n double, error double")
    plan = L.fit_power_law(curve, partitions=3)._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" not in plan and "shuffle_hash" not in plan
