import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvekit.operators import crossover as X
from curvekit.operators.fit import fit_power_law
from curvekit.session import materialize

# Six published fits.
PUBLISHED = {
    "encoder": {
        "bitfit": (1.068, 0.124, -0.129),
        "full_ft": (1.922, 0.054, -0.998),
        "lora": (1.169, 0.251, 0.087),
        "topheavy_lora": (1.168, 0.253, 0.09),
    },
    "decoder": {"full_ft": (1.263, 0.009, -1.0), "lora": (1.344, 0.017, -1.0)},
}


def fit_frame(spark, fits):
    return spark.createDataFrame(
        [(arch, m, *map(float, p)) for arch, ms in fits.items() for m, p in ms.items()],
        "architecture string, method string, a double, b double, c double",
    )


@pytest.fixture(scope="module")
def published(spark):
    return fit_frame(spark, PUBLISHED)


def gap(n, left, right):
    return left[0] * n ** -left[1] + left[2] - (right[0] * n ** -right[1] + right[2])


def test_published_crossovers(published):
    found = {
        (r.architecture, r.method): r.n_cross
        for r in X.crossovers(published, ["architecture"]).collect()
    }
    assert found["encoder", "bitfit"] == pytest.approx(1074.0, abs=0.5)
    assert found["decoder", "lora"] == pytest.approx(2368.6, abs=0.5)
    assert found["encoder", "lora"] is None
    assert found["encoder", "topheavy_lora"] is None
    for (arch, method), n in found.items():
        if n is not None:
            assert abs(gap(n, PUBLISHED[arch][method], PUBLISHED[arch]["full_ft"])) < 1e-9


def test_all_roots_include_the_double_crossing(published):
    roots = sorted(
        r.n_cross
        for r in X.all_crossovers(published, ["architecture"]).collect()
        if (r.architecture, r.method) == ("encoder", "lora")
    )
    assert roots == pytest.approx([20.49, 3655.29], abs=0.05)


def test_all_roots_contain_the_single_root(published):
    every = {(r.architecture, r.method, round(r.n_cross, 6)) for r in X.all_crossovers(published, ["architecture"]).collect()}
    single = {
        (r.architecture, r.method, round(r.n_cross, 6))
        for r in X.crossovers(published, ["architecture"]).collect()
        if r.n_cross is not None
    }
    assert single <= every


def test_special_cases(spark):
    fits = fit_frame(
        spark,
        {
            "g": {
                "full_ft": (1.0, 0.3, 0.1),
                "same": (1.0, 0.3, 0.1),
                "same_b": (2.0, 0.3, 0.05),
                "above": (1.0, 0.3, 0.2),
                "flat": (0.0, 1e-4, 0.2),
                "nan": (math.nan, 0.3, 0.1),
            }
        },
    )
    found = {r.method: r for r in X.crossovers(fits).collect()}
    assert (found["same"].n_cross, found["same"].degenerate) == (10.0, True)
    assert found["same_b"].n_cross == pytest.approx((1 / 0.05) ** (1 / 0.3), rel=1e-9)
    assert found["above"].n_cross is None
    assert found["flat"].n_cross == pytest.approx(0.1 ** (-1 / 0.3), rel=1e-9)
    assert found["nan"].n_cross is None
    every = {(r.method, r.n_cross) for r in X.all_crossovers(fits).collect()}
    assert {m for m, _ in every} == {"same", "same_b", "flat"}
    assert {r.method for r in X.all_crossovers(fits).where("degenerate").collect()} == {"same"}


def test_no_rows_without_a_baseline(spark):
    fits = fit_frame(spark, {"g": {"lora": (1.0, 0.3, 0.1), "bitfit": (2.0, 0.4, 0.1)}})
    assert X.crossovers(fits).count() == 0
    null = fits.selectExpr("method", "if(method = 'lora', null, a) as a", "b", "c")
    assert X.crossovers(null, baseline="lora").count() == 0


def test_keys_leave_out_missing_crossovers(published):
    keys = {(r.architecture, r.pair) for r in X.crossover_keys(X.crossovers(published, ["architecture"])).collect()}
    assert keys == {("encoder", "bitfit_vs_full_ft"), ("decoder", "lora_vs_full_ft")}


def test_leave_one_seed_out_counts_a_seed_missing_at_some_sizes(spark):
    sizes = [50, 100, 200, 500, 1000]
    rows = []
    for seed in (1, 2, 3):
        for n in sizes:
            if seed == 3 and n == 50:
                continue
            rows.append(("full_ft", seed, n, 1 - (2.4 * n**-0.42 + 0.08)))
            rows.append(("lora", seed, n, 1 - (1.169 * n**-0.251 + 0.087)))
    runs = spark.createDataFrame(
        rows, "method string, seed bigint, train_subset_size bigint, primary_metric double"
    )
    row = X.crossover_spread(runs).first()
    assert (row.method, row.n_refits, row.n_found) == ("lora", 3, 3)
    assert row.n_min == pytest.approx(row.n_max, rel=1e-3)


def noisy_fits(spark, groups, noise, sizes, seed=2):
    draw = random.Random(seed)
    truth = {"lora": (1.169, 0.251, 0.087), "full_ft": (2.4, 0.42, 0.08)}
    rows = [
        (g, m, float(n), a * n**-b + c + draw.gauss(0, noise))
        for g in range(groups) for m, (a, b, c) in truth.items() for n in sizes
    ]
    curve = spark.createDataFrame(rows, "g int, method string, n double, error double")
    return materialize(fit_power_law(curve, ["g", "method"]), "noisy-fits")


def test_standard_error_of_a_crossover_is_that_of_repeated_experiments(spark):
    fits = noisy_fits(spark, 150, 0.002, range(50, 5000, 150))
    found = X.crossover_uncertainty(fits, ["g"]).collect()
    assert len(found) == 150
    logs = [math.log(r.n_cross) for r in found]
    spread = statistics.stdev(logs)
    assert statistics.median(r.se_log_n for r in found) == pytest.approx(spread, rel=0.25)
    truth = statistics.median(logs)
    inside = sum(r.n_low <= math.exp(truth) <= r.n_high for r in found)
    assert inside >= 0.88 * len(found)
    for r in found:
        assert r.n_low == pytest.approx(r.n_cross * math.exp(-X.TWO_SIDED_95 * r.se_log_n))


def test_standard_error_of_every_root_by_differences(spark):
    fits = noisy_fits(spark, 6, 0.003, [50, 100, 200, 500, 1000, 2000, 5000], seed=9)
    by_group = {}
    for r in fits.collect():
        by_group.setdefault(r.g, {})[r.method] = r
    found = X.crossover_uncertainty(fits, ["g"], every_root=True).collect()
    assert found

    def covariance(f):
        return np.array([[f.se_a**2, f.cov_ab, f.cov_ac], [f.cov_ab, f.se_b**2, f.cov_bc], [f.cov_ac, f.cov_bc, f.se_c**2]])

    def root(p, near):
        """Newton on ln N from a root nearby."""
        x = math.log(near)
        for _ in range(50):
            u, v = math.exp(-p[1] * x), math.exp(-p[4] * x)
            x -= (p[0] * u + p[2] - p[3] * v - p[5]) / (-p[0] * p[1] * u + p[3] * p[4] * v)
        return x

    for r in found:
        fit, base = by_group[r.g]["lora"], by_group[r.g]["full_ft"]
        p = np.array([fit.a, fit.b, fit.c, base.a, base.b, base.c])
        d = np.array([(root(p + h, r.n_cross) - root(p - h, r.n_cross)) / 2e-7 for h in np.eye(6) * 1e-7])
        want = math.sqrt(d[:3] @ covariance(fit) @ d[:3] + d[3:] @ covariance(base) @ d[3:])
        assert r.se_log_n == pytest.approx(want, rel=1e-3)


def test_uncertainty_without_residuals_crossing_or_difference(spark):
    rows = [("lora", n, 1.169 * n**-0.251 + 0.087) for n in (50.0, 500.0, 5000.0)]
    rows += [("full_ft", n, 2.4 * n**-0.42 + 0.08) for n in (50.0, 100.0, 500.0, 5000.0)]
    rows += [("bitfit", n, 0.01 + 0.01 * n**-0.3) for n in (50.0, 100.0, 500.0, 5000.0)]
    curve = spark.createDataFrame(rows, "method string, n double, error double")
    found = {r.method: r for r in X.crossover_uncertainty(fit_power_law(curve)).collect()}
    assert found["lora"].se_log_n == math.inf and found["lora"].n_low == 0 and found["lora"].n_high == math.inf
    assert found["bitfit"].n_cross is None and found["bitfit"].se_log_n is None and found["bitfit"].n_low is None
    twin = fit_power_law(curve.where("method = 'full_ft'"))
    twin = twin.union(twin.withColumn("method", F.lit("lora")))
    same = X.crossover_uncertainty(materialize(twin, "twins")).first()
    assert same.degenerate and same.n_cross == 10 and same.se_log_n is None and same.n_high is None


def test_leave_one_out_curves_equal_curves_of_the_other_seeds(spark):
    draw = random.Random(11)
    rows = [
        (m, 50 * k, seed, draw.choice([None, float("nan"), draw.random(), draw.random(), draw.random()]))
        for seed in range(40) for m in ("lora", "full_ft", "bitfit") for k in (1, 2, 3)
        if not (m == "bitfit" and seed > 3) for _ in range(draw.randint(0, 2))
    ]
    rows.append(("lora", 999, 7, 0.5))  # a size that one seed alone has
    runs = spark.createDataFrame(rows, "method string, train_subset_size long, seed long, primary_metric double")
    got = {(r.held_out, r.method, r.n): r.error for r in X.leave_one_out(runs).collect()}
    want = {}
    for held in {r[2] for r in rows}:
        for method, size in {r[:2] for r in rows}:
            left = [x for m, n, s, x in rows if (m, n) == (method, size) and s != held and x is not None and x == x]
            if left:
                want[held, method, float(size)] = pytest.approx(1 - sum(left) / len(left))
    assert got == want


def test_spread_over_many_seeds_holds_no_array_of_them(spark):
    truth = {"lora": (1.169, 0.251, 0.087), "full_ft": (2.4, 0.42, 0.08)}
    cases = " ".join(f"when '{m}' then 1 - ({a} * pow(n, -{b}) + {c})" for m, (a, b, c) in truth.items())
    runs = spark.range(3000).selectExpr("id as seed", "explode(array('lora', 'full_ft')) as method").selectExpr(
        "*", "explode(array(50L, 100L, 200L, 500L, 1000L, 2000L, 5000L)) as n"
    ).selectExpr("seed", "method", "n as train_subset_size", f"case method {cases} end + 0.02 * (rand(3) - 0.5) as primary_metric")
    plan = X.leave_one_out(runs)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(seed" not in plan and "collect_list" not in plan and "map_from" not in plan
    row = X.crossover_spread(runs).first()
    assert row.n_refits == row.n_found == 3000
    assert row.n_min <= row.n_05 < row.n_median < row.n_95 <= row.n_max
