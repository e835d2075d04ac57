import math
import random

import pytest
from pyspark.sql import functions as F

from curvekit.operators import curves as H

NAN = float("nan")


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(
        [
            ("lora", "encoder", 50, 0.5),
            ("lora", "encoder", 50, 0.7),
            ("lora", "decoder", 100, 0.8),
            ("full_ft", "encoder", 50, 0.4),
            ("full_ft", "encoder", 50, None),
            ("full_ft", "encoder", 50, NAN),
            ("full_ft", "encoder", 100, NAN),
            (None, "encoder", 50, 0.1),
            ("lora", "encoder", None, 0.2),
        ],
        "method string, architecture string, train_subset_size bigint, primary_metric double",
    )


def test_mean_std_count_skip_null_and_nan(runs):
    got = {(r.method, r.n): r for r in H.learning_curve(runs).collect()}
    assert set(got) == {("lora", 50.0), ("lora", 100.0), ("full_ft", 50.0), ("full_ft", 100.0)}
    assert got["lora", 50.0].mean == pytest.approx(0.6)
    assert got["lora", 50.0].std == pytest.approx(math.sqrt(0.02))
    assert got["lora", 50.0].error == pytest.approx(0.4)
    assert got["lora", 100.0].std is None
    assert (got["full_ft", 50.0].cnt, got["full_ft", 50.0].mean) == (1, 0.4)
    assert (got["full_ft", 100.0].cnt, got["full_ft", 100.0].error) == (0, None)


def test_levels_equal_separate_curves(runs, rows):
    columns = ["method", "n", "mean", "std", "cnt", "error"]
    both = H.learning_curve_levels(runs)
    coarse = both.where("level = 'method'").select(columns)
    fine = both.where("level <> 'method'").select("architecture", *columns)
    assert rows(coarse) == rows(H.learning_curve(runs).select(columns))
    expected = H.learning_curve(runs, ["architecture", "method"])
    assert rows(fine) == rows(expected.select("architecture", *columns))


def test_ranked_means_put_baseline_last(runs):
    order = {r.method: r.draw_order for r in H.ranked_means(H.learning_curve(runs)).collect()}
    assert order == {"lora": 1, "full_ft": 4}


def test_performance_and_share(spark, rows):
    runs = spark.createDataFrame(
        [("lora", 50, 0.5, 1.0), ("lora", 50, 0.7, 3.0)],
        "method string, train_subset_size bigint, primary_metric double, trainable_percentage double",
    )
    assert rows(H.mean_performance_and_share(runs)) == [("lora", 50.0, 0.6, 2.0)]


def test_a_null_key_counts_at_levels_that_do_not_use_it(spark):
    runs = spark.createDataFrame(
        [("lora", "encoder", 50, 0.5), ("lora", None, 50, 0.7), (None, "encoder", 50, 0.9)],
        "method string, architecture string, train_subset_size bigint, primary_metric double")
    got = {(r.level, r.method, r.architecture): r.cnt for r in H.learning_curve_levels(runs).collect()}
    assert got == {("method", "lora", None): 2, ("method+architecture", "lora", "encoder"): 1}


def test_exact_curve_has_the_same_bits_however_it_is_partitioned(spark):
    draw = random.Random(4)
    metrics = [draw.choice([draw.random(), draw.gauss(0, 1e9), draw.gauss(0, 1e-9), 0.1, -0.0, None, float("nan")]) for _ in range(4000)]
    rows = [(f"m{draw.randrange(3)}", 50 * draw.randrange(1, 3), x) for x in metrics]
    runs = spark.createDataFrame(rows, "method string, train_subset_size long, primary_metric double")
    seen = set()
    for partitions in (1, 7, 211):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            curve = H.exact_learning_curve(runs.repartition(partitions, F.rand(partitions)))
            seen.add(tuple(sorted((r.method, r.n, r.mean.hex(), r.std.hex(), r.cnt) for r in curve.collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(seen) == 1
    for method, n, mean, std, cnt in seen.pop():
        values = [x for m, s, x in rows if m == method and s == n and x is not None and not math.isnan(x)]
        assert cnt == len(values)
        assert float.fromhex(mean) == pytest.approx(math.fsum(values) / cnt, rel=1e-14)
        centre = math.fsum(values) / cnt
        want = math.sqrt(math.fsum((x - centre) ** 2 for x in values) / (cnt - 1))
        assert float.fromhex(std) == pytest.approx(want, rel=1e-12)


def test_exact_curve_of_few_and_odd_values(spark):
    rows = [("one", 50, 0.25), ("none", 50, None), ("none", 50, float("nan")), ("inf", 50, float("inf")), ("inf", 50, 0.5),
            ("zero", 50, 0.0), ("zero", 50, 0.0), ("tiny", 50, 1e-300), ("huge", 50, 1e300), ("huge", 50, 1e300), (None, 50, 0.1), ("x", None, 0.1)]
    runs = spark.createDataFrame(rows, "method string, train_subset_size long, primary_metric double")
    got = {r.method: (r.mean, r.std, r.cnt) for r in H.exact_learning_curve(runs).collect()}
    assert got.pop("tiny")[0] == pytest.approx(0, abs=1e-299)
    assert got == {
        "one": (0.25, None, 1), "none": (None, None, 0), "inf": (0.5, None, 1), "zero": (0.0, 0.0, 2),
        "huge": (1e300, 0.0, 2),
    }
    assert H.exact_learning_curve(runs.where("false")).count() == 0
