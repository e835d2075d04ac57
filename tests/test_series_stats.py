import math

import pytest

from curvekit.operators import series as K
from curvekit.operators import stats as Q
from curvekit.operators.curves import learning_curve
from curvekit.operators.fit import fit_power_law

RUNS = "method string, train_subset_size bigint, primary_metric double, trainable_percentage double"


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(
        [("lora", 50, 0.5, 1.0), ("lora", 100, 0.6, 1.0), ("full_ft", 50, 0.4, 100.0),
         ("full_ft", 200, 0.8, 100.0), ("free", 50, 0.5, 0.0)], RUNS)


def test_matrix_unpivots_to_efficiency(runs):
    long = {(r.method, r.n): r.efficiency for r in K.efficiency(runs).collect()}
    matrix = K.efficiency_matrix(K.efficiency(runs), [200, 50, 100])
    assert matrix.columns == ["method", "n50", "n100", "n200", "label"]
    cells = {(r.method, n): r[f"n{int(n)}"] for r in matrix.collect() for n in (50.0, 100.0, 200.0)}
    assert {k: v for k, v in cells.items() if v is not None} == long
    assert [r.method for r in matrix.collect()] == ["free", "full_ft", "lora"]
    assert long["free", 50.0] == pytest.approx(0.5 / 1e-6)


def test_delta_needs_both_methods(runs):
    curve = learning_curve(runs)
    bars = K.delta_bars(K.method_delta(curve, "full_ft", "lora")).collect()
    assert [(r.n, round(r.delta_points, 6), r.bucket) for r in bars] == [(50.0, -10.0, "loss")]
    assert K.method_delta(curve, "gradaware_lora", "lora").count() == 0


def test_markers(spark):
    keyed = spark.createDataFrame([("lora_vs_full_ft", 70.5), ("x", 1074.4)], "pair string, n_cross double")
    assert [r.text for r in K.crossover_markers(keyed).collect()] == ["N=70", "N=1074"]


def test_figure_series_parts(spark, runs):
    curve = learning_curve(runs)
    keyed = spark.createDataFrame([("lora_vs_full_ft", 70.5)], "pair string, n_cross double")
    series = K.figure_series(curve, fit_power_law(curve), keyed)
    counts = {r.series: r["count"] for r in series.groupBy("series").count().collect()}
    assert counts == {"observed": 5, "mean": 4, "crossover": 1}  # no method has three sizes
    marker = series.where("series = 'crossover'").first()
    assert (marker.x, marker.text, marker.log_x) == (70.5, "N=70", pytest.approx(math.log10(70.5)))


FULL = ("method string, model_name string, task_name string, train_subset_size bigint, seed bigint, "
        "run_dir string, primary_metric double")


def test_welch_and_pairs(spark):
    full, lora = [0.5, 0.6, 0.7], [0.7, 0.9, 0.8]
    rows = [("full_ft", "m", "t", 50, s, f"f{s}", v) for s, v in enumerate(full)]
    rows += [("lora", "m", "t", 50, s, f"l{s}", v) for s, v in enumerate(lora)]
    rows += [("lora", "m", "t", 50, 0, "a-older-duplicate", 0.0), ("lora", "m", "t", 50, 9, "unpaired", 0.1)]
    runs = spark.createDataFrame(rows, FULL)
    pair = Q.paired_by_seed(runs).first()
    assert (pair.method, pair.n_pairs, pair.win_rate) == ("lora", 3, 1.0)
    assert pair.mean_difference == pytest.approx(0.2)
    assert pair.sd_difference == pytest.approx(0.1)
    welch = Q.welch(runs.where("run_dir not in ('a-older-duplicate', 'unpaired')")).first()
    assert welch.t == pytest.approx(0.2 / math.sqrt(0.01 / 3 + 0.01 / 3))
    assert welch.df == pytest.approx(4.0)


EFFICIENCIES = "task_name string, method string, n double, efficiency double"


def test_matrix_has_all_sizes_and_group_keys(spark):
    table = spark.createDataFrame(
        [("a", "lora", 50.0, 1.0), ("a", "lora", 300.0, 2.0), ("b", "lora", 50.0, 3.0)], EFFICIENCIES)
    rows = K.efficiency_matrix(table, by=["task_name"]).collect()
    assert [(r.task_name, r.n50, r.n300) for r in rows] == [("a", 1.0, 2.0), ("b", 3.0, None)]


def test_matrix_refuses_what_it_would_lose(spark):
    table = spark.createDataFrame([("a", "lora", 50.0, 1.0), ("b", "lora", 50.0, 3.0)], EFFICIENCIES)
    with pytest.raises(Exception, match="several values for a cell"):
        K.efficiency_matrix(table).collect()
    with pytest.raises(Exception, match="no column for size 50"):
        K.efficiency_matrix(table, [100], ["task_name"]).collect()


def test_figure_series_keep_group_keys(spark):
    from curvekit.plans.analysis import analyse

    runs = spark.createDataFrame(
        [(t, m, n, 1 - a * n ** -0.3) for t, a in (("x", 1.0), ("y", 2.0)) for m in ("lora", "full_ft") for n in (50, 100, 200, 500)],
        "task_name string, method string, train_subset_size bigint, primary_metric double")
    series = analyse(runs, ["task_name"]).figure_series
    observed = series.where("series = 'observed'").collect()
    assert len({(r.task_name, r.method, r.x) for r in observed}) == len(observed) == 16
    assert all(r.task_name for r in series.where("series <> 'crossover'").collect())
