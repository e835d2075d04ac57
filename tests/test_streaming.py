import json
import os

import pytest

from curvekit.operators.crossover import crossovers
from curvekit.operators.curves import learning_curve
from curvekit.operators.fit import fit_power_law
from curvekit.streaming import incremental as W
from curvekit.streaming import upserts


def add_run(root, name, method, size, metric):
    os.makedirs(f"{root}/{name}", exist_ok=True)
    record = {
        "run_dir": name,
        "config": {"method": method, "train_subset_size": size},
        "eval_metrics": {"eval_primary_metric": metric, "note": "text"},
    }
    with open(f"{root}/{name}/metrics.json", "w") as out:
        json.dump(record, out, indent=2)


def test_curve_over_two_arrivals_equals_batch(spark, folder, rows):
    root, target, state = f"{folder}/runs", f"{folder}/curve", f"{folder}/state"
    seen = []
    for arrival in range(2):
        for i in range(4):
            run = (("lora", "full_ft")[i % 2], 50 * (1 + i // 2), 0.5 + 0.1 * arrival + 0.01 * i)
            add_run(root, f"run_{arrival}_{i}", *run)
            seen.append(run)
        W.maintain_curve(W.stream_runs(spark, root), target, state, drain=True).awaitTermination()
        batch = spark.createDataFrame(seen, "method string, train_subset_size bigint, primary_metric double")
        now = {(r.method, r.n): (r.cnt, r.mean) for r in W.latest_version(spark, target).collect()}
        want = {(r.method, r.n): (r.cnt, pytest.approx(r.mean)) for r in learning_curve(batch).collect()}
        assert now == want


def test_repeated_runs_pass_once(spark, folder):
    root, target, state = f"{folder}/runs", f"{folder}/unique", f"{folder}/state"
    names = ["t__m__lora__seed1__20240101_000000", "t__m__lora__seed2__20240102_000000", "no_stamp"]
    for i, name in enumerate(names):
        add_run(root, f"dir{i}", "lora", 50, 0.5)
        record = json.load(open(f"{root}/dir{i}/metrics.json"))
        for copy in ("", "_copy"):
            os.makedirs(f"{root}/dir{i}{copy}", exist_ok=True)
            json.dump({**record, "run_dir": name}, open(f"{root}/dir{i}{copy}/metrics.json", "w"))
    unique = W.drop_repeated_runs(W.stream_runs(spark, root).select("run_dir"))
    W.append_runs(unique, target, state, drain=True).awaitTermination()
    got = sorted(r.run_dir for r in spark.read.parquet(target).collect())
    assert got == sorted(names)
    # A copy and an old run arrive later: the copy is known, the old run is not late.
    add_run(root, "again", "lora", 50, 0.5)
    json.dump({"run_dir": names[0]}, open(f"{root}/again/metrics.json", "w"))
    add_run(root, "t__m__lora__seed3__19990101_000000", "lora", 50, 0.5)
    unique = W.drop_repeated_runs(W.stream_runs(spark, root).select("run_dir"))
    W.append_runs(unique, target, state, drain=True).awaitTermination()
    rows = {r.run_dir: r.started for r in spark.read.parquet(target).collect()}
    assert sorted(rows) == sorted([*names, "t__m__lora__seed3__19990101_000000"])
    assert spark.read.parquet(target).count() == 4
    assert rows["no_stamp"] is None and rows[names[0]].year == 2024


def test_refit_after_each_arrival(spark, folder):
    root, target, state = f"{folder}/runs", f"{folder}/fits", f"{folder}/state"
    truth = {"lora": (1.169, 0.251, 0.087), "full_ft": (2.4, 0.42, 0.08)}
    for sizes in ([50, 100], [200, 500, 1000]):
        for method, (a, b, c) in truth.items():
            for n in sizes:
                add_run(root, f"{method}_{n}", method, n, 1 - (a * n**-b + c))
        W.maintain_fits(W.stream_runs(spark, root), target, state, drain=True).awaitTermination()
        fits = {r.method: r for r in W.latest_version(spark, target).collect()}
        if sizes[0] == 50:
            assert {f.fit_status for f in fits.values()} == {"too_few_points"}
    assert fits["lora"].b == pytest.approx(0.251, abs=1e-4)
    assert 10 < fits["lora"].n_cross < 200 and fits["full_ft"].n_cross is None


def test_half_written_versions_are_not_seen_and_old_ones_go(spark, folder):
    root, target, state = f"{folder}/runs", f"{folder}/curve", f"{folder}/state"
    for batch in range(4):
        add_run(root, f"run_{batch}", "lora", 50, 0.5)
        W.maintain_curve(W.stream_runs(spark, root), target, state, drain=True, keep=2).awaitTermination()
    os.makedirs(f"{target}/version=99")
    assert W.latest_version(spark, target).first().cnt == 4
    assert sorted(d for d in os.listdir(target) if d.startswith("version")) == ["version=2", "version=3", "version=99"]


def test_refits_by_group_leave_no_files(spark, folder):
    from curvekit.session import scratch_root

    root, target, state = f"{folder}/runs", f"{folder}/fits", f"{folder}/state"
    before = set(os.listdir(scratch_root(spark).removeprefix("file:")))
    for batch in range(3):
        add_run(root, f"run_{batch}", "lora", 50 * (batch + 1), 0.5)
        stream = W.stream_runs(spark, root)
        W.maintain_fits(stream, target, state, drain=True, by=["task_name"]).awaitTermination()
    assert "task_name" in W.latest_version(spark, target).columns
    assert set(os.listdir(scratch_root(spark).removeprefix("file:"))) == before


def arrive(root, batch, many, method=lambda i: ("lora", "full_ft", "bitfit")[i % 3]):
    """Runs of one arrival; their rows as (method, size, metric)."""
    found = []
    for i in range(many):
        run = (method(i), 50 * (1 + (i * 7 + batch) % 9), 0.5 + 0.001 * ((i * 31 + batch * 17) % 101))
        add_run(root, f"run_{batch}_{i}", *run)
        found.append(run)
    return found


def as_rows(curve):
    return {(r.method, r.n): (r.cnt, pytest.approx(r.mean, rel=1e-12), r.std and pytest.approx(r.std, rel=1e-9)) for r in curve.collect()}


def test_upserted_curve_equals_batch_after_every_arrival(spark, folder, monkeypatch):
    """Nineteen arrivals: merges of two levels where three folders make one, and slots that are written again."""
    monkeypatch.setattr(upserts, "MERGE", 3)
    monkeypatch.setattr(upserts, "SLOTS", 6)
    root, target, state, seen = f"{folder}/runs", f"{folder}/curve", f"{folder}/state", []
    for batch in range(19):
        seen += arrive(root, batch, 1 + batch % 4)
        W.upsert_curve(W.stream_runs(spark, root), target, state, drain=True).awaitTermination()
        want = learning_curve(spark.createDataFrame(seen, "method string, train_subset_size bigint, primary_metric double"))
        got = W.current_curve(spark, target)
        assert {k: (c, m, s) for k, (c, m, s) in as_rows(want).items()} == {(r.method, r.n): (r.cnt, r.mean, r.std) for r in got.collect()}
        if batch in (8, 18):  # the version before is still whole, and a batch that runs again changes nothing
            assert upserts.published(spark, target) == batch
            assert upserts.rows_of(spark, target, ["method", "n"], batch - 1).agg({"cnt": "sum"}).first()[0] == len(seen) - 1 - batch % 4
            again = upserts.changed_in(spark, target, batch).collect()
            changed = spark.createDataFrame(again, upserts.changed_in(spark, target, batch).schema)
            upserts.upsert(changed, target, ["method", "n"], batch)
            assert {(r.method, r.n): r.cnt for r in W.current_curve(spark, target).collect()} == {k: v[0] for k, v in as_rows(want).items()}
    folders = [f"{level}/{slot}" for level in os.listdir(target) if level.startswith("level") for slot in os.listdir(f"{target}/{level}")]
    assert len(folders) <= 6 * 3 and len(os.listdir(f"{target}/_published")) == 2


def size_of(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_bytes_of_a_batch_follow_the_batch_not_the_curve(spark, folder):
    root, target, state = f"{folder}/runs", f"{folder}/curve", f"{folder}/state"
    written = []
    for batch in range(4):
        many = 60 if batch == 1 else 2  # the second arrival makes the curve large
        arrive(root, batch, many, method=lambda i: f"method{i}" if many > 2 else ("lora", "bitfit")[i])
        W.upsert_curve(W.stream_runs(spark, root), target, state, drain=True).awaitTermination()
        written.append((upserts.changed_in(spark, target, batch).count(), size_of(f"{target}/level=0/slot={batch}")))
    rows, size = zip(*written)
    assert rows == (2, 60, 2, 2)
    assert size[2] <= 1.1 * size[0] and size[3] <= 1.1 * size[0] < size[1]


def test_only_changed_groups_are_refitted(spark, folder):
    root, state = f"{folder}/runs", f"{folder}/state"
    curve, fits = f"{folder}/curve", f"{folder}/fits"
    truth = {"lora": (1.169, 0.251, 0.087), "full_ft": (2.4, 0.42, 0.08), "bitfit": (1.0, 0.18, 0.02)}
    arrivals = [(list(truth), [50, 100, 200, 500]), (["lora"], [1000]), (["bitfit", "full_ft"], [2000])]
    for batch, (methods, sizes) in enumerate(arrivals):
        for method in methods:
            a, b, c = truth[method]
            for n in sizes:
                add_run(root, f"{method}_{n}", method, n, 1 - (a * n**-b + c))
        W.upsert_fits(W.stream_runs(spark, root), curve, fits, state, drain=True).awaitTermination()
        assert sorted(r.method for r in upserts.changed_in(spark, fits, batch).collect()) == sorted(methods)
        want = {r.method: r for r in fit_power_law(W.current_curve(spark, curve)).collect()}
        for got in W.current_fits(spark, fits).collect():
            assert got.sample_sizes == want[got.method].sample_sizes
            assert (got.a, got.b, got.c) == pytest.approx((want[got.method].a, want[got.method].b, want[got.method].c), rel=1e-9)
    assert crossovers(W.current_fits(spark, fits)).count() == 2


def test_folders_of_a_version_hold_every_batch_once():
    for version in range(600):
        found = upserts._folders("x", version)
        assert len(found) == len(set(found)) <= (upserts.MERGE - 1) * 4
        digits, done, level = 0, version + 1, 0
        for level in range(4):
            digits += sum(f"level={level}/" in f for f in found) * upserts.MERGE**level
        assert digits == version + 1


def test_names_are_remembered_for_ever_without_state(spark, folder):
    root, target, state = f"{folder}/runs", f"{folder}/unique", f"{folder}/state"
    seen = set()
    for batch in range(10):
        names = [f"run{batch}_{i}" for i in range(3)] + ([f"run0_{batch % 3}"] if batch else [])
        for i, name in enumerate(names):
            os.makedirs(f"{root}/dir{batch}_{i}")
            json.dump({"run_dir": name}, open(f"{root}/dir{batch}_{i}/metrics.json", "w"))
        seen |= set(names)
        stream = W.stream_runs(spark, root).select("run_dir")
        W.append_new_runs(stream, target, state, drain=True).awaitTermination()
        assert sorted(r.run_dir for r in W.unique_runs(spark, target).collect()) == sorted(seen)
        assert upserts.changed_in(spark, target, batch).count() == 3  # the copy of an old name is not written
    assert not os.path.exists(f"{state}/state")


def test_more_input_makes_larger_files_not_more_batches(spark, folder, monkeypatch):
    from registry import stream_queries as Q

    runs = spark.range(0, 400, 1, 100).selectExpr(
        "concat('r', id) as run_dir", "element_at(array('lora', 'full_ft'), int(id % 2) + 1) as method", "id as seed",
        "50L as train_subset_size", "'rte' as task_name", "0.5D as primary_metric", "id as l_orderkey", "1 as l_linenumber",
        "date'2020-01-01' as ordered",
    )
    monkeypatch.setattr(Q.V, "runs", lambda spark, sf: runs)
    for i, land in enumerate((Q._landing, Q._task_stream)):
        monkeypatch.setattr(Q, "scratch_path", lambda spark, label: f"{folder}/{label}-{i}")
        land(spark, "")
        written = f"{folder}/landing-{i}"
        files = [name for _, _, names in os.walk(written) for name in names if name.startswith("part-")]
        assert len(files) <= 2 * Q.LANDING_TASKS and spark.read.json(written).count() == 400
