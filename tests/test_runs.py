import json
import os

import pytest
from pyspark.sql import functions as F

from curvekit.operators import config as P
from curvekit.operators import flatten as P1
from curvekit.operators import grid as E
from curvekit.plans.analysis import aggregate_runs
from curvekit.schema import RESULTS
from curvekit.sources import readers, writers


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as out:
        out.write(text)


@pytest.fixture()
def tree(folder):
    encoder = {
        "run_dir": "/x/b_run",
        "config": {"method": "lora", "model_name": "bert-base-uncased", "task_name": "sst2",
                   "seed": 42, "train_subset_size": 500},
        "parameter_stats": {"total_parameters": 1000, "trainable_parameters": 10, "trainable_percentage": 1.0},
        "method_notes": {"adapter_strategy": "lora"},
        "train_metrics": {"loss": 0.5, "text": "no", "flag": True, "nothing": None},
        "eval_metrics": {"eval_primary_metric": 0.9, "eval_accuracy": 0.9, "count": 3, "text": "1.5", "ok": True},
        "primary_metric_name": "accuracy",
    }
    decoder = {
        "run_dir": "a_run",
        "config": {"method": "full_ft", "model_name": "Qwen/Qwen2.5-0.5B", "task_name": "mrpc",
                   "seed": 1, "train_subset_size": 100},
        "eval_metrics": {"eval_total": 7, "eval_primary_metric": 0.25, "seed": 99},
        "primary_metric_name": "accuracy",
        "architecture": "causal_lm",
    }
    put(folder, "b_run/metrics.json", json.dumps(encoder, indent=2))
    put(folder, "a_run/metrics.json", json.dumps(decoder, indent=2))
    put(folder, "c_run/metrics.json", json.dumps({"run_dir": "c"}))
    put(folder, "b_run/config.json", json.dumps({"method": "not a run"}))
    put(folder, "deep/er/metrics.json", json.dumps({"run_dir": "too deep"}))
    put(folder, "metrics.json", json.dumps({"run_dir": "too shallow"}))
    return folder


def test_scan_reads_exactly_one_level(spark, tree):
    records = readers.scan_runs(spark, tree).orderBy("source_file").collect()
    assert [r.run_dir for r in records] == ["a_run", "/x/b_run", "c"]
    assert records[1].train_metrics == {"loss": 0.5, "flag": 1.0}
    assert records[1].eval_metrics == {
        "eval_primary_metric": 0.9, "eval_accuracy": 0.9, "count": 3.0, "ok": 1.0}
    assert records[1].method_notes == {"adapter_strategy": "lora"}
    assert records[2].config is None


def test_flatten_keeps_rows_without_parents(spark, tree):
    flat = {r.run_dir: r for r in P1.flatten_runs(readers.scan_runs(spark, tree)).collect()}
    assert flat["/x/b_run"].trainable_percentage == 1.0
    assert flat["/x/b_run"].primary_metric == 0.9
    assert flat["a_run"].trainable_parameters is None
    assert (flat["c"].method, flat["c"].primary_metric) == (None, None)


def test_metric_columns_in_first_seen_order_and_clash(spark, tree):
    table = aggregate_runs(spark, tree)
    added = [c for c in table.columns if c not in P1.RESULT_FIELDS]
    assert added == ["eval_total", "eval_primary_metric", "eval_accuracy", "count", "text", "ok",
                     "architecture", "source_file"]
    seeds = {r.run_dir: r.seed for r in table.collect()}
    assert seeds == {"a_run": 99, "/x/b_run": 42, "c": None}


def test_results_json_sorted_keys_and_csv(spark, folder, rows):
    df = spark.createDataFrame([("x", None, 0.5), ("y", 2, None)], "run_dir string, seed bigint, acc double")
    writers.write_results_json(df, f"{folder}/deep/er/json")
    lines = [r.value for r in spark.read.text(f"{folder}/deep/er/json").collect()]
    assert sorted(lines) == ['{"acc":0.5,"run_dir":"x"}', '{"run_dir":"y","seed":2}']
    with pytest.raises(ValueError, match="no CSV form for m"):
        writers.write_results_csv(df.withColumn("m", F.create_map(F.lit("k"), "acc")), f"{folder}/csv")
    for _ in range(2):  # a second run replaces the first
        writers.write_results_csv(df, f"{folder}/csv")
        writers.write_results_json(df, f"{folder}/deep/er/json")
    back = spark.read.option("header", True).csv(f"{folder}/csv")
    assert back.columns == ["run_dir", "seed", "acc"]
    assert rows(back) == [("x", None, "0.5"), ("y", "2", None)]


def test_read_results_from_json_array(spark, folder):
    put(folder, "results.json", json.dumps([{"method": "lora", "seed": 1}, {"method": "bitfit"}], indent=2))
    back = readers.read_results(spark, f"{folder}/results.json")
    assert sorted((r.method, r.seed) for r in back.collect()) == [("bitfit", None), ("lora", 1)]


def test_read_fits_both_shapes_and_missing(spark, folder):
    put(folder, "flat.json", json.dumps({"Encoder_full_ft": {"a": 1.9, "b": 0.05, "c": -1.0, "R2": 0.96}}))
    nested = {"fits": {"lora": {"method": "lora", "a": 1.0, "b": 0.2, "c": 0.1, "r2": 0.9, "n_points": 3,
                                "perr": [float("inf")] * 3}},
              "crossovers": {"lora_vs_full_ft": 70.5}, "metadata": {"total_runs": 5}}
    put(folder, "nested.json", json.dumps(nested))
    flat = readers.read_fits(spark, f"{folder}/flat.json").first()
    assert (flat.architecture, flat.method, flat.a, flat.c, flat.r2) == ("encoder", "full_ft", 1.9, -1.0, 0.96)
    fit = readers.read_fits(spark, f"{folder}/nested.json").first()
    assert (fit.method, fit.r2, fit.n_points, fit.perr) == ("lora", 0.9, 3, [float("inf")] * 3)
    assert [tuple(r) for r in readers.read_crossovers(spark, f"{folder}/nested.json").collect()] == [
        ("lora_vs_full_ft", 70.5)]
    assert readers.read_fits(spark, f"{folder}/absent.json").count() == 0


def test_fit_document_round_trip(spark, folder):
    fits = spark.createDataFrame(
        [("lora", 1.0, 0.2, 0.1, 0.9, 3, [1.0], [0.5], [0.5], float("inf"), 0.1, 0.2),
         ("bad", None, None, None, None, 2, [1.0], [0.5], None, None, None, None)],
        "method string, a double, b double, c double, r2 double, n_points bigint, "
        "sample_sizes array<double>, error_rates array<double>, fitted_values array<double>, "
        "se_a double, se_b double, se_c double")
    crossed = spark.createDataFrame([("lora_vs_full_ft", 70.5)], "pair string, n_cross double")
    runs = spark.createDataFrame([("lora", 3), ("bad", 1), ("lora", 2), (None, 4)], "method string, at int")
    text = writers.fit_document(fits, crossed, runs, "at")
    document = json.loads(text.first().value.replace('"Infinity"', "Infinity"))
    assert document["metadata"] == {
        "total_runs": 4, "methods": ["bad", "lora"], "formula": "E = a * N^(-b) + c"}
    assert document["crossovers"] == {"lora_vs_full_ft": 70.5}
    assert list(document["fits"]) == ["lora"]
    assert document["fits"]["lora"]["perr"] == [float("inf"), 0.1, 0.2]
    writers.write_fit_document(text, f"{folder}/doc")
    assert readers.read_fits(spark, f"{folder}/doc").first().perr[0] == float("inf")
    none = writers.fit_document(fits.where("false"), crossed.where("false"), runs, "at")
    empty = json.loads(none.first().value)
    assert (empty["fits"], empty["crossovers"]) == ({}, {})
    nothing = writers.fit_document(fits.where("false"), crossed.where("false"), runs.where("false"))
    assert json.loads(nothing.first().value)["metadata"]["total_runs"] == 0


def test_records_written_per_run_are_scanned_again(spark, folder):
    configs = spark.createDataFrame(
        [("r1", "encoder", "bitfit", "bert-base-uncased", "cola", 42, 50),
         ("r2", "decoder", "lora", "Qwen/Qwen2.5-0.5B", "cola", 1, 100)],
        "run_id string, architecture string, method string, model_name string, task_name string, "
        "seed bigint, train_subset_size bigint")
    stats = spark.createDataFrame([("r1", 10, 1, 10.0)],
                                  "run_id string, total_parameters bigint, trainable_parameters bigint, "
                                  "trainable_percentage double")
    metrics = spark.createDataFrame([("r1", 0.3, None), ("r2", 0.5, 0.5)],
                                    "run_id string, eval_primary_metric double, eval_accuracy double")
    records = P.assemble_records(configs, stats, metrics)
    by_run = {r.run_dir: r for r in records.collect()}
    assert by_run["r1"].primary_metric_name == "matthews_correlation"
    assert by_run["r1"].method_notes == {"adapter_strategy": "train_bias_only"}
    assert by_run["r1"].eval_metrics == {"eval_primary_metric": 0.3}
    assert (by_run["r2"].primary_metric_name, by_run["r2"].architecture) == ("accuracy", "causal_lm")
    assert by_run["r2"].method_notes is None
    writers.write_run_records(records, folder)
    assert {d for d in os.listdir(f"{folder}/metrics") if "=" in d} == {"run_id=r1", "run_id=r2"}
    back = readers.scan_runs(spark, f"{folder}/metrics", "*/part-*.json", one_per_file=False)
    flat = {r.run_dir: r for r in P1.flatten_runs(back).collect()}
    assert (flat["r1"].trainable_percentage, flat["r2"].primary_metric) == (10.0, 0.5)
    assert spark.read.json(f"{folder}/config").count() == 2


CONFIG = "architecture string, method string, model_name string, task_name string, train_subset_size bigint"


def test_validation_order_and_rules(spark):
    df = spark.createDataFrame(
        [("encoder", "lora", "bert-base-uncased", "sst2", 50),
         ("encoder", "magic", "gpt", "stsb", 0),
         ("encoder", None, "bert-base-uncased", "sst2", None),
         ("decoder", "topheavy_lora", "anything", "anything", -1),
         ("decoder", "lora", "anything", "anything", -1)], CONFIG)
    got = [(r.first_violation, len(r.violations)) for r in P.validate(df).collect()]
    assert got == [
        (None, 0),
        ("Unsupported method: magic", 5),
        ("Unsupported method: None", 2),
        ("Unsupported method for CausalLM: topheavy_lora", 1),
        (None, 0)]


def test_run_ids_in_both_layouts(spark):
    df = spark.createDataFrame(
        [("encoder", "lora", "org/bert", "sst2", 50), ("decoder", "lora", "org/qwen", "sst2", 50)], CONFIG
    ).withColumns({"seed": F.lit(7), "started": F.lit("2024-03-05 06:07:08").cast("timestamp")})
    ids = [r[0] for r in df.select(P.run_id()).collect()]
    assert ids == ["sst2__org-bert__lora__seed7__20240305_060708",
                   "lora__org_qwen__sst2__n50__s7__20240305_060708"]


def test_defaults_and_effective_values(spark):
    df = spark.createDataFrame(
        [("encoder", "lora", None, None), ("encoder", "full_ft", None, 2.0), ("encoder", "bitfit", 1e-3, 20.0),
         ("decoder", "lora", None, None), ("decoder", "full_ft", 0.0, None), ("decoder", "lora", 5e-5, 1.0)],
        "architecture string, method string, learning_rate double, num_train_epochs double")
    done = P.effective_hyperparameters(P.fill_defaults(df)).collect()
    assert [(r.effective_learning_rate, r.effective_epochs) for r in done] == [
        (2e-4, 10.0), (2e-5, 2.0), (1e-3, 20.0), (2e-4, 3.0), (2e-5, 3.0), (5e-5, 1.0)]
    assert [r.per_device_train_batch_size for r in done] == [8, 8, 8, 4, 4, 4]
    assert [r.eval_strategy for r in done] == ["epoch"] * 3 + [None] * 3
    assert done[0].learning_rate == 2e-5


def test_architecture_given_or_derived(spark):
    df = spark.createDataFrame([("causal_lm", "x"), (None, "Qwen/Qwen2.5-0.5B"), (None, "roberta-base"), (None, None)],
                               "architecture string, model_name string")
    tags = [r.architecture for r in readers.tag_architecture(df).collect()]
    assert tags == ["decoder", "decoder", "encoder", "encoder"]


def test_task_facts_and_labels(spark):
    df = spark.createDataFrame([("cola", "lora"), ("stsb", "gradaware_lora"), (None, "full_ft")],
                               "task_name string, method string")
    got = {r.method: r for r in P.with_task_facts(df).withColumns(
        {"label": P.method_label(), "colour": P.method_colour()}).collect()}
    assert (got["lora"].task_metric, got["lora"].num_labels, got["lora"].label) == ("matthews_correlation", 2, "LoRA")
    assert (got["gradaware_lora"].num_labels, got["gradaware_lora"].label, got["gradaware_lora"].colour) == (
        1, "gradaware_lora", None)
    assert got["full_ft"].task_metric is None


RUN = "method string, model_name string, task_name string, train_subset_size bigint, seed bigint, run_dir string"


def test_grid_and_coverage(spark):
    assert E.ENCODER_PLAN.cells == 2100 and E.DECODER_PLAN.cells == 54
    planned = E.planned_cells(spark)
    assert planned.distinct().count() == 2154
    runs = spark.createDataFrame(
        [("lora", "roberta-base", "rte", 50, 42, "a"), ("lora", "roberta-base", "rte", 50, 42, "b"),
         ("lora", "roberta-base", "rte", 51, 42, "c"), ("lora", "Qwen/Qwen2.5-0.5B", "cola", 100, 42, "d"),
         ("bitfit", "Qwen/Qwen2.5-0.5B", "cola", 100, 42, "e")], RUN)
    counts = E.runs_per_cell(runs).where("n_runs > 0").collect()
    assert sorted(r.n_runs for r in counts) == [1, 2]
    assert E.missing_cells(runs).count() == 2152
    assert sorted(r.run_dir for r in E.off_grid_runs(runs).collect()) == ["c", "e"]


def test_duplicates(spark):
    runs = spark.createDataFrame(
        [("lora", "m", "t", 50, 1, d) for d in ("b", "c", "a")] + [("lora", "m", "t", 50, 2, "z")], RUN)
    assert [tuple(r)[-3:] for r in E.duplicate_groups(runs).collect()] == [(3, "a", "c")]
    assert sorted(r.run_dir for r in E.deduplicate(runs).collect()) == ["c", "z"]
    assert tuple(E.duplicate_count(runs).first()) == (4, 2, 2)


def test_counts_and_first_seen(spark):
    runs = spark.createDataFrame([("encoder", "b", 2), ("encoder", "a", 3), (None, "b", 5), ("decoder", "b", 1)],
                                 "architecture string, method string, at int")
    assert {r.architecture: r.n_runs for r in E.run_counts(runs).collect()} == {
        "encoder": 2, "decoder": 1, None: 1, "all": 4}
    assert sorted((r.first_seen, r.method) for r in E.methods_in_order(runs, "at").collect()) == [(1, "b"), (3, "a")]


def test_unreadable_files_and_values_are_errors(spark, folder):
    put(folder, "a/metrics.json", '{"run_dir": "a", "config": {"seed": 42.0, "train_subset_size": 500.0}}')
    flat = P1.flatten_runs(readers.scan_runs(spark, folder)).first()
    assert (flat.seed, flat.train_subset_size) == (42, 500)
    put(folder, "b/metrics.json", '{"run_dir": "b", "config": {"seed": 42')
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED|FAILFAST"):
        readers.scan_runs(spark, folder).collect()
    put(folder, "b/metrics.json", '{"run_dir": "b", "config": {"seed": 42.5}}')
    with pytest.raises(Exception, match="config.seed is no whole number"):
        readers.scan_runs(spark, folder).collect()


def test_text_and_null_metrics_are_columns(spark, folder):
    put(folder, "a/metrics.json", json.dumps({"run_dir": "a", "config": {"seed": 1, "method": "x"}, "eval_metrics": {"note": "good", "acc": 1, "never": None, "seed": None}}))
    put(folder, "b/metrics.json", json.dumps({"run_dir": "b", "config": {"seed": 2, "method": "y"}, "eval_metrics": {"note": 7, "method": "z"}}))
    wide = aggregate_runs(spark, folder)
    rows = {r.run_dir: r for r in wide.collect()}
    assert (rows["a"].note, rows["a"].acc, rows["a"].never, rows["a"].seed, rows["a"].method) == ("good", 1.0, None, None, "x")
    assert (rows["b"].note, rows["b"].acc, rows["b"].seed, rows["b"].method) == ("7", None, 2, "z")


def test_results_keep_their_metric_columns(spark, folder):
    put(folder, "r.json", json.dumps([{"method": "lora", "eval_f1": 0.5, "architecture": "encoder"}]))
    row = readers.read_results(spark, f"{folder}/r.json").first()
    assert (row.method, row.eval_f1, row.architecture, row.seed) == ("lora", 0.5, "encoder", None)


def test_run_records_have_sorted_keys_and_can_be_written_again(spark, folder):
    records = spark.createDataFrame(
        [("r1", ("lora", 1, 0.5), {"b": 1.0})], "run_dir string, config struct<method:string,seed:bigint,a_field:double>, eval_metrics map<string,double>")
    for _ in range(2):
        writers.write_run_records(records, folder)
    text = lambda kind: [r.value for r in spark.read.text(f"{folder}/{kind}").collect()]
    assert text("config") == ['{"a_field":0.5,"method":"lora","seed":1}']
    assert text("metrics") == ['{"config":{"a_field":0.5,"method":"lora","seed":1},"eval_metrics":{"b":1.0},"run_dir":"r1"}']


def test_folders_of_runs_are_made_by_many_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(writers, "RUNS_PER_TASK", 4)
    records = spark.range(40).selectExpr(
        "concat('r', id) as run_dir", "named_struct('seed', id) as config", "map('k', double(id)) as eval_metrics"
    )
    writers.write_run_records(records, folder)
    for kind in ("config", "metrics"):
        files = [name for _, _, names in os.walk(f"{folder}/{kind}") for name in names if name.startswith("part-")]
        assert len(files) == 40 and len({name[:10] for name in files}) > 5


def test_results_are_packed_where_they_are_read_back(spark, folder, rows, monkeypatch):
    from registry import run_queries as Q

    results = spark.createDataFrame([("r1", "lora", "m", "t", 1, 50, "f1", 0.5, 7, 0.2), ("r2", None, "m", "t", 2, 50, None, None, None, 1.0)], RESULTS)
    monkeypatch.setattr(Q, "_results", lambda spark, sf: results)
    monkeypatch.setattr(Q, "scratch_path", lambda spark, label: f"{folder}/{label}")
    assert rows(Q.read_results(spark, "")) == rows(results)
    assert {name[-3:] for name in os.listdir(f"{folder}/results-json") if name.startswith("part-")} == {".gz"}
