"""Run records and results: sources, sinks, flattening, configs, validation, the grid."""

import dataclasses
import itertools

from pyspark.sql import functions as F

from curvekit import fixed_values as fv
from curvekit.operators import config as P
from curvekit.operators import flatten as P1
from curvekit.operators import grid as E
from curvekit.operators.curves import learning_curve
from curvekit.operators.keys import key_lattice
from curvekit.plans.analysis import aggregate_runs
from curvekit.schema import RUN_KEY
from curvekit.session import scratch_path
from curvekit.sources import readers, writers
from registry import check_sql as S
from registry import views as V
from registry.catalog import query, r, rounded

LINES = "*/part-*.json"


def _run_files(spark, sf):
    """Write the events as run records in JSON Lines, one folder per event type."""
    root = scratch_path(spark, "run-files")
    V.run_json(spark, sf).write.partitionBy("folder").json(root)
    return root


def _scan(spark, sf):
    return readers.scan_runs(spark, _run_files(spark, sf), LINES, one_per_file=False)


@query(
    "s1_scan_run_files",
    f"""WITH {S.RUN_JSON} SELECT run_dir, method, seed, train_subset_size, primary_metric_name,
      NULL::BIGINT AS total_parameters FROM run_json""",
)
def scan_run_files(spark, sf):
    return _scan(spark, sf).select(
        "run_dir", "config.method", "config.seed", "config.train_subset_size",
        "primary_metric_name", "parameter_stats.total_parameters",
    )


@query(
    "s1_one_object_per_file",
    """SELECT 'supplier-' || s_suppkey AS run_dir, 'nation' || s_nationkey AS method, s_suppkey AS seed,
      round(s_acctbal, 6) + 0.0 AS primary_metric FROM supplier""",
)
def one_object_per_file(spark, sf):
    """A folder and a file for every supplier's record, scanned as whole files."""
    root = scratch_path(spark, "run-records")
    records = V.table(spark, sf, "supplier").selectExpr(
        "concat('supplier-', s_suppkey) as run_dir",
        "named_struct('method', concat('nation', s_nationkey), 'seed', s_suppkey) as config",
        "named_struct('eval_primary_metric', s_acctbal, 'name', s_name) as eval_metrics",
    )
    writers.write_run_records(records, root)
    found = P1.flatten_runs(readers.scan_runs(spark, f"{root}/metrics", "*/part-*.json"))
    return rounded(found.select("run_dir", "method", "seed", "primary_metric"))


FLAT = f"""WITH {S.RUN_JSON} SELECT run_dir, method, NULL::VARCHAR AS model_name,
  NULL::VARCHAR AS task_name, seed, train_subset_size, primary_metric_name,
  {r("value")} AS primary_metric, NULL::BIGINT AS trainable_parameters,
  NULL::DOUBLE AS trainable_percentage FROM run_json"""


@query("p1_flatten_records", FLAT)
def flatten_records(spark, sf):
    flat = P1.flatten_runs(_scan(spark, sf))
    return rounded(flat.drop("eval_metrics", "eval_texts", "metric_keys", "architecture", "source_file"))


EXPANDED = f"""{S.RUN_JSON}, expanded AS (
  SELECT run_dir, method, CASE WHEN purchase THEN 0 - k ELSE CAST(seed AS DOUBLE) END AS seed,
    train_subset_size, primary_metric_name, {r("value")} AS primary_metric,
    {r("value")} AS eval_primary_metric, k, CASE WHEN purchase THEN CAST(1 AS DOUBLE) END AS flag,
    method AS note
  FROM run_json)"""
EXPANDED_COLUMNS = [
    "run_dir", "method", "seed", "train_subset_size", "primary_metric_name", "primary_metric",
    "eval_primary_metric", "k", "flag", "note",
]


@query("p2_expand_metrics", f"WITH {EXPANDED} SELECT * FROM expanded")
def expand_metrics(spark, sf):
    wide = aggregate_runs(spark, _run_files(spark, sf), LINES, one_per_file=False)
    return rounded(wide.select(*EXPANDED_COLUMNS))


@query(
    "p3_numeric_metrics",
    f"""WITH {S.RUN_JSON}, entries AS (
      SELECT run_dir, 'eval_primary_metric' AS metric, value FROM run_json
      UNION ALL SELECT run_dir, 'k', k FROM run_json
      UNION ALL SELECT run_dir, 'flag', 1.0 FROM run_json WHERE purchase
      UNION ALL SELECT run_dir, 'seed', -k FROM run_json WHERE purchase)
    SELECT run_dir, metric, {r("CAST(value AS DOUBLE)")} AS value FROM entries""",
)
def numeric_metrics(spark, sf):
    entries = F.explode("eval_metrics").alias("metric", "value")
    return rounded(_scan(spark, sf).select("run_dir", entries))


def _results(spark, sf):
    return V.runs(spark, sf).select(*P1.RESULT_FIELDS)


RESULT_ROWS = f"""WITH {S.RUNS} SELECT run_dir, method, model_name, task_name, seed, train_subset_size,
  primary_metric_name, {r("primary_metric")} AS primary_metric, trainable_parameters,
  trainable_percentage FROM runs"""


@query("s2_read_results", RESULT_ROWS)
def read_results(spark, sf):
    path = scratch_path(spark, "results-json")
    # Every row repeats all names: packed, the table takes a small part of the bytes.
    _results(spark, sf).write.option("compression", "gzip").json(path)
    return rounded(readers.read_results(spark, path, json_lines=True))


@query("s6_write_results_json", f"WITH {EXPANDED} SELECT * FROM expanded")
def write_results_json(spark, sf):
    path = scratch_path(spark, "results-sorted")
    wide = aggregate_runs(spark, _run_files(spark, sf), LINES, one_per_file=False)
    writers.write_results_json(wide, path)
    kinds = {"seed": "double", "train_subset_size": "bigint", "run_dir": "string",
             "method": "string", "primary_metric_name": "string", "note": "string"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in EXPANDED_COLUMNS)
    return rounded(readers.read_results(spark, path, schema, json_lines=True))


@query("s7_write_results_csv", RESULT_ROWS)
def write_results_csv(spark, sf):
    path = scratch_path(spark, "results-csv")
    writers.write_results_csv(_results(spark, sf), path)
    back = spark.read.schema(readers.RESULTS).option("header", True).csv(path)
    return rounded(back)


@query(
    "p5_safe_model_names",
    f"""WITH {S.RUNS} SELECT model_name, replace(model_name, '/', '-') AS encoder_name,
      replace(model_name, '/', '_') AS decoder_name, count(*) AS n_runs FROM runs GROUP BY ALL""",
)
def safe_model_names(spark, sf):
    names = [
        "model_name",
        P.safe_model_name(separator="-").alias("encoder_name"),
        P.safe_model_name(separator="_").alias("decoder_name"),
    ]
    return V.runs(spark, sf).groupBy(*names).agg(F.count(F.lit(1)).alias("n_runs"))


TAG = "CASE WHEN model_name = 'Qwen/Qwen2.5-0.5B' THEN 'decoder' ELSE 'encoder' END"


def _tagged(spark, sf):
    return readers.tag_architecture(V.runs(spark, sf))


@query(
    "p6_run_ids",
    f"""WITH {S.RUNS} SELECT run_dir, CASE WHEN {TAG} = 'decoder' THEN
        concat_ws('__', method, replace(model_name, '/', '_'), task_name, 'n' || train_subset_size,
          's' || seed, strftime(started, '%Y%m%d_%H%M%S'))
      ELSE concat_ws('__', task_name, replace(model_name, '/', '-'), method, 'seed' || seed,
          strftime(started, '%Y%m%d_%H%M%S')) END AS run_id
    FROM runs""",
)
def run_ids(spark, sf):
    return _tagged(spark, sf).select("run_dir", P.run_id().alias("run_id"))


@query(
    "p7_effective_hyperparameters",
    f"""WITH {S.RUNS}, filled AS (
      SELECT run_dir, method, {TAG} AS architecture, num_train_epochs AS epochs,
        coalesce(learning_rate, CASE WHEN {TAG} = 'decoder' THEN 0.0 ELSE 2e-5 END) AS rate FROM runs)
    SELECT run_dir, {r('''CASE WHEN architecture = 'decoder' THEN CASE WHEN rate > 0 THEN rate
          WHEN method = 'full_ft' THEN 2e-5 ELSE 2e-4 END
        WHEN method = 'full_ft' THEN rate ELSE greatest(rate, 2e-4) END''', 7)} AS effective_learning_rate,
      CASE WHEN architecture = 'decoder' OR method = 'full_ft' THEN epochs
        ELSE greatest(epochs, 10.0) END AS effective_epochs
    FROM filled""",
)
def effective_hyperparameters(spark, sf):
    done = P.effective_hyperparameters(P.fill_defaults(_tagged(spark, sf)))
    return rounded(done.select("run_dir", "effective_learning_rate", "effective_epochs"), 7)


@query(
    "p8_architecture",
    f"WITH {S.RUNS} SELECT model_name, {TAG} AS architecture, count(*) AS n_runs FROM runs GROUP BY ALL",
)
def architecture(spark, sf):
    tagged = _tagged(spark, sf)
    return tagged.groupBy("model_name", "architecture").agg(F.count(F.lit(1)).alias("n_runs"))


@query(
    "p9_config_defaults",
    f"""WITH {S.RUNS} SELECT run_dir, {TAG} AS architecture,
      {r(f"coalesce(learning_rate, CASE WHEN {TAG} = 'decoder' THEN 0.0 ELSE 2e-5 END)", 7)} AS learning_rate,
      CASE WHEN {TAG} = 'decoder' THEN 4 ELSE 8 END AS per_device_train_batch_size,
      CASE WHEN {TAG} = 'decoder' THEN 8 ELSE 16 END AS per_device_eval_batch_size,
      256 AS max_length, CASE WHEN {TAG} = 'encoder' THEN 'epoch' END AS eval_strategy, seed
    FROM runs""",
)
def config_defaults(spark, sf):
    filled = P.fill_defaults(_tagged(spark, sf))
    return rounded(
        filled.select(
            "run_dir", "architecture", "learning_rate", "per_device_train_batch_size",
            "per_device_eval_batch_size", "max_length", "eval_strategy", "seed",
        ),
        7,
    )


@query(
    "p10_task_facts",
    f"""WITH {S.RUNS} SELECT task_name,
      CASE WHEN task_name IN ('cola', 'sst2') THEN 'sentence' WHEN task_name = 'qnli' THEN 'question'
        ELSE 'sentence1' END AS text_key_a,
      CASE WHEN task_name = 'qnli' THEN 'sentence' WHEN task_name IN ('mrpc', 'rte') THEN 'sentence2' END AS text_key_b,
      CASE task_name WHEN 'cola' THEN 'matthews_correlation' WHEN 'mrpc' THEN 'f1' ELSE 'accuracy' END AS task_metric,
      2 AS num_labels, count(*) AS n_runs FROM runs GROUP BY task_name""",
)
def task_facts(spark, sf):
    keys = ["task_name", "text_key_a", "text_key_b", "task_metric", "num_labels"]
    joined = P.with_task_facts(V.runs(spark, sf))
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"))


@query(
    "f2_validate_configs",
    f"""WITH {S.RUNS}, tagged AS (SELECT *, {TAG} AS architecture FROM runs)
    SELECT architecture, method, model_name, CASE
      WHEN architecture = 'decoder' AND method = 'topheavy_lora' THEN 'Unsupported method for CausalLM: topheavy_lora'
      WHEN architecture = 'encoder' AND model_name = 'other/bert-large' THEN 'Unsupported model: other/bert-large'
      END AS first_violation, count(*) AS n_runs
    FROM tagged GROUP BY ALL""",
)
def validate_configs(spark, sf):
    checked = P.validate(_tagged(spark, sf))
    keys = ["architecture", "method", "model_name", "first_violation"]
    return checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"))


@query(
    "f7_reject_unknown_method",
    f"""WITH {S.RUN_JSON} SELECT method, method IN ('full_ft', 'lora', 'topheavy_lora', 'bitfit') AS known,
      'Unsupported method: ' || method AS first_violation, 5 AS n_violations, count(*) AS n_runs
    FROM (SELECT method FROM run_json) GROUP BY method""",
)
def reject_unknown_method(spark, sf):
    configs = _scan(spark, sf).select("config.*").withColumn("architecture", F.lit("encoder"))
    regression = configs.withColumn("task_name", F.lit(fv.REGRESSION_TASK)).withColumn(
        "train_subset_size", F.lit(0)
    )
    return (
        P.validate(regression)
        .groupBy(
            "method",
            P.method_known().alias("known"),
            "first_violation",
            F.size("violations").alias("n_violations"),
        )
        .agg(F.count(F.lit(1)).alias("n_runs"))
    )


KEY = "method, model_name, task_name, train_subset_size, seed"


def _values(items):
    return ", ".join(f"({item!r})" for item in items)


def _plan_sql(name, plan):
    def dimension(alias, items, column):
        return f"(VALUES {_values(items)}) {alias}({column})"

    return (
        f"SELECT '{name}' AS architecture, method, model_name, task_name, "
        "CAST(size AS BIGINT) AS train_subset_size, CAST(seed AS BIGINT) AS seed FROM "
        + " CROSS JOIN ".join(
            [
                dimension("m", plan.methods, "method"),
                dimension("o", plan.models, "model_name"),
                dimension("t", plan.tasks, "task_name"),
                dimension("z", plan.sizes, "size"),
                dimension("s", plan.seeds, "seed"),
            ]
        )
    )


PLANNED = (
    f"planned AS ({_plan_sql('encoder', E.ENCODER_PLAN)} UNION ALL "
    f"{_plan_sql('decoder', E.DECODER_PLAN)})"
)


@query(
    "e1_grid_with_run_counts",
    f"""WITH {S.RUNS}, {PLANNED}, found AS (SELECT {KEY}, count(*) AS n FROM runs GROUP BY {KEY})
    SELECT architecture, {KEY}, coalesce(n, 0) AS n_runs FROM planned LEFT JOIN found USING ({KEY})""",
)
def grid_with_run_counts(spark, sf):
    return E.runs_per_cell(V.runs(spark, sf))


# All methods, models and tasks, one size and one seed more than were run.
LARGER_PLAN = dataclasses.replace(
    E.ENCODER_PLAN, sizes=[*E.ENCODER_PLAN.sizes, 300], seeds=[*E.ENCODER_PLAN.seeds, 7]
)


@query(
    "e2_missing_cells",
    f"""WITH {S.RUNS}, planned AS ({_plan_sql('encoder', LARGER_PLAN)}) SELECT architecture, {KEY} FROM planned
    WHERE ({KEY}) NOT IN (SELECT ({KEY}) FROM runs)""",
)
def missing_cells(spark, sf):
    return E.missing_cells(V.runs(spark, sf), [LARGER_PLAN])


@query(
    "e2_off_grid_runs",
    f"""WITH {S.RUNS}, {PLANNED} SELECT run_dir, {KEY} FROM runs
    WHERE ({KEY}) NOT IN (SELECT ({KEY}) FROM planned)""",
)
def off_grid_runs(spark, sf):
    return E.off_grid_runs(V.runs(spark, sf)).select("run_dir", *E.RUN_KEY)


LINE_KEY = ["l_orderkey", "l_linenumber"]


@query(
    "e3_duplicate_groups",
    f"""WITH {S.RUNS} SELECT l_orderkey, l_linenumber, count(*) AS n_runs, min(run_dir) AS first_run,
      max(run_dir) AS last_run FROM runs GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def duplicate_groups(spark, sf):
    return E.duplicate_groups(V.runs(spark, sf), LINE_KEY)


@query(
    "e3_duplicate_count",
    f"""WITH {S.RUNS} SELECT count(*) AS n_runs, count(DISTINCT (l_orderkey, l_linenumber)) AS n_unique,
      count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_surplus FROM runs""",
)
def duplicate_count(spark, sf):
    return E.duplicate_count(V.runs(spark, sf), LINE_KEY)


@query(
    "e3_keep_one_run",
    f"""WITH {S.RUNS} SELECT l_orderkey, l_linenumber, run_dir, method FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY run_dir DESC) AS place
      FROM runs) WHERE place = 1""",
)
def keep_one_run(spark, sf):
    return E.deduplicate(V.runs(spark, sf).select(*LINE_KEY, "run_dir", "method"), LINE_KEY)


@query(
    "e3_keep_one_run_from_buckets",
    f"""WITH {S.RUNS} SELECT {", ".join(RUN_KEY)}, max(run_dir) AS run_dir FROM runs GROUP BY {", ".join(RUN_KEY)}""",
)
def keep_one_run_from_buckets(spark, sf):
    """One run per configuration over a table in buckets: nothing is shuffled to rank them."""
    return E.deduplicate(bucketed_runs(spark, sf).select(*RUN_KEY, "run_dir"))


def bucketed_runs(spark, sf):
    path = scratch_path(spark, "run-table")
    kept = V.runs(spark, sf).select(*RUN_KEY, "run_dir", "primary_metric")
    return writers.write_run_table(kept, f"runs_{path.rsplit('-', 1)[1]}", path)


@query(
    "f1_one_method_from_its_folder",
    f"""WITH {S.RUNS}, tagged AS (SELECT *, {TAG} AS architecture FROM runs)
    SELECT architecture, CAST(train_subset_size AS DOUBLE) AS n, {r("avg(primary_metric)")} AS mean,
      count(*) AS cnt FROM tagged WHERE method = 'bitfit' GROUP BY architecture, train_subset_size""",
)
def one_method_from_its_folder(spark, sf):
    path = scratch_path(spark, "results-table")
    writers.write_results_table(_tagged(spark, sf).select(*P1.RESULT_FIELDS, "architecture"), path)
    bitfit = spark.read.parquet(path).where("method = 'bitfit'")
    return rounded(learning_curve(bitfit, ["architecture"]).drop("std", "error"))


@query(
    "e4_run_counts",
    f"""WITH {S.RUNS} SELECT coalesce({TAG}, 'all') AS architecture, count(*) AS n_runs FROM runs GROUP BY 1
    UNION ALL SELECT 'all', count(*) FROM runs""",
)
def run_counts(spark, sf):
    return E.run_counts(_tagged(spark, sf))


@query(
    "e5_methods_in_order",
    f"WITH {S.RUNS} SELECT method, min(run_dir) AS first_seen FROM runs GROUP BY method",
)
def methods_in_order(spark, sf):
    return E.methods_in_order(V.runs(spark, sf), "run_dir")


KEY_COLUMNS = ["method", "model_name", "task_name", "train_subset_size", "seed", "l_orderkey"]


def _lattice_sql():
    """Every subset counted on its own, and keys found by comparing all pairs of subsets."""
    subsets = [c for size in range(1, len(KEY_COLUMNS) + 1) for c in itertools.combinations(KEY_COLUMNS, size)]
    counted = " UNION ALL ".join(
        f"SELECT '{'+'.join(c)}' AS columns, {sum(1 << KEY_COLUMNS.index(x) for x in c)} AS bits, {len(c)} AS n_columns, "
        f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(c)} FROM kept)) AS n_unique"
        for c in subsets
    )
    return f"""WITH {S.RUNS}, kept AS MATERIALIZED (SELECT {", ".join(KEY_COLUMNS)} FROM runs),
    counted AS ({counted}), judged AS (
      SELECT *, n_unique = (SELECT max(n_unique) FROM counted) AS is_key FROM counted)
    SELECT columns, CAST(n_columns AS INTEGER) AS n_columns, n_unique,
      (SELECT count(*) FROM kept) - n_unique AS n_surplus, is_key,
      is_key AND NOT EXISTS (SELECT 1 FROM judged b WHERE b.is_key AND b.bits <> a.bits AND (b.bits & a.bits) = b.bits) AS is_minimal,
      n_unique = 700 AS matches FROM judged a"""


@query("e3_minimal_keys", _lattice_sql())
def minimal_keys(spark, sf):
    """Unique counts of all subsets of the columns, the minimal keys, and the subset behind a count of 700."""
    return key_lattice(V.runs(spark, sf), KEY_COLUMNS, unique=700)
