"""Evaluation metrics, parameter counts and run records built from them."""

from pyspark.sql import functions as F

from curvekit.operators import config as P
from curvekit.operators import metrics as M
from curvekit.operators.flatten import flatten_runs
from curvekit.session import scratch_path
from curvekit.sources import readers, writers
from registry import check_sql as S
from registry import views as V
from registry.catalog import query, r, rounded

LOGITS = """logits AS (
  SELECT vec_id AS example_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
predicted AS (
  SELECT example_id, label, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS pred FROM logits)"""


def _predicted(spark, sf):
    return V.logits(spark, sf).withColumn("pred", M.argmax("logits"))


@query("m1_argmax", f"WITH {LOGITS} SELECT example_id, label, pred FROM predicted")
def argmax(spark, sf):
    return _predicted(spark, sf).select("example_id", "label", "pred")


@query(
    "m2_accuracy",
    f"""WITH {LOGITS} SELECT label, count(*) AS n, {r("avg(CAST(pred = label AS DOUBLE))")} AS accuracy
    FROM predicted GROUP BY label""",
)
def accuracy(spark, sf):
    return rounded(M.accuracy(_predicted(spark, sf), ["label"]))


def _counted(keys, source="predictions"):
    return f"counted AS (SELECT {keys}, {S.CONFUSION} FROM {source} GROUP BY {keys})"


@query(
    "m3_f1",
    f"WITH {S.PREDICTIONS}, {_counted('lang')} SELECT lang, {r(S.F1)} AS f1 FROM counted",
)
def f1(spark, sf):
    return rounded(M.f1_score(V.class_predictions(spark, sf), ["lang"]))


@query(
    "m4_matthews_correlation",
    f"WITH {S.PREDICTIONS}, {_counted('lang')} SELECT lang, {r(S.MCC)} AS matthews_correlation FROM counted",
)
def matthews(spark, sf):
    return rounded(M.matthews_correlation(V.class_predictions(spark, sf), ["lang"]))


SCORED = f"""{S.PREDICTIONS}, {_counted("run_id, task")}, scored AS (
  SELECT run_id, task, n, CAST(n_right AS DOUBLE) / n AS accuracy,
    CASE WHEN task = 'mrpc' THEN {S.F1} END AS f1,
    CASE WHEN task = 'cola' THEN {S.MCC} END AS matthews_correlation,
    CASE task WHEN 'mrpc' THEN 'f1' WHEN 'cola' THEN 'matthews_correlation' ELSE 'accuracy' END AS primary_metric_name
  FROM counted), full_scores AS (
  SELECT *, coalesce(f1, matthews_correlation, accuracy) AS primary_metric FROM scored)"""


@query(
    "m5_primary_metric",
    f"""WITH {SCORED} SELECT run_id, primary_metric_name, {r("primary_metric")} AS primary_metric,
      {r("primary_metric")} AS eval_primary_metric FROM full_scores""",
)
def primary_metric(spark, sf):
    done = M.task_metrics(V.class_predictions(spark, sf))
    return rounded(
        done.select("run_id", "primary_metric_name", "primary_metric", "eval_primary_metric")
    )


@query(
    "m6_generated_text_score",
    f"""WITH g AS (SELECT lang AS run_id, text AS generated,
        CASE WHEN quality = 1 THEN 'es' ELSE 'no' END AS expected
      FROM documents JOIN labels USING (doc_id))
    SELECT run_id, count(*) FILTER (contains(lower(generated), expected)) AS correct, count(*) AS total,
      {r("CAST(count(*) FILTER (contains(lower(generated), expected)) AS DOUBLE) / count(*)")} AS accuracy
    FROM g GROUP BY run_id""",
)
def generated_text_score(spark, sf):
    return rounded(M.generated_score(V.generated_text(spark, sf)))


def _inventory(spark, sf):
    return V.parameter_inventory(spark, sf).withColumn(
        "is_adapter", F.contains("name", F.lit("ring"))
    ).withColumn("requires_grad", F.col("is_adapter"))


BITFIT = "(name LIKE '%bias' OR contains(name, 'classifier') OR contains(name, 'score'))"


@query(
    "f6_trainable_masks",
    f"""WITH {S.PARAMETERS} SELECT model, count(*) AS n_full,
      count(*) FILTER ({BITFIT}) AS n_bitfit_encoder,
      count(*) FILTER (contains(name, 'bias')) AS n_bitfit_decoder,
      count(*) FILTER (contains(name, 'ring')) AS n_adapter
    FROM parameters GROUP BY model""",
)
def trainable_masks(spark, sf):
    return (
        _inventory(spark, sf)
        .groupBy("model")
        .agg(
            F.count_if(M.trainable_mask("full_ft")).alias("n_full"),
            F.count_if(M.trainable_mask("bitfit")).alias("n_bitfit_encoder"),
            F.count_if(M.trainable_mask("bitfit", "decoder")).alias("n_bitfit_decoder"),
            F.count_if(M.trainable_mask("lora")).alias("n_adapter"),
        )
    )


def _counts_sql(total):
    return f"""WITH {S.PARAMETERS} SELECT model, CAST({total} AS BIGINT) AS total_parameters,
      CAST(coalesce(sum(numel) FILTER ({BITFIT}), 0) AS BIGINT) AS trainable_parameters,
      {r(f"100.0 * CAST(coalesce(sum(numel) FILTER ({BITFIT}), 0) AS DOUBLE) / {total}")} AS trainable_percentage
    FROM parameters GROUP BY model"""


@query("m7_parameter_counts", _counts_sql("sum(numel)"))
def parameter_counts(spark, sf):
    inventory = _inventory(spark, sf).withColumn("trainable", M.trainable_mask("bitfit"))
    return rounded(M.count_parameters(inventory))


@query(
    "m7_parameter_counts_base", _counts_sql("sum(numel) FILTER (NOT contains(name, 'ring'))")
)
def parameter_counts_base(spark, sf):
    inventory = _inventory(spark, sf).withColumn("trainable", M.trainable_mask("bitfit"))
    return rounded(M.count_parameters(inventory, denominator="base"))


@query(
    "m8_task_metrics",
    f"""WITH {SCORED} SELECT run_id, task, n, {r("accuracy")} AS accuracy, {r("f1")} AS f1,
      {r("matthews_correlation")} AS matthews_correlation, primary_metric_name,
      {r("primary_metric")} AS primary_metric, {r("primary_metric")} AS eval_primary_metric,
      {r("CASE WHEN task IN ('sst2', 'rte') THEN accuracy END")} AS eval_accuracy, {r("f1")} AS eval_f1,
      {r("matthews_correlation")} AS eval_matthews_correlation, 'ok' AS status FROM full_scores""",
)
def task_metrics(spark, sf):
    return rounded(M.task_metrics(V.class_predictions(spark, sf)))


def _records(spark, sf):
    """Run records of the predictions: a run per (language, source), counts from `part`."""
    scores = M.task_metrics(V.class_predictions(spark, sf))
    method = F.when(F.col("run_id").startswith("en"), "bitfit").otherwise("full_ft")
    configs = scores.select(
        "run_id",
        F.lit("encoder").alias("architecture"),
        method.alias("method"),
        F.lit("bert-base-uncased").alias("model_name"),
        F.col("task").alias("task_name"),
        F.lit(42).cast("bigint").alias("seed"),
        F.col("n").alias("train_subset_size"),
    )
    brand = F.concat(F.lit("Brand#"), F.regexp_extract("run_id", r"(\d+)$", 1))
    inventory = _inventory(spark, sf).withColumn("trainable", M.trainable_mask("bitfit"))
    counts = M.count_parameters(inventory)
    stats = (
        scores.select("run_id", brand.alias("model"))
        .join(counts, "model", "left")
        .drop("model")
    )
    metrics = scores.select("run_id", "eval_primary_metric", F.col("accuracy").alias("eval_accuracy"))
    return P.assemble_records(configs, stats, metrics)


RECORDS = f"""{SCORED}, {S.PARAMETERS}, counts AS (
  SELECT model, CAST(coalesce(sum(numel) FILTER ({BITFIT}), 0) AS BIGINT) AS trainable_parameters,
    100.0 * CAST(coalesce(sum(numel) FILTER ({BITFIT}), 0) AS DOUBLE) / sum(numel) AS trainable_percentage
  FROM parameters GROUP BY model), records AS (
  SELECT run_id AS run_dir, CASE WHEN run_id LIKE 'en%' THEN 'bitfit' ELSE 'full_ft' END AS method,
    task AS task_name, CAST(42 AS BIGINT) AS seed, n AS train_subset_size, primary_metric_name,
    primary_metric, trainable_parameters, trainable_percentage, accuracy
  FROM full_scores LEFT JOIN counts ON model = 'Brand#' || regexp_extract(run_id, '(\\d+)$', 1))"""


@query(
    "p13_assemble_run_records",
    f"""WITH {RECORDS} SELECT run_dir, method, task_name, trainable_parameters,
      CASE WHEN method = 'bitfit' THEN 'train_bias_only' END AS adapter_strategy,
      {r("primary_metric")} AS eval_primary_metric, {r("accuracy")} AS eval_accuracy,
      primary_metric_name FROM records""",
)
def assemble_run_records(spark, sf):
    records = _records(spark, sf).select(
        "run_dir",
        "config.method",
        "config.task_name",
        "parameter_stats.trainable_parameters",
        F.col("method_notes")["adapter_strategy"].alias("adapter_strategy"),
        F.col("eval_metrics")["eval_primary_metric"].alias("eval_primary_metric"),
        F.col("eval_metrics")["eval_accuracy"].alias("eval_accuracy"),
        "primary_metric_name",
    )
    return rounded(records)


@query(
    "s9_write_run_records",
    f"""WITH {RECORDS} SELECT run_dir, method, 'bert-base-uncased' AS model_name, task_name, seed,
      train_subset_size, primary_metric_name, {r("primary_metric")} AS primary_metric,
      trainable_parameters, {r("trainable_percentage")} AS trainable_percentage FROM records""",
)
def write_run_records(spark, sf):
    root = scratch_path(spark, "run-records")
    writers.write_run_records(_records(spark, sf), root)
    back = readers.scan_runs(spark, f"{root}/metrics", "*/part-*.json", one_per_file=False)
    return rounded(flatten_runs(back).drop("eval_metrics", "eval_texts", "metric_keys", "architecture", "source_file"))
