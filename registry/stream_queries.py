"""Streaming jobs, each drained over the whole runs view and read back."""

from pyspark.sql import functions as F

from curvekit.operators.crossover import crossovers
from curvekit.session import materialize, scratch_path
from curvekit.streaming import incremental as W
from registry import check_sql as S
from registry import views as V
from registry.catalog import query, r, rounded
from registry.curve_queries import CROSSED, PARAMETERS, PRECISION

LINES = "*/part-*.json"
#: Tasks that write the run records at most. A batch takes so many files, so more input makes larger files, not more batches.
LANDING_TASKS = 32


def _landing(spark, sf):
    """Run records of the runs view as JSON Lines, one folder per method.

    A run is named by its order line and the order's date, so order lines that occur
    several times are repeated runs.
    """
    root = scratch_path(spark, "landing")
    ordered = F.date_format("ordered", "yyyyMMdd_HHmmss")
    stamped = F.concat_ws("__", "l_orderkey", "l_linenumber", ordered)
    V.runs(spark, sf).select(
        stamped.alias("run_dir"),
        F.struct("method", "seed", "train_subset_size").alias("config"),
        F.struct(F.col("primary_metric").alias("eval_primary_metric")).alias("eval_metrics"),
        F.col("method").alias("folder"),
    ).coalesce(LANDING_TASKS).write.partitionBy("folder").json(root)
    return root


def _stream(spark, sf):
    return W.stream_runs(spark, _landing(spark, sf), LINES, one_per_file=False, files_per_batch=16)


@query(
    "w1_streaming_curve",
    f"WITH {S.METHOD_RUNS}, {S.curve()} SELECT method, n, {r('mean')} AS mean, cnt FROM points",
)
def streaming_curve(spark, sf):
    target, checkpoint = scratch_path(spark, "stream-curve"), scratch_path(spark, "stream-state")
    W.maintain_curve(_stream(spark, sf), target, checkpoint, drain=True).awaitTermination()
    return rounded(W.latest_version(spark, target).select("method", "n", "mean", "cnt"))


@query(
    "w2_streaming_unique_runs",
    f"""WITH {S.RUNS} SELECT DISTINCT
      concat_ws('__', l_orderkey, l_linenumber, strftime(ordered, '%Y%m%d_%H%M%S')) AS run_dir,
      strftime(ordered, '%Y-%m-%d') AS started FROM runs""",
)
def streaming_unique_runs(spark, sf):
    target, checkpoint = scratch_path(spark, "stream-unique"), scratch_path(spark, "stream-state")
    runs = _stream(spark, sf).select("run_dir")
    unique = W.drop_repeated_runs(runs)
    W.append_runs(unique, target, checkpoint, drain=True).awaitTermination()
    started = F.date_format("started", "yyyy-MM-dd")
    return spark.read.parquet(target).select("run_dir", started.alias("started"))


@query(
    "w2_unique_runs_without_horizon",
    f"""WITH {S.RUNS} SELECT DISTINCT
      concat_ws('__', l_orderkey, l_linenumber, strftime(ordered, '%Y%m%d_%H%M%S')) AS run_dir FROM runs""",
)
def unique_runs_without_horizon(spark, sf):
    target, checkpoint = scratch_path(spark, "unique-runs"), scratch_path(spark, "stream-state")
    names = _stream(spark, sf).select("run_dir")
    W.append_new_runs(names, target, checkpoint, drain=True).awaitTermination()
    return W.unique_runs(spark, target)


@query(
    "w3_streaming_refit",
    f"""{CROSSED} SELECT method, 'ok' AS fit_status, {PARAMETERS}, {r("n_cross", 2)} AS n_cross
    FROM fits LEFT JOIN crossings USING (method)""",
)
def streaming_refit(spark, sf):
    target, checkpoint = scratch_path(spark, "stream-fits"), scratch_path(spark, "stream-state")
    W.maintain_fits(_stream(spark, sf), target, checkpoint, drain=True).awaitTermination()
    return rounded(W.latest_version(spark, target), **PRECISION)


@query(
    "w1_upserted_curve",
    f"""WITH {S.RUNS}, {S.curve("runs", "task_name, method")}
    SELECT task_name, method, n, {r("mean")} AS mean, {r("std")} AS std, cnt, {r("error")} AS error FROM points""",
)
def upserted_curve(spark, sf):
    """The curve by task in update mode: each batch writes the points that it changed."""
    target, checkpoint = scratch_path(spark, "upserted-curve"), scratch_path(spark, "stream-state")
    keys = ["task_name", "method"]
    W.upsert_curve(_task_stream(spark, sf), target, checkpoint, keys, drain=True).awaitTermination()
    return rounded(W.current_curve(spark, target, keys))


def _task_stream(spark, sf):
    """Run records with their task as JSON Lines, in files that make several batches."""
    root = scratch_path(spark, "landing")
    V.runs(spark, sf).select(
        "run_dir",
        F.struct("method", "seed", "train_subset_size", "task_name").alias("config"),
        F.struct(F.col("primary_metric").alias("eval_primary_metric")).alias("eval_metrics"),
        F.col("method").alias("folder"),
    ).coalesce(LANDING_TASKS).write.partitionBy("folder").json(root)
    return W.stream_runs(spark, root, LINES, one_per_file=False, files_per_batch=8)


@query(
    "w3_upserted_fits",
    f"""WITH RECURSIVE {S.RUNS}, {S.curve("runs", "task_name, method")}, {S.fits(keys="task_name, method")},
      {S.crossings("task_name")}
    SELECT task_name, method, 'ok' AS fit_status, {r("b", 2)} AS b, {r("r2", 4)} AS r2, n_points,
      {r("n_cross", 1)} AS n_cross FROM fits LEFT JOIN crossings USING (task_name, method)""",
)
def upserted_fits(spark, sf):
    """Fits by task, refitted batch by batch where a batch has new runs; crossovers of the fits as they stand."""
    curve, fits = scratch_path(spark, "upserted-curve"), scratch_path(spark, "upserted-fits")
    checkpoint, by = scratch_path(spark, "stream-state"), ["task_name"]
    W.upsert_fits(_task_stream(spark, sf), curve, fits, checkpoint, by, drain=True).awaitTermination()
    current = materialize(W.current_fits(spark, fits, by), "current-fits")
    found = crossovers(current, by).select(*by, "method", "n_cross")
    shown = current.select(*by, "method", "fit_status", "b", "r2", "n_points").join(found, [*by, "method"], "left")
    return rounded(shown, b=2, r2=4, n_cross=1)
