"""Curves, duplicate suppression and refits while run files keep arriving."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curvekit.operators.crossover import crossovers
from curvekit.operators.curves import learning_curve
from curvekit.operators.fit import SHIPPED_BOUNDS, Bounds, fit_written_curve
from curvekit.operators.flatten import flatten_runs, with_numeric_metrics
from curvekit.schema import RUN_RECORD
from curvekit.sources.readers import RUN_FILES
from curvekit.streaming import upserts

#: How many versions stay of a table that is written whole.
KEPT_VERSIONS = 3
RUN_STAMP = r"(\d{8}_\d{6})$"


def stream_runs(
    spark: SparkSession,
    root: str,
    files: str = RUN_FILES,
    one_per_file: bool = True,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Flat results rows of run files as they appear; metrics stay a map."""
    records = (
        spark.readStream.schema(RUN_RECORD)
        .option("multiLine", one_per_file)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(f"{root}/{files}")
    )
    return flatten_runs(with_numeric_metrics(records))


def started_at(run_dir: str = "run_dir"):
    """Start time of a run from the stamp that ends its name; null if it has none."""
    stamp = F.nullif(F.regexp_extract(run_dir, RUN_STAMP, 1), F.lit(""))
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))


def drop_repeated_runs(runs: DataFrame, delay: str = "7 days") -> DataFrame:
    """Pass each run name once; a name is forgotten `delay` after it arrived.

    The state holds the names of one delay, spread by name. It is timed by arrival, not by
    the stamp in the name: no run is ever late, so an old run that is uploaded today is
    kept, and a copy that comes after the delay is let through rather than lost.
    """
    return (
        runs.withColumns({"started": started_at(), "arrived": F.current_timestamp()})
        .withWatermark("arrived", delay)
        .dropDuplicatesWithinWatermark(["run_dir"])
        .drop("arrived")
    )


def _start(
    df: DataFrame, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None], drain: bool
) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(each).start()


def _publish(table: DataFrame, target: str, batch: int, keep: int) -> None:
    """Write a version, name it as published once it is whole, and drop those before the last `keep`.

    A batch that runs again after a failure replaces its own version.
    """
    spark = table.sparkSession
    table.write.mode("overwrite").parquet(f"{target}/version={batch}")
    upserts.publish(spark, target, batch)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/version={batch - keep}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def maintain_curve(
    runs: DataFrame,
    target: str,
    checkpoint: str,
    keys=("method",),
    drain: bool = False,
    keep: int = KEPT_VERSIONS,
) -> StreamingQuery:
    """Keep the learning curve at `target` current; the state is one row per (keys, N).

    Each batch writes a new version folder and publishes its number afterwards. Readers that use
    latest_version() never see half of one; `keep` versions stay for readers under way.
    """

    def publish(curve: DataFrame, batch: int) -> None:
        _publish(curve, target, batch, keep)

    return _start(learning_curve(runs, keys), "complete", checkpoint, publish, drain)


def maintain_fits(
    runs: DataFrame,
    target: str,
    checkpoint: str,
    bounds: Bounds = SHIPPED_BOUNDS,
    drain: bool = False,
    by: Sequence[str] = (),
    keep: int = KEPT_VERSIONS,
) -> StreamingQuery:
    """Refit all methods within each `by` group, and their crossovers, after every batch.

    A batch's curve and fits are cached while it is worked on and leave no files behind.
    """
    keys = [*by, "method"]

    def refit(curve: DataFrame, batch: int) -> None:
        snapshot = curve.persist()
        fits = fit_written_curve(snapshot, keys, bounds).persist()
        found = crossovers(fits, by).select(*keys, "n_cross")
        fitted = fits.select(*keys, "fit_status", "a", "b", "c", "r2").join(found, keys, "left")
        _publish(fitted, target, batch, keep)
        fits.unpersist()
        snapshot.unpersist()

    return _start(learning_curve(runs, keys), "complete", checkpoint, refit, drain)


def upsert_curve(
    runs: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = ("method",), drain: bool = False
) -> StreamingQuery:
    """Keep the learning curve at `target` current in update mode: a batch writes the (keys, N) that it changed.

    The state holds the moments of each (keys, N). What is written, and what is read of the state, follows the batch and not
    the curve. current_curve() reads the result. Use one target per checkpoint.
    """

    def write(changed: DataFrame, batch: int) -> None:
        upserts.upsert(changed, target, [*keys, "n"], batch)
        upserts.publish(changed.sparkSession, target, batch)

    return _start(learning_curve(runs, keys), "update", checkpoint, write, drain)


def current_curve(spark: SparkSession, target: str, keys: Sequence[str] = ("method",)) -> DataFrame:
    """The newest curve kept by upsert_curve() or upsert_fits(), a row per (keys, N)."""
    return upserts.rows_of(spark, target, [*keys, "n"])


def upsert_fits(
    runs: DataFrame,
    curve_target: str,
    fits_target: str,
    checkpoint: str,
    by: Sequence[str] = (),
    bounds: Bounds = SHIPPED_BOUNDS,
    drain: bool = False,
) -> StreamingQuery:
    """As upsert_curve(), and after each batch the fits of the groups (by, method) that it changed.

    Only these groups' points are read and fitted; the fits of all others stay as they are. current_fits()
    reads the result. Both tables are published when both are written.
    """
    keys = [*by, "method"]

    def write(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        upserts.upsert(changed, curve_target, [*keys, "n"], batch)
        curve = upserts.rows_of(spark, curve_target, [*keys, "n"], batch)
        groups = upserts.changed_in(spark, curve_target, batch).select(*keys).distinct()
        points = curve.join(groups, keys, "left_semi").persist()
        upserts.upsert(fit_written_curve(points, keys, bounds), fits_target, keys, batch)
        points.unpersist()
        upserts.publish(spark, curve_target, batch)
        upserts.publish(spark, fits_target, batch)

    return _start(learning_curve(runs, keys), "update", checkpoint, write, drain)


def append_new_runs(
    runs: DataFrame, target: str, checkpoint: str, key: str = "run_dir", drain: bool = False
) -> StreamingQuery:
    """Pass each run name once, however long ago it came: no watermark and no state, the result is the memory.

    A batch looks its names up in what earlier batches have written. While the batch is small its names are
    broadcast and the written table is scanned in one column, not shuffled. A batch that runs again sees the
    versions before its own only. unique_runs() reads the result; rows without a name are dropped.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        arrived = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).persist()
        new = arrived
        if number:
            names = arrived.select(key)
            known = upserts.changes_of(spark, target, number - 1).select(key).join(names, key, "left_semi").distinct()
            new = arrived.join(known, key, "left_anti")
        upserts.upsert(new, target, [key], number)
        upserts.publish(spark, target, number)
        arrived.unpersist()

    return _start(runs, "append", checkpoint, write, drain)


def unique_runs(spark: SparkSession, target: str, key: str = "run_dir") -> DataFrame:
    """The rows kept by append_new_runs()."""
    return upserts.rows_of(spark, target, [key])


def current_fits(spark: SparkSession, fits_target: str, by: Sequence[str] = ()) -> DataFrame:
    """The newest fits kept by upsert_fits(), a row per (by, method), with columns as fit_power_law() has them."""
    return upserts.rows_of(spark, fits_target, [*by, "method"])


def append_runs(runs: DataFrame, target: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Append rows to a Parquet table, exactly once."""
    writer = runs.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    return writer.format("parquet").start(target)


def latest_version(spark: SparkSession, target: str) -> DataFrame:
    """Newest published version of a maintained table; only its folder is read."""
    return spark.read.parquet(f"{target}/version={upserts.published(spark, target)}")
