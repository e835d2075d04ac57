"""Writers: results, fit documents, run records, figure series."""

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curvekit import fixed_values as fv
from curvekit.schema import RUN_KEY
from curvekit.session import materialize

DOCUMENT_ENTRIES = 10_000
#: Runs whose folders one task makes. A folder costs far more than its few bytes, by which AQE would give all to one task.
RUNS_PER_TASK = 50
FIT_FIELDS = (
    "method", "a", "b", "c", "r2", "n_points", "sample_sizes", "error_rates", "fitted_values",
)


def write_results_json(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines with sorted keys; absent values have no key."""
    results.select(*sorted(results.columns)).write.mode(mode).json(path)


def write_results_csv(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and no index. Nested columns have no CSV form: expand or drop them first."""
    nested = [name for name, kind in results.dtypes if kind.startswith(("map", "array", "struct"))]
    if nested:
        raise ValueError(f"no CSV form for {', '.join(nested)}")
    results.write.mode(mode).option("header", True).csv(path)


def write_results_table(
    results: DataFrame,
    path: str,
    by: Sequence[str] = ("architecture", "method"),
    mode: str = "overwrite",
) -> None:
    """Results as Parquet in one folder per architecture and method.

    Reading one method (`where method = …`) then opens only its folders. Rows are not
    shuffled: a method with most of the runs is written by all tasks.
    """
    results.write.mode(mode).partitionBy(*by).parquet(path)


def write_run_table(
    results: DataFrame,
    table: str,
    path: str,
    by: Sequence[str] = ("task_name", "model_name", "train_subset_size"),
    buckets: int = 64,
) -> DataFrame:
    """Results as a table in buckets of `by`, sorted in each, with its files at `path`; returns the table.

    Whatever groups, ranks or joins runs by these columns and more, such as keeping one run per configuration or
    pairing methods by seed, then needs no exchange: rows are shuffled once, here. One bucket holds whole
    combinations of `by`; name more columns, such as the seed, where few combinations hold most of the runs.
    """
    order = [*by, *[c for c in RUN_KEY if c not in by and c in results.columns]]
    (
        results.repartition(buckets, *by)
        .write.mode("overwrite")
        .format("parquet")
        .option("path", path)
        .bucketBy(buckets, *by)
        .sortBy(*order)
        .saveAsTable(table)
    )
    return results.sparkSession.table(table)


def fit_document(
    fits: DataFrame, crossovers: DataFrame, runs: DataFrame, order: str | None = None
) -> DataFrame:
    """One row with the fit document {fits, crossovers, metadata} as text.

    The document is a single object with one entry per method, so only fits, keyed
    crossovers (pair, n_cross) and the list of methods are gathered; more than
    `DOCUMENT_ENTRIES` of them is an error, and such fits belong in a table (write_series).
    Methods and fits are listed in the order of their smallest `order` value: by default the file
    in which a method is first seen, for runs that scan_runs() has read, else the name. Fits of
    several groups have a document of their own, see published_fit_document().
    """
    if order is None and "source_file" in runs.columns:
        order = "source_file"
    few = F.raise_error(F.lit("too many entries for one document; write them as a table"))

    def gathered(rows) -> Column:
        count = F.count(F.lit(1))
        return F.when(count > DOCUMENT_ENTRIES, few).otherwise(F.sort_array(F.collect_list(rows)))

    place = F.min(order) if order else F.min("method")
    counted = runs.groupBy("method").agg(F.count(F.lit(1)).alias("n"), place.alias("place"))
    named = F.when(F.col("method").isNotNull(), F.struct("place", "method"))
    per_method = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_runs"),
        F.transform(gathered(named), lambda m: m["method"]).alias("methods"),
    )
    entry = F.struct(*FIT_FIELDS, F.array("se_a", "se_b", "se_c").alias("perr"))
    listed = fits.where("a is not null").join(counted.select("method", "place"), "method", "left")
    in_order = gathered(F.struct("place", "method", entry.alias("fit")))
    fitted = listed.agg(
        F.map_from_entries(F.transform(in_order, lambda x: F.struct(x["method"], x["fit"]))).alias("fits")
    )
    crossed = crossovers.agg(
        F.map_from_entries(gathered(F.struct("pair", "n_cross"))).alias("crossovers")
    )
    facts = per_method.select(
        F.struct("total_runs", "methods", F.lit(fv.FORMULA).alias("formula"))
    )
    whole = fitted.withColumns({"crossovers": crossed.scalar(), "metadata": facts.scalar()})
    document = F.struct("fits", "crossovers", "metadata")
    return whole.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))


def published_fit_document(
    fits: DataFrame, by: Sequence[str] = ("architecture",), digits: int | None = None
) -> DataFrame:
    """One row with the fits of several groups as a flat map, the shape in which fits are published.

    An entry is named by its groups, capitalised, and its method, joined by `_`, and holds a, b, c and R2, rounded
    to `digits` where given. Entries are ordered by name; groups with a null name have no entry. More than
    `DOCUMENT_ENTRIES` entries, and two of the same name, are errors.
    """
    few = F.raise_error(F.lit("too many entries for one document; write them as a table"))
    values = [
        (F.round(c, digits) if digits is not None else F.col(c)).alias(name)
        for c, name in (("a", "a"), ("b", "b"), ("c", "c"), ("r2", "R2"))
    ]
    name = F.concat_ws("_", *[F.initcap(F.col(c)) for c in by], "method")
    entries = F.sort_array(F.collect_list(F.struct(name.alias("name"), F.struct(*values).alias("fit"))))
    present = [F.col(c).isNotNull() for c in (*by, "method", "a")]
    return (
        fits.where(reduce(and_, present))
        .agg(F.when(F.count(F.lit(1)) > DOCUMENT_ENTRIES, few).otherwise(F.map_from_entries(entries)).alias("fits"))
        .select(F.to_json("fits").alias("value"))
    )


def write_fit_document(document: DataFrame, path: str, mode: str = "overwrite") -> None:
    document.write.mode(mode).text(path)


def _sorted_keys(column: Column, kind: StructType) -> Column:
    """A record with its names in order at every level."""
    fields = sorted(kind.fields, key=lambda f: f.name)
    rebuilt = F.struct(
        *[
            (_sorted_keys(column[f.name], f.dataType) if isinstance(f.dataType, StructType) else column[f.name]).alias(f.name)
            for f in fields
        ]
    )
    return F.when(column.isNotNull(), rebuilt)


def write_run_records(
    records: DataFrame, root: str, run: str = "run_dir", mode: str = "overwrite"
) -> None:
    """Config and metrics of every run as JSON, one folder per run under two trees.

    The records are computed once and spread by run, so a run's folder gets one file, over as many tasks as there
    are RUNS_PER_TASK of them. Keys are sorted at every level.
    """
    ordered = records.select(
        *[
            (_sorted_keys(F.col(f.name), f.dataType) if isinstance(f.dataType, StructType) else F.col(f.name)).alias(f.name)
            for f in sorted(records.schema.fields, key=lambda f: f.name)
        ]
    )
    written = materialize(ordered.withColumn("run_id", F.col(run)), "records")
    spread = written.repartition(max(1, math.ceil(written.count() / RUNS_PER_TASK)), "run_id")
    spread.select("run_id", "config.*").write.mode(mode).partitionBy("run_id").json(f"{root}/config")
    spread.select("run_id", *ordered.columns).write.mode(mode).partitionBy("run_id").json(f"{root}/metrics")


def write_series(
    series: DataFrame, path: str, by: Sequence[str] = ("series",), mode: str = "overwrite"
) -> None:
    """Figure data as Parquet, one folder per kind of series."""
    series.write.mode(mode).partitionBy(*by).parquet(path)
