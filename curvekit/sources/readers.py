"""Readers: run records, results tables, fit documents, labelled text."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvekit.operators.config import architecture
from curvekit.operators.flatten import with_numeric_metrics
from curvekit.schema import FIT_DOCUMENT, PUBLISHED_FITS, RESULTS, RUN_RECORD

RUN_FILES = "*/metrics.json"


def scan_runs(
    spark: SparkSession, root: str, files: str = RUN_FILES, one_per_file: bool = True
) -> DataFrame:
    """Run records one level below a folder; `source_file` is the order they are seen in.

    With a fixed schema the files are read once, by the tasks. `one_per_file=False` reads
    JSON Lines, the form to keep many runs in: such files can be split, and a folder with
    one small file per run is best read once and stored as Parquet.

    A file that is no JSON, or a value of another type, is an error that names the file.
    Whole numbers may be written as 500.0 (they are read as doubles, exact up to 2**53).
    """
    written = T.StructType.fromDDL(RUN_RECORD.replace("bigint", "double"))
    records = (
        spark.read.schema(written)
        .option("multiLine", one_per_file)
        .option("mode", "FAILFAST")
        .json(f"{root}/{files}")
        .withColumn("source_file", F.col("_metadata.file_path"))
    )
    kinds = T.StructType.fromDDL(RUN_RECORD)
    whole = {name: _whole_numbers(name, kinds[name].dataType) for name in ("config", "parameter_stats")}
    return with_numeric_metrics(records.withColumns(whole))


def _whole_numbers(name: str, kind: T.StructType) -> Column:
    """A record whose whole numbers were read as doubles, with its own types."""

    def cast(field: T.StructField) -> Column:
        value = F.col(name)[field.name]
        if isinstance(field.dataType, T.LongType):
            wrong = F.raise_error(F.format_string(f"{name}.{field.name} is no whole number: %s", value))
            value = F.when(value == F.floor(value), value.cast("bigint")).when(value.isNotNull(), wrong.cast("bigint"))
        return value.alias(field.name)

    return F.when(F.col(name).isNotNull(), F.struct(*[cast(f) for f in kind.fields]))


def read_results(
    spark: SparkSession, path: str, schema: str | None = None, json_lines: bool = False
) -> DataFrame:
    """Results table from JSON arrays of rows (or JSON Lines), with all columns of the rows.

    Without a schema the fixed columns have their types and all others the ones found in a pass
    over the data; give the schema to save that pass.
    """
    read = spark.read.option("multiLine", not json_lines)
    if schema is None:
        found = read.json(path).schema
        fixed = T.StructType.fromDDL(RESULTS)
        more = [f for f in found if f.name not in fixed.names]
        return read.schema(T.StructType([*fixed, *more])).json(path)
    return read.schema(schema).json(path)


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """Fits of a document in either shape, one row per fit; no rows if the file is absent.

    Shape 1 nests the fits under `fits`; shape 2 is a flat map with keys
    `Architecture_method` and the field R2. The token Infinity is accepted.
    """
    try:
        texts = spark.read.option("wholetext", True).text(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        texts = spark.createDataFrame([], "value string")
    document = F.from_json("value", FIT_DOCUMENT, {"allowNonNumericNumbers": "true"})
    flat = F.from_json("value", PUBLISHED_FITS)
    parsed = texts.select("value", document.alias("doc"))
    nested = parsed.select(F.explode("doc.fits").alias("key", "fit")).select(
        F.lit(None).cast("string").alias("architecture"),
        F.col("key").alias("method"),
        *[f"fit.{name}" for name in ("a", "b", "c", "r2", "n_points", "perr")],
    )
    key = F.split("key", "_", 2)
    published = (
        parsed.where("doc.fits is null")
        .select(F.explode(flat).alias("key", "fit"))
        .select(
            F.lower(key[0]).alias("architecture"),
            F.try_element_at(key, F.lit(2)).alias("method"),
            "fit.a",
            "fit.b",
            "fit.c",
            F.col("fit.R2").alias("r2"),
        )
    )
    return nested.unionByName(published, allowMissingColumns=True)


def read_crossovers(spark: SparkSession, path: str) -> DataFrame:
    """Crossovers of a fit document, one row per pair."""
    document = F.from_json("value", FIT_DOCUMENT, {"allowNonNumericNumbers": "true"})
    return (
        spark.read.option("wholetext", True)
        .text(path)
        .select(F.explode(document["crossovers"]).alias("pair", "n_cross"))
    )


def read_labelled_text(spark: SparkSession, path: str, task: str, split: str) -> DataFrame:
    """Examples of one task and split; a table partitioned by both is pruned to them."""
    return spark.read.parquet(path).where((F.col("task") == task) & (F.col("split") == split))


def tag_architecture(flat: DataFrame) -> DataFrame:
    """Architecture of every results row, derived from the model where it is not given."""
    given = F.col("architecture") if "architecture" in flat.columns else None
    return flat.withColumn("architecture", architecture(given))
