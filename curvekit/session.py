"""Session helpers: the shared scratch folder and tables written into it."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH_SETTING = "spark.checkpoint.dir"


def local_session(app_name: str, cpus: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and single-machine runs; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", f"{tempfile.gettempdir()}/curvekit-warehouse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only on a local master."""
    named = spark.conf.get(_SCRATCH_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SCRATCH_SETTING} to a folder all executors share")
    made = tempfile.mkdtemp(prefix="curvekit-")
    spark.sparkContext.setCheckpointDir(made)
    return scratch_root(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, so several consumers share
    one computation, and gives the planner the real size: a later join broadcasts
    this side only if its files are below the broadcast threshold.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
