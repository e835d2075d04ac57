"""Exact duplicates by sorting contents: equal texts become neighbours."""

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvekit.llm.common import SPACE, slices
from curvekit.session import materialize


HEAD_CHARS = 16


def normalised(text: Column | str) -> Column:
    """The text with every run of white space as one space; null is empty."""
    return F.coalesce(F.regexp_replace(text, SPACE + "+", " "), F.lit(""))


def _runs(batches):
    """Number the runs of equal texts in a sorted partition, comparing whole neighbours."""
    part, run, last = TaskContext.get().partitionId(), -1, None
    for batch in batches:
        for piece in slices(batch):
            runs, leads, edges = [], [], []
            for text in piece.column("norm").to_pylist():
                leads.append(text != last)
                run += leads[-1]
                edges.append(text if leads[-1] and run == 0 else None)
                runs.append(run)
                last = text
            yield _out(piece.column("doc_id"), piece.column("sha"), part, runs, leads, edges, True)
    if last is not None:  # no document, but the text at the end of the range
        none = pa.array([None], pa.int64()), pa.array([None], pa.string())
        yield _out(*none, part, [run], [False], [last], False)


def _out(ids, shas, part, runs, leads, edges, is_row):
    n = len(runs)
    return pa.RecordBatch.from_arrays(
        [ids, shas, pa.array([part] * n, pa.int32()), pa.array(runs, pa.int64()),
         pa.array(leads, pa.bool_()), pa.array(edges, pa.string()), pa.array([is_row] * n, pa.bool_())],
        names=["doc_id", "sha", "part", "run", "leads", "edge", "is_row"],
    )


def group_equal_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Spark samples splitters over (head of the normalised text, its digest, key), deals the rows
    into ranges and sorts each on disk where needed. Head and digest order whole contents, yet
    a splitter that goes through the driver stays short however long the texts are; the key
    in the order lets a large group of copies span many ranges. Each range is scanned once, comparing neighbours as whole texts. A run that
    goes on in the next range is joined to it by comparing the two texts at the border. The
    smallest key of a run is its first row.

    Null texts equal empty ones. A null key counts as the largest; of rows repeated with the
    same key and text one is kept. An empty table gives no rows. Other columns are not read.
    """
    order = ["head", "digest", "last", "doc_id"]
    dealt = (
        docs.select(F.col(key).cast("long").alias("doc_id"), normalised(text).alias("norm"))
        .withColumns({
            "head": F.substring("norm", 1, HEAD_CHARS),
            "digest": F.unhex(F.sha2("norm", 256)),
            "last": F.col("doc_id").isNull(),
        })
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "norm", F.lower(F.hex("digest")).alias("sha"))
    )
    found = materialize(
        dealt.mapInArrow(
            _runs,
            "doc_id long, sha string, part int, run long, leads boolean, edge string, is_row boolean",
        ),
        "sorted-runs",
    )
    rows = found.where("is_row").select("doc_id", "sha", "part", "run", "leads")
    runs = rows.groupBy("part", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")
    )
    edges = found.where("edge is not null").select("part", "run", "edge", "is_row")
    return (
        rows.join(_joined_over_borders(runs, edges), ["part", "run"])
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("leads") & (F.col("part") == F.col("from_part"))).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def _joined_over_borders(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, run) -> keep_id, group_size and first range of the whole run, over the ranges it spans.

    `edges` has two rows per range: its first run and its last one, with their texts. The
    window over them sees twice as many rows as there are ranges, never documents.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("part", F.desc("is_row"))
    chains = (
        edges.withColumn("new", F.coalesce(F.col("edge") != F.lag("edge").over(order), F.lit(True)))
        .withColumn("chain", F.sum(F.col("new").cast("int")).over(order))
        .select("part", "run", "chain")
        .distinct()
    )
    at_border = runs.join(chains, ["part", "run"])
    totals = at_border.groupBy("chain").agg(
        F.sum("n").alias("total"), F.min("least").alias("least_of_all"), F.min("part").alias("first_part")
    )
    spanning = chains.join(totals, "chain").drop("chain")
    return runs.join(spanning, ["part", "run"], "left").select(
        "part",
        "run",
        F.coalesce("least_of_all", "least").alias("keep_id"),
        F.coalesce("total", "n").alias("group_size"),
        F.coalesce("first_part", "part").alias("from_part"),
    )
