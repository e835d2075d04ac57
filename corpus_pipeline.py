"""The corpus pipeline: quality rules, exact and near duplicates, source mix, tokens.

Stages take and return rows of documents, whatever further columns these have and however they
are called; the last one returns the pieces' ids. A row is named by the hash of its columns, so null and repeated
doc_ids are no matter. Each stage's rows are written and read again before the next one.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvekit.llm import content_sort, cube, fertility, jaccard, pieces
from curvekit.llm.queries import PIECES
from curvekit.session import materialize

#: Near duplicates share this much of their shingles of so many words; op4's own query has other values.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _own(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _row_hash(docs: DataFrame) -> Column:
    """Hash of all columns, nulls by their place; what cannot be hashed, such as a map, by its JSON form."""
    parts = []
    for field in docs.schema:
        value, kind = _own(field.name), field.dataType.simpleString()
        plain = "map<" not in kind and "variant" not in kind
        parts += [value.isNull(), value if plain else F.to_json(F.struct(value))]
    return F.xxhash64(*parts)


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with their names, and the column that has them."""
    row = _free(docs, "row_")
    return docs.withColumn(row, _row_hash(docs)), row


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the fertility bands accept."""
    named, row = _named(docs)
    kept = fertility.judge(named, PIECES, key=row).where("kept")
    return named.join(kept.select(F.col("doc_id").alias(row)), row, "left_semi").drop(row)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the smallest doc_id, and of several rows with it the one of the smallest hash."""
    id_, sha, place = (_free(docs, name) for name in ("id_", "sha_", "place_"))
    kept = content_sort.group_equal_texts(docs.select("doc_id", "text")).where("kept").select(
        F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)
    )
    digest = F.sha2(content_sort.normalised("text"), 256)
    found = docs.join(kept.distinct(), (digest == F.col(sha)) & F.col("doc_id").eqNullSafe(F.col(id_)))
    first = Window.partitionBy(sha).orderBy(_row_hash(docs))
    return found.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(id_, sha, place)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts: the smallest doc_id."""
    named, row = _named(docs)
    found = jaccard.similar_documents(
        named.select(row, "text"), key=row, words=NEAR_WORDS, percent=NEAR_PERCENT, count_links=False
    )
    found = found.select(F.col("doc_id").alias(row), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group"))
    ids = named.select(row, F.col("doc_id").alias("id"))
    stays = (
        ids.join(found, row)
        .groupBy(F.coalesce("group", row).alias("group"))
        .agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", F.col(row).alias("name"))).alias("x"))
        .select(F.col("x.name").alias(row))
    )
    return named.join(stays, row, "left_semi").drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    unit, source, copies, copy = (_free(docs, name) for name in ("unit_", "source_", "copies_", "copy_"))
    taken = cube.mix(docs.select("doc_id", "text", "source")).where("copies > 0")
    taken = taken.select(F.col("unit").alias(unit), F.col("source").alias(source), F.col("copies").alias(copies)).distinct()
    same = (cube.row_key(["doc_id", "text", "source"]) == F.col(unit)) & F.col("source").eqNullSafe(F.col(source))
    return (
        docs.join(taken, same)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
        .drop(unit, source, copies, copy)
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of the whole text's pieces and their number."""
    return pieces.encode(docs, PIECES).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mix sources", mix_sources),
    ("SentencePiece", encode),
]

#: Fertility, balanced draws and Viterbi paths are beyond SQL; tests/llm has brute force for each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
