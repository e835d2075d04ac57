"""Labelled text: reading, subsets, prompts, tokens, padding."""

from pyspark.sql import functions as F

from curvekit import fixed_values as fv
from curvekit.operators import flatten as P1
from curvekit.operators import sampling as D
from curvekit.operators import text as TX
from curvekit.plans.datasets import decoder_datasets, encoder_datasets
from curvekit.session import scratch_path
from curvekit.sources import readers
from registry import check_sql as S
from registry import views as V
from registry.catalog import query, r, rounded

LENGTH = 128
SPLIT = r"'[^ \t\n\r\f]+'"
WORDS = f"regexp_extract_all(text_a, {SPLIT})"


@query(
    "s5_read_labelled_text",
    f"""WITH {S.TEXTS} SELECT example_id, label, length(text_a) AS n_chars, md5(text_a) AS text_hash
    FROM texts WHERE task = 'en' AND split = 'train'""",
)
def read_labelled_text(spark, sf):
    path = scratch_path(spark, "labelled-text")
    V.labelled_text(spark, sf).write.partitionBy("task", "split").parquet(path)
    return readers.read_labelled_text(spark, path, "en", "train").select(
        "example_id",
        "label",
        F.length("text_a").cast("bigint").alias("n_chars"),
        F.md5("text_a").alias("text_hash"),
    )


RANKED = f"""{S.TEXTS}, ranked AS (
  SELECT task, seed, example_id, count(*) OVER (PARTITION BY task, seed) AS split_size,
    row_number() OVER (PARTITION BY task, seed ORDER BY md5(seed || ':' || example_id), example_id) AS place
  FROM texts CROSS JOIN (VALUES {", ".join(f"(CAST({s} AS BIGINT))" for s in fv.ENCODER_SEEDS)}) s(seed)
  WHERE split = 'train')"""


def _train(spark, sf):
    return V.labelled_text(spark, sf).where("split = 'train'")


@query(
    "d1_seeded_subset",
    f"""WITH {RANKED} SELECT task, seed, example_id, place, CAST(50 AS BIGINT) AS train_subset_size,
      least(50, split_size) AS effective_n FROM ranked WHERE seed = 42 AND place <= 50""",
)
def seeded_subset(spark, sf):
    return D.seeded_subset(_train(spark, sf), 42, 50)


@query(
    "d2_subset_or_whole_split",
    f"""WITH {RANKED} SELECT task, seed, example_id, place, CAST(100000000 AS BIGINT) AS train_subset_size,
      split_size AS effective_n FROM ranked WHERE seed = 123""",
)
def subset_or_whole_split(spark, sf):
    return D.seeded_subset(_train(spark, sf), 123, 100_000_000)


@query(
    "d3_subsets_for_all_seeds_and_sizes",
    f"""WITH {RANKED} SELECT task, seed, example_id, place, CAST(size AS BIGINT) AS train_subset_size,
      least(CAST(size AS BIGINT), split_size) AS effective_n
    FROM ranked JOIN (VALUES {", ".join(f"({n})" for n in fv.ENCODER_SIZES)}) z(size) ON place <= size""",
)
def subsets_for_all(spark, sf):
    return D.subset_grid(_train(spark, sf), fv.ENCODER_SEEDS, fv.ENCODER_SIZES)


@query(
    "d4_evaluation_split",
    f"WITH {S.TEXTS} SELECT task, example_id, label FROM texts WHERE split = 'validation'",
)
def evaluation_split(spark, sf):
    return D.evaluation_split(V.labelled_text(spark, sf)).select("task", "example_id", "label")


PROMPT_TASK = "CASE WHEN task = 'en' THEN 'sst2' WHEN task = 'fr' THEN 'cola' ELSE 'rte' END"
SST2 = "'Classify the sentiment of this sentence as ''positive'' or ''negative''.' || chr(10) || 'Sentence: ' || text_a || chr(10) || 'Sentiment:'"
COLA = "'Is this sentence grammatically correct? Answer ''yes'' or ''no''.' || chr(10) || 'Sentence: ' || text_a || chr(10) || 'Answer:'"
MRPC = "'Are these two sentences semantically equivalent? Answer ''yes'' or ''no''.' || chr(10) || 'Sentence 1: ' || text_a || chr(10) || 'Sentence 2: ' || text_b || chr(10) || 'Answer:'"
PROMPTED = f"""{S.TEXTS}, prompted AS (
  SELECT example_id, CASE task WHEN 'en' THEN {SST2} WHEN 'fr' THEN {COLA} END AS prompt,
    CASE WHEN task = 'en' THEN CASE label WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' END
         WHEN task = 'fr' THEN CASE label WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END END AS label_text, label
  FROM texts)"""


def _prompted(spark, sf):
    task = F.when(F.col("task") == "en", "sst2").when(F.col("task") == "fr", "cola").otherwise("rte")
    return TX.prompt_rows(V.labelled_text(spark, sf).withColumn("task", task))


@query("tx1_prompts", f"WITH {PROMPTED} SELECT example_id, prompt FROM prompted")
def prompts(spark, sf):
    return _prompted(spark, sf).select("example_id", "prompt")


@query(
    "tx1_pair_prompts",
    f"WITH {S.PAIRS} SELECT conv_id, turn, {MRPC} AS prompt, CASE label WHEN 0 THEN 'no' ELSE 'yes' END AS label_text FROM pairs",
)
def pair_prompts(spark, sf):
    pairs = V.text_pairs(spark, sf).withColumn("task", F.lit("mrpc"))
    return TX.prompt_rows(pairs).select("conv_id", "turn", "prompt", "label_text")


@query(
    "tx2_label_words",
    f"""WITH {PROMPTED} SELECT example_id, label_text,
      CASE WHEN label_text IS NULL THEN 'no word for label ' || label END AS violation FROM prompted""",
)
def label_words(spark, sf):
    return _prompted(spark, sf).select("example_id", "label_text", "violation")


@query(
    "tx3_training_text",
    f"WITH {PROMPTED} SELECT example_id, prompt || ' ' || label_text AS text FROM prompted",
)
def training_text(spark, sf):
    return _prompted(spark, sf).select("example_id", "text")


TOKENISED = f"""{S.DOCUMENT_TEXTS}, tokenised AS (
  SELECT task, example_id, label, CAST(len({WORDS}) AS INTEGER) AS n_tokens,
    {WORDS}[1:{LENGTH}] AS ids FROM texts)"""


def _tokenised(spark, sf):
    return TX.tokenise(V.document_text(spark, sf), "text_a", LENGTH)


@query(
    "tx4_tokenise_and_truncate",
    f"""WITH {TOKENISED} SELECT example_id, n_tokens, n_tokens > {LENGTH} AS was_truncated,
      array_to_string(ids, ' ') AS input_ids FROM tokenised""",
)
def tokenise(spark, sf):
    return _tokenised(spark, sf).select(
        "example_id", "n_tokens", "was_truncated", F.array_join("input_ids", " ").alias("input_ids")
    )


@query(
    "tx5_encode_pairs",
    f"""WITH {S.PAIRS}, sized AS (
      SELECT *, regexp_extract_all(text_a, {SPLIT}) AS a, regexp_extract_all(text_b, {SPLIT}) AS b FROM pairs),
    limits AS (SELECT *, len(a) AS x, len(b) AS y FROM sized),
    cut AS (
      SELECT *, (SELECT max(i) FROM range(0, x + 1) g(i)
          WHERE i + least(y, i) <= 32 OR i + least(y, greatest(i - 1, 0)) <= 32) AS ka FROM limits),
    fitted AS (
      SELECT conv_id, turn, a, b, x, y,
        CASE WHEN x + y <= 32 THEN x ELSE least(x, greatest(ceil(32 / 2.0), 32 - y)) END AS kept_a FROM cut)
    SELECT conv_id, turn, CAST(kept_a AS INTEGER) AS kept_a,
      CAST(least(y, 32 - kept_a) AS INTEGER) AS kept_b,
      array_to_string(list_concat(a[1:CAST(kept_a AS BIGINT)], b[1:CAST(least(y, 32 - kept_a) AS BIGINT)]), ' ') AS input_ids,
      repeat('0', CAST(kept_a AS BIGINT)) || repeat('1', CAST(least(y, 32 - kept_a) AS BIGINT)) AS token_type_ids
    FROM fitted""",
)
def encode_pairs(spark, sf):
    encoded = TX.encode_pair(V.text_pairs(spark, sf), max_length=32)
    return encoded.select(
        "conv_id", "turn", "kept_a", "kept_b",
        F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("token_type_ids", "").alias("token_type_ids"),
    )


@query(
    "tx6_pad_and_mask",
    f"""WITH {TOKENISED} SELECT example_id,
      array_to_string(ids, ' ') || repeat(' <pad>', {LENGTH} - len(ids)) AS input_ids,
      repeat('1', len(ids)) || repeat('0', {LENGTH} - len(ids)) AS attention_mask,
      array_to_string(ids, ' ') || repeat(' <pad>', {LENGTH} - len(ids)) AS labels
    FROM tokenised""",
)
def pad_and_mask(spark, sf):
    padded = TX.pad(_tokenised(spark, sf), LENGTH)
    return padded.select(
        "example_id",
        F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("attention_mask", "").alias("attention_mask"),
        F.array_join("labels", " ").alias("labels"),
    )


@query(
    "tx8_token_budget",
    f"""WITH {RANKED}, sized AS (
      SELECT task, example_id, len({WORDS}) AS n_tokens FROM texts),
    counted AS (
      SELECT task, seed, CAST(size AS BIGINT) AS train_subset_size, count(*) AS effective_n,
        CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(least(n_tokens, {LENGTH})) AS BIGINT) AS kept_tokens,
        count(*) FILTER (n_tokens > {LENGTH}) AS cut_texts
      FROM ranked JOIN (VALUES {", ".join(f"({n})" for n in fv.ENCODER_SIZES)}) z(size) ON place <= size
      JOIN sized USING (task, example_id) GROUP BY task, seed, size)
    SELECT task, seed, train_subset_size, effective_n, n_tokens, kept_tokens,
      {r("cut_texts / effective_n")} AS cut_text_share,
      {r("(n_tokens - kept_tokens) / nullif(n_tokens, 0)")} AS cut_token_share,
      {r(f"1 - kept_tokens / (effective_n * {LENGTH})")} AS padding_share FROM counted""",
)
def token_budget(spark, sf):
    """Tokens are counted for the placed texts of the training split; ids alone are ranked."""
    train = _train(spark, sf)
    places = D.placed(train, fv.ENCODER_SEEDS, max(fv.ENCODER_SIZES))
    counted = TX.tokenise(train, "text_a", LENGTH)
    return rounded(TX.token_budget(counted, places, fv.ENCODER_SIZES, LENGTH))


def _spelled(df):
    """Array columns as text, so that they can be compared."""
    return df.select(
        *[F.array_join(c, " ").alias(c) if "array" in kind else c for c, kind in df.dtypes]
    )


@query(
    "p4_model_input_columns",
    f"WITH {TOKENISED} SELECT label, array_to_string(ids, ' ') AS input_ids FROM tokenised",
)
def model_input_columns(spark, sf):
    return _spelled(P1.keep_model_inputs(_tokenised(spark, sf)))


@query(
    "p4_drop_originals",
    f"""WITH {TOKENISED} SELECT example_id, n_tokens, n_tokens > {LENGTH} AS was_truncated,
      array_to_string(ids, ' ') AS input_ids FROM tokenised""",
)
def drop_originals(spark, sf):
    examples = V.document_text(spark, sf)
    originals = [c for c in examples.columns if c != "example_id"]
    return _spelled(P1.drop_originals(TX.tokenise(examples, "text_a", LENGTH), originals))


@query(
    "prepare_encoder_sets",
    f"""WITH {RANKED}, sets AS (
      SELECT 'train' AS part, example_id FROM ranked WHERE seed = 456 AND place <= 200
      UNION ALL SELECT 'validation', example_id FROM texts WHERE split = 'validation'),
    tokenised AS (SELECT *, {WORDS}[1:{LENGTH}] AS ids FROM texts JOIN sets USING (example_id))
    SELECT part, example_id, label, array_to_string(ids, ' ') AS input_ids,
      rtrim(repeat('1 ', len(ids))) AS attention_mask, rtrim(repeat('0 ', len(ids))) AS token_type_ids
    FROM tokenised""",
)
def prepare_encoder_sets(spark, sf):
    examples = V.labelled_text(spark, sf)
    train, evaluation = encoder_datasets(examples, 456, 200, LENGTH, keep=("example_id",))
    both = train.withColumn("part", F.lit("train")).unionByName(
        evaluation.withColumn("part", F.lit("validation"))
    )
    return _spelled(both)


@query(
    "prepare_decoder_sets",
    f"""WITH {PROMPTED}, ranked AS (
      SELECT example_id, row_number() OVER (PARTITION BY CASE WHEN task IN ('en', 'fr') THEN task END
        ORDER BY md5('456:' || example_id), example_id) AS place
      FROM texts WHERE split = 'train'), sets AS (
      SELECT 'train' AS part, example_id FROM ranked WHERE place <= 100
      UNION ALL SELECT 'validation', example_id FROM texts WHERE split = 'validation'),
    tokenised AS (
      SELECT part, example_id, label, label_text,
        regexp_extract_all(prompt || ' ' || label_text, {SPLIT}) AS words
      FROM prompted JOIN sets USING (example_id))
    SELECT part, example_id, CAST(len(words) AS INTEGER) AS n_tokens, len(words) > {LENGTH} AS was_truncated,
      CASE WHEN label_text IS NULL THEN 'no word for label ' || label END AS violation,
      array_to_string(words[1:{LENGTH}], ' ') || repeat(' <pad>', {LENGTH} - len(words)) AS input_ids,
      rtrim(repeat('1 ', least(len(words), {LENGTH})) || repeat('0 ', {LENGTH} - len(words))) AS attention_mask,
      array_to_string(words[1:{LENGTH}], ' ') || repeat(' <pad>', {LENGTH} - len(words)) AS labels
    FROM tokenised""",
)
def prepare_decoder_sets(spark, sf):
    task = F.when(F.col("task") == "en", "sst2").when(F.col("task") == "fr", "cola").otherwise("rte")
    examples = V.labelled_text(spark, sf).withColumn("task", task)
    train, evaluation = decoder_datasets(examples, 456, 100, LENGTH, keep=("example_id",))
    both = train.withColumn("part", F.lit("train")).unionByName(
        evaluation.withColumn("part", F.lit("validation"))
    )
    return _spelled(both)
