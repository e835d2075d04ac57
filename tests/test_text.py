import hashlib

import pytest
from pyspark.sql import functions as F

from curvekit.operators import flatten as P1
from curvekit.operators import sampling as D
from curvekit.operators import text as TX
from curvekit.plans.datasets import decoder_datasets, encoder_datasets
from curvekit.sources import readers


@pytest.fixture(scope="module")
def examples(spark):
    """Task `hot` has most of the rows."""
    return spark.range(3000).selectExpr(
        "if(id % 10 < 8, 'hot', 'cold') as task", "id as example_id", "'train' as split"
    )


def brute_places(examples, seed):
    places = {}
    for row in examples.collect():
        digest = hashlib.md5(f"{seed}:{row.example_id}".encode()).hexdigest()
        places.setdefault(row.task, []).append((digest, row.example_id))
    return {task: [i for _, i in sorted(found)] for task, found in places.items()}


@pytest.mark.parametrize("range_rows", [1_000_000, 5])
def test_places_equal_brute_force(examples, range_rows):
    got = D.placed(examples, [42, 7], 700, range_rows).collect()
    for seed in (42, 7):
        for task, ids in brute_places(examples, seed).items():
            mine = sorted((r.place, r.example_id) for r in got if (r.task, r.seed) == (task, seed))
            assert mine == list(enumerate(ids[:700], 1))
            assert {r.split_size for r in got if r.task == task} == {len(ids)}


def test_subsets_are_nested_and_clamped(examples):
    rows = D.subset_grid(examples, [1, 2], [10, 100, 5000]).collect()
    for seed in (1, 2):
        for task, size in (("hot", 2400), ("cold", 600)):
            chosen = {
                n: {r.example_id for r in rows if (r.task, r.seed, r.train_subset_size) == (task, seed, n)}
                for n in (10, 100, 5000)
            }
            assert {n: len(ids) for n, ids in chosen.items()} == {10: 10, 100: 100, 5000: size}
            assert chosen[10] < chosen[100] < chosen[5000]
    assert {r.effective_n for r in rows if r.train_subset_size == 5000} == {2400, 600}


def test_one_subset_is_part_of_the_grid(examples):
    one = {(r.task, r.example_id) for r in D.seeded_subset(examples, 1, 100).collect()}
    grid = D.subset_grid(examples, [1], [100, 500]).where("train_subset_size = 100").collect()
    assert one == {(r.task, r.example_id) for r in grid}
    whole = D.seeded_subset(examples, 1, 10**9)
    assert whole.count() == 3000
    assert {r.train_subset_size for r in whole.collect()} == {10**9}


def test_subsets_of_different_seeds_overlap_as_chance_would(examples):
    rows = D.subset_grid(examples.where("task = 'hot'"), [1, 2], [1200]).collect()
    first, second = ({r.example_id for r in rows if r.seed == s} for s in (1, 2))
    assert 500 < len(first & second) < 700


TEXT = "task string, text_a string, text_b string, label int"


def test_prompts_and_labels(spark):
    df = spark.createDataFrame(
        [("sst2", "fine {sentence2}", None, 1), ("mrpc", "{sentence2}", "B", 0), ("cola", "", None, 0),
         ("cola", "x", None, 2), ("rte", "x", "y", 1), ("sst2", None, None, 0), ("sst2", "x", None, None)], TEXT)
    rows = TX.prompt_rows(df).collect()
    assert rows[0].text == (
        "Classify the sentiment of this sentence as 'positive' or 'negative'.\n"
        "Sentence: fine {sentence2}\nSentiment: positive")
    assert rows[1].prompt == (
        "Are these two sentences semantically equivalent? Answer 'yes' or 'no'.\n"
        "Sentence 1: {sentence2}\nSentence 2: B\nAnswer:")
    assert rows[1].label_text == "no"
    assert rows[2].text.endswith("Sentence: \nAnswer: no")
    assert (rows[3].label_text, rows[3].text, rows[3].violation) == (None, None, "no word for label 2")
    assert (rows[4].prompt, rows[4].label_text) == (None, None)
    assert (rows[5].prompt, rows[5].label_text) == (None, "negative")
    assert rows[6].violation == "no word for label None"


def test_tokens_truncation_and_padding(spark):
    df = spark.createDataFrame([("\n a  b\tc d ", 1), ("", 0), ("x", 1)], "text_a string, label int")
    rows = TX.pad(TX.tokenise(df, "text_a", 3), 3, "<pad>").collect()
    assert [(r.n_tokens, r.was_truncated) for r in rows] == [(4, True), (0, False), (1, False)]
    assert [r.input_ids for r in rows] == [["a", "b", "c"], ["<pad>"] * 3, ["x", "<pad>", "<pad>"]]
    assert [r.attention_mask for r in rows] == [[1, 1, 1], [0, 0, 0], [1, 0, 0]]
    assert [r.labels for r in rows] == [r.input_ids for r in rows]


def longest_first(x, y, budget):
    while x + y > budget:
        if x > y:
            x -= 1
        else:
            y -= 1
    return x, y


def test_pair_budget_equals_the_loop(spark):
    sizes = [(x, y) for x in range(20) for y in range(20)]
    df = spark.createDataFrame(sizes, "x int, y int")
    for budget in range(16):
        a, b = TX.pair_budget("x", "y", budget)
        for row in df.selectExpr("x", "y", f"{a} as a", f"{b} as b").collect():
            assert (row.a, row.b) == longest_first(row.x, row.y, budget), (row, budget)


def test_encode_pair(spark):
    df = spark.createDataFrame([("a b c d e", "v w", 1)], "text_a string, text_b string, label int")
    row = TX.encode_pair(df, max_length=5).first()
    assert row.input_ids == ["a", "b", "c", "v", "w"]
    assert row.token_type_ids == [0, 0, 0, 1, 1]
    kept = P1.keep_model_inputs(TX.encode_pair(df, max_length=5))
    assert kept.columns == ["label", "input_ids", "token_type_ids"]
    assert "text_a" not in P1.drop_originals(df, ["text_a", "label"]).columns


def test_read_labelled_text_prunes_partitions(spark, folder):
    df = spark.createDataFrame(
        [("sst2", "train", 1), ("sst2", "validation", 2), ("rte", "train", 3)],
        "task string, split string, example_id int")
    df.write.partitionBy("task", "split").mode("overwrite").parquet(folder)
    got = readers.read_labelled_text(spark, folder, "sst2", "train")
    assert [r.example_id for r in got.collect()] == [1]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(task" in plan
    assert D.evaluation_split(df).select(F.sum("example_id")).first()[0] == 2


def test_datasets_of_one_experiment(spark):
    rows = [("sst2", "train", i, f"text {i}", None, i % 2) for i in range(20)]
    rows += [("mrpc", "train", 100 + i, "a b c", "d e", 1) for i in range(3)]
    rows += [("sst2", "validation", 200, "one two three", None, 5)]
    examples = spark.createDataFrame(
        rows, "task string, split string, example_id bigint, text_a string, text_b string, label int"
    )
    train, evaluation = encoder_datasets(examples, 1, 5, 4, keep=("task",))
    assert set(train.columns) == {"task", "label", "input_ids", "attention_mask", "token_type_ids"}
    by_task = {"sst2": 0, "mrpc": 0}
    for row in train.collect():
        by_task[row.task] += 1
        if row.task == "mrpc":
            assert (row.input_ids, row.token_type_ids) == (["a", "b", "d", "e"], [0, 0, 1, 1])
        assert row.attention_mask == [1] * len(row.input_ids)
    assert by_task == {"sst2": 5, "mrpc": 3}
    assert evaluation.first().input_ids == ["one", "two", "three"]
    train, evaluation = decoder_datasets(examples, 1, 5, 40)
    assert set(train.columns) == {
        "input_ids", "attention_mask", "labels", "n_tokens", "was_truncated", "violation"}
    assert train.count() == 8 and {len(r.input_ids) for r in train.collect()} == {40}
    row = evaluation.first()
    assert (row.input_ids, row.violation) == (None, "no word for label 5")
