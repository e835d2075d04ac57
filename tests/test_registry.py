"""Every registered query against its check SQL, and the shape of the plans."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect
from registry.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_check_sql(spark, db, name):
    same, count, _, note = compare(spark, db, SF_DIR, name)
    assert same, note
    assert count > 0


def test_every_query_has_check_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_joins(spark, name):
    if name.startswith("w"):
        pytest.skip("writes its result while streaming")
    text = plan(entry.queries()[name](spark, SF_DIR.replace("0.01", "0.001")))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "InPandas" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(entry.queries()["h1_learning_curve"](spark, SF_DIR))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "l_linenumber", "l_discount", "l_returnflag", "l_linestatus"}


def test_deduplication_reduces_before_the_shuffle(spark):
    text = plan(entry.queries()["e3_keep_one_run"](spark, SF_DIR))
    assert text.count("WindowGroupLimit") == 2 and ", Partial" in text


def test_off_grid_runs_are_filtered_without_a_shuffle_of_their_own(spark):
    from curvekit.operators.grid import off_grid_runs

    runs = spark.createDataFrame(
        [("lora", "m", "t", 50, 1)],
        "method string, model_name string, task_name string, train_subset_size bigint, seed bigint")
    assert "Exchange hashpartitioning" not in plan(off_grid_runs(runs))


def test_one_method_opens_only_its_folders(spark):
    text = plan(entry.queries()["f1_one_method_from_its_folder"](spark, SF_DIR))
    assert "PartitionFilters: [" in text and "(method" in text.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("name", ["e3_keep_one_run_from_buckets", "q2_paired_by_seed_from_buckets"])
def test_nothing_is_shuffled_over_buckets(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "Exchange" not in text and "Bucketed: true" in text
