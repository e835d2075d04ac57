import pytest

from curvekit.operators import metrics as M

PRED = "run_id string, task string, label int, pred int"


def test_argmax_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9],), ([2.0],), ([-1.0, -3.0],)], "v array<double>")
    assert [r[0] for r in df.select(M.argmax("v")).collect()] == [1, 0, 0]


def test_binary_metrics(spark):
    pairs = [(1, 1)] * 6 + [(0, 1)] * 2 + [(1, 0)] * 1 + [(0, 0)] * 3  # (label, pred)
    df = spark.createDataFrame([("r", "cola", y, p) for y, p in pairs], PRED)
    assert M.accuracy(df, ["run_id"]).first().accuracy == pytest.approx(9 / 12)
    assert M.f1_score(df, ["run_id"]).first().f1 == pytest.approx(12 / 15)
    mcc = (6 * 3 - 2 * 1) / ((8 * 7 * 5 * 4) ** 0.5)
    assert M.matthews_correlation(df, ["run_id"]).first().matthews_correlation == pytest.approx(mcc)


def test_one_class_predictions_score_zero(spark):
    df = spark.createDataFrame([("r", "cola", 0, 0), ("r", "cola", 0, 0)], PRED)
    assert M.f1_score(df, ["run_id"]).first().f1 == 0.0
    assert M.matthews_correlation(df, ["run_id"]).first().matthews_correlation == 0.0


def test_task_metrics_in_one_pass(spark):
    df = spark.createDataFrame(
        [(t, t, y, p) for t in ("sst2", "mrpc", "cola", "qnli", "rte", "stsb") for y, p in ((1, 1), (0, 1), (0, 0))],
        PRED)
    got = {r.task: r for r in M.task_metrics(df).collect()}
    assert {t: r.status for t, r in got.items()} == {
        **dict.fromkeys(("sst2", "mrpc", "cola", "qnli", "rte"), "ok"), "stsb": "unknown_task"}
    assert got["stsb"].accuracy == pytest.approx(2 / 3) and got["stsb"].primary_metric is None
    assert got["sst2"].primary_metric == got["sst2"].eval_accuracy == pytest.approx(2 / 3)
    assert (got["sst2"].f1, got["sst2"].matthews_correlation, got["sst2"].eval_f1) == (None, None, None)
    assert got["mrpc"].primary_metric == got["mrpc"].eval_f1 == pytest.approx(2 / 3)
    assert got["mrpc"].eval_accuracy is None and got["mrpc"].accuracy == pytest.approx(2 / 3)
    assert got["cola"].eval_primary_metric == got["cola"].matthews_correlation == pytest.approx(0.5)


def test_a_null_prediction_is_wrong_everywhere(spark):
    df = spark.createDataFrame([("r", "sst2", 1, 1), ("r", "sst2", 1, None)], PRED)
    assert M.accuracy(df, ["run_id"]).first().accuracy == 0.5
    assert M.task_metrics(df).first().accuracy == 0.5


def test_generated_score_is_by_substring(spark):
    df = spark.createDataFrame(
        [("r", "  YES it is", "yes"), ("r", "I do not know", "no"), ("r", "", "yes"), ("r", None, "yes")],
        "run_id string, generated string, expected string")
    row = M.generated_score(df).first()
    assert (row.correct, row.total, row.accuracy) == (2, 4, 0.5)
    none = M.generated_score(df.where("false"), []).first()
    assert (none.correct, none.total, none.accuracy) == (0, 0, 0.0)


INVENTORY = "model string, name string, numel bigint, requires_grad boolean, is_adapter boolean"


def test_masks_and_parameter_counts(spark):
    df = spark.createDataFrame(
        [("m", "layer.bias", 10, False, False), ("m", "layer.weight", 80, False, False),
         ("m", "classifier.weight", 5, False, False), ("m", "bias_table.weight", 5, False, False),
         ("m", "lora_A", 20, True, True)], INVENTORY)

    def trained(method, architecture="encoder"):
        return {r.name for r in df.where(M.trainable_mask(method, architecture)).collect()}

    assert len(trained("full_ft")) == 5
    assert trained("bitfit") == {"layer.bias", "classifier.weight"}
    assert trained("bitfit", "decoder") == {"layer.bias", "bias_table.weight"}
    assert trained("lora") == trained("topheavy_lora") == {"lora_A"}
    marked = df.withColumn("trainable", M.trainable_mask("lora"))
    assert tuple(M.count_parameters(marked).first()) == ("m", 120, 20, pytest.approx(100 / 6))
    assert tuple(M.count_parameters(marked, denominator="base").first()) == ("m", 100, 20, 20.0)
    with pytest.raises(ValueError):
        M.count_parameters(marked, denominator="other")
