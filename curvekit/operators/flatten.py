"""Run records to the flat results table."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvekit.schema import RESULT_FIELDS

def numeric_metrics(metrics: str) -> Column:
    """Keep the numbers (and booleans) of a map<string,variant>, as doubles."""
    return F.expr(
        f"""transform_values(
            map_filter({metrics}, (k, v) -> schema_of_variant(v)
                rlike '^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)'),
            (k, v) -> try_variant_get(v, '$', 'double'))"""
    )


def with_numeric_metrics(records: DataFrame) -> DataFrame:
    """Run records whose two metric maps are map<string,double>.

    `eval_texts` has every value as it was written, and `metric_keys` all keys in their order.
    """
    texts = "transform_values(eval_metrics, (k, v) -> try_variant_get(v, '$', 'string'))"
    return records.withColumns(
        {
            "metric_keys": F.map_keys("eval_metrics"),
            "eval_texts": F.expr(texts),
            **{name: numeric_metrics(name) for name in ("train_metrics", "eval_metrics")},
        }
    )


def flatten_runs(records: DataFrame) -> DataFrame:
    """Ten fixed columns and the evaluation metrics as a map; anything absent is null."""
    carried = [c for c in ("architecture", "source_file", "metric_keys", "eval_texts") if c in records.columns]
    return records.select(
        "run_dir",
        "config.method",
        "config.model_name",
        "config.task_name",
        "config.seed",
        "config.train_subset_size",
        "primary_metric_name",
        F.col("eval_metrics")["eval_primary_metric"].alias("primary_metric"),
        "parameter_stats.trainable_parameters",
        "parameter_stats.trainable_percentage",
        "eval_metrics",
        *carried,
    )


def metric_names(flat: DataFrame, order: str | None = None) -> dict[str, str]:
    """Distinct metric names and whether they are "string" or "double", in order of first
    appearance when an order column is given.

    A name that has a text in any run is a string column; one that is always null a double.
    The names become columns, so they have to reach the driver, like any schema.
    """
    place = F.struct(F.col(order) if order else F.lit(0), "pos")
    keys = F.col("metric_keys") if "metric_keys" in flat.columns else F.map_keys("eval_metrics")
    text = F.lit(False)
    if "eval_texts" in flat.columns:
        text = F.coalesce(F.expr("eval_texts[name] is not null and eval_metrics[name] is null"), F.lit(False))
    found = (
        flat.select("*", F.posexplode(keys).alias("pos", "name"))
        .groupBy("name")
        .agg(F.min(place).alias("place"), F.bool_or(text).alias("text"))
        .orderBy("place", "name")
        .collect()
    )
    return {row["name"]: "string" if row["text"] else "double" for row in found}


def expand_metrics(flat: DataFrame, names: Iterable[str] | dict[str, str]) -> DataFrame:
    """One column per metric; a metric named like a fixed column replaces its value, null or not.

    `names` are those of metric_names(), or plain names, which give double columns.
    """
    kinds = names if isinstance(names, dict) else dict.fromkeys(names, "double")
    keys = F.col("metric_keys") if "metric_keys" in flat.columns else F.map_keys("eval_metrics")

    def metric(name: str, kind: str) -> Column:
        if kind == "string" and "eval_texts" in flat.columns:
            return F.col("eval_texts")[name]
        return F.col("eval_metrics")[name].cast(kind)

    def fixed(name: str) -> Column:
        if name not in kinds:
            return F.col(name)
        own = dict(flat.dtypes)[name]
        kind = "string" if "string" in (own, kinds[name]) else "double"
        has = F.coalesce(F.array_contains(keys, F.lit(name)), F.lit(False))
        return F.when(has, metric(name, kind)).otherwise(F.col(name)).alias(name)

    hidden = (*RESULT_FIELDS, "eval_metrics", "eval_texts", "metric_keys")
    rest = [c for c in flat.columns if c not in hidden]
    added = [n for n in kinds if n not in RESULT_FIELDS]
    return flat.select(
        *[fixed(name) for name in RESULT_FIELDS],
        *[metric(name, kinds[name]).alias(name) for name in added],
        *rest,
    )


def keep_model_inputs(tokenised: DataFrame) -> DataFrame:
    """Token columns and label only; token types if the table has them."""
    wanted = ("input_ids", "attention_mask", "label", "token_type_ids")
    return tokenised.select([c for c in tokenised.columns if c in wanted])


def drop_originals(tokenised: DataFrame, originals: Iterable[str]) -> DataFrame:
    """Everything a text step added: the original columns are dropped."""
    return tokenised.drop(*originals)
