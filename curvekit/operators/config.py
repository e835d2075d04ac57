"""Run configurations: defaults, effective values, names, validation, run records."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvekit import fixed_values as fv


def lookup(facts: dict, key: Column) -> Column:
    """Value of a small fixed table for a key; null for an unknown key."""
    entries = [F.lit(x) for pair in facts.items() for x in pair]
    return F.element_at(F.create_map(*entries), key)


def safe_model_name(model: str = "model_name", separator: str = "-") -> Column:
    return F.replace(F.col(model), F.lit("/"), F.lit(separator))


def encoder_run_id(started: str = "started") -> Column:
    """task__model__method__seedS__timestamp"""
    return F.concat_ws(
        "__",
        "task_name",
        safe_model_name(separator="-"),
        "method",
        F.concat(F.lit("seed"), F.col("seed").cast("string")),
        F.date_format(started, "yyyyMMdd_HHmmss"),
    )


def decoder_run_id(started: str = "started") -> Column:
    """method__model__task__nN__sS__timestamp"""
    return F.concat_ws(
        "__",
        "method",
        safe_model_name(separator="_"),
        "task_name",
        F.concat(F.lit("n"), F.col("train_subset_size").cast("string")),
        F.concat(F.lit("s"), F.col("seed").cast("string")),
        F.date_format(started, "yyyyMMdd_HHmmss"),
    )


def run_id(started: str = "started") -> Column:
    """Run name in the layout of its architecture."""
    decoder = F.col("architecture") == "decoder"
    return F.when(decoder, decoder_run_id(started)).otherwise(encoder_run_id(started))


def architecture(given: Column | None = None, model: str = "model_name") -> Column:
    """The given tag ('causal_lm' means decoder), else decoder for the decoder models."""
    derived = F.when(F.col(model).isin(fv.DECODER_MODELS), "decoder").otherwise("encoder")
    if given is None:
        return derived
    return F.coalesce(F.when(given == "causal_lm", "decoder").otherwise(given), derived)


def fill_defaults(configs: DataFrame) -> DataFrame:
    """Defaults of absent or null config fields, by architecture."""
    decoder = F.col("architecture") == "decoder"
    names = list(dict.fromkeys([*fv.ENCODER_DEFAULTS, *fv.DECODER_DEFAULTS]))

    def filled(name: str) -> Column:
        value = F.when(decoder, F.lit(fv.DECODER_DEFAULTS.get(name))).otherwise(
            F.lit(fv.ENCODER_DEFAULTS.get(name))
        )
        return F.coalesce(F.col(name), value) if name in configs.columns else value

    return configs.withColumns({name: filled(name) for name in names})


def effective_hyperparameters(configs: DataFrame) -> DataFrame:
    """Learning rate and epochs a run really uses, next to the configured ones."""
    decoder, full = F.col("architecture") == "decoder", F.col("method") == fv.BASELINE_METHOD
    rate, epochs = F.col("learning_rate"), F.col("num_train_epochs")
    automatic = F.when(full, F.lit(fv.FULL_FT_LEARNING_RATE)).otherwise(
        F.lit(fv.ADAPTER_LEARNING_RATE)
    )
    return configs.withColumns(
        {
            "effective_learning_rate": F.when(decoder & (rate <= 0), automatic)
            .when(decoder | full, rate)
            .otherwise(F.greatest(rate, F.lit(fv.ADAPTER_LEARNING_RATE))),
            "effective_epochs": F.when(decoder | full, epochs).otherwise(
                F.greatest(epochs, F.lit(fv.ADAPTER_EPOCHS))
            ),
        }
    )


def _unless(allowed: Sequence[str], column: str, what: str) -> Column:
    known = F.coalesce(F.col(column).isin(list(allowed)), F.lit(False))
    shown = F.coalesce(F.col(column), F.lit("None"))
    return F.when(~known, F.concat(F.lit(f"Unsupported {what}: "), shown))


# The violation texts below, but for the one on regression, which is our own.
def validate(configs: DataFrame) -> DataFrame:
    """Add `violations` (all broken rules in order) and `first_violation`.

    Encoder runs: method, task, model, positive size. Decoder runs: method only.
    The regression task is a violation of its own for encoder runs.
    """
    positive = F.coalesce(F.col("train_subset_size") > 0, F.lit(False))
    encoder = F.array(
        _unless(fv.METHODS, "method", "method"),
        _unless(fv.TASKS, "task_name", "task"),
        _unless(fv.ENCODER_MODELS, "model_name", "model"),
        F.when(~positive, "train_subset_size must be positive"),
        F.when(F.col("task_name") == fv.REGRESSION_TASK, "regression is not supported"),
    )
    decoder = F.array(_unless(fv.DECODER_METHODS, "method", "method for CausalLM"))
    rules = F.when(F.col("architecture") == "decoder", decoder).otherwise(encoder)
    return configs.withColumn("violations", F.array_compact(rules)).withColumn(
        "first_violation", F.try_element_at("violations", F.lit(1))
    )


def method_known(method: str = "method") -> Column:
    """False for a method no training path exists for."""
    return F.coalesce(F.col(method).isin(fv.METHODS), F.lit(False))


def with_task_facts(df: DataFrame, task: str = "task_name") -> DataFrame:
    """Join text keys, primary metric and label count of the task.

    The side is a handful of literal rows, so broadcasting it is bounded by construction.
    Unknown tasks keep their row with null facts; the label count has a default.
    """
    rows = [(name, *facts) for name, facts in fv.TASK_FACTS.items()]
    facts = df.sparkSession.createDataFrame(
        rows, f"{task} string, text_key_a string, text_key_b string, task_metric string"
    )
    labels = F.when(F.col(task) == fv.REGRESSION_TASK, 1).otherwise(2)
    return df.join(F.broadcast(facts), task, "left").withColumn("num_labels", labels)


def method_label(method: str = "method") -> Column:
    """Display name of a method; an unknown method is shown as it is."""
    names = {m: name for m, (name, _) in fv.METHOD_DISPLAY.items()}
    return F.coalesce(lookup(names, F.col(method)), F.col(method))


def method_colour(method: str = "method") -> Column:
    return lookup({m: colour for m, (_, colour) in fv.METHOD_DISPLAY.items()}, F.col(method))


def adapter_notes(method: str = "method") -> Column:
    """The note an adapter method leaves in its run record; full fine-tuning leaves none."""
    chosen = F.col(method)
    strategy = F.when(chosen == "bitfit", "train_bias_only").when(
        chosen.isin("lora", "topheavy_lora"), chosen
    )
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.when(
        strategy.isNotNull(), F.create_map(F.lit("adapter_strategy"), strategy)
    ).otherwise(empty)


def assemble_records(
    configs: DataFrame, parameter_stats: DataFrame, eval_metrics: DataFrame
) -> DataFrame:
    """Run records from configs, parameter counts and metrics of the same `run_id`.

    `eval_metrics` has run_id and one double column per metric; null metrics are left out.
    Run ids are unique on every side, so no join key is hot.
    """
    names = [c for c in eval_metrics.columns if c != "run_id"]
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names])
    metrics = eval_metrics.select(
        "run_id",
        F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("eval_metrics"),
    )
    stats = [c for c in parameter_stats.columns if c != "run_id"]
    counted = parameter_stats.select("run_id", F.struct(*stats).alias("parameter_stats"))
    decoder = F.col("architecture") == "decoder"
    named = lookup({t: f[2] for t, f in fv.TASK_FACTS.items()}, F.col("config.task_name"))
    fields = [c for c in configs.columns if c not in ("run_id", "architecture")]
    return (
        configs.select("run_id", "architecture", F.struct(*fields).alias("config"))
        .join(counted, "run_id", "left")
        .join(metrics, "run_id", "left")
        .select(
            F.col("run_id").alias("run_dir"),
            "config",
            "parameter_stats",
            F.when(~decoder, adapter_notes("config.method")).alias("method_notes"),
            "eval_metrics",
            F.when(decoder, "accuracy").otherwise(named).alias("primary_metric_name"),
            F.when(decoder, "causal_lm").alias("architecture"),
        )
    )
