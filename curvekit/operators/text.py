"""Prompts, label words, whitespace tokens, length budgets and padding."""

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvekit import fixed_values as fv
from curvekit.operators.config import lookup

TOKEN = r"[^ \t\n\r\f]+"


def render_prompt(template: str, slots: Mapping[str, Column]) -> Column:
    """Fill {name} slots of a template; text that looks like a slot is left alone.

    The template is cut into literals and slots once, so slot values are never rescanned.
    A null slot makes the prompt null.
    """
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [
        slots[part] if i % 2 else F.lit(part) for i, part in enumerate(parts) if i % 2 or part
    ]
    return F.concat(*pieces)


def prompt(task: str = "task", text_a: str = "text_a", text_b: str = "text_b") -> Column:
    """Prompt of the row's task; null for tasks without a template."""
    first, second = F.col(text_a), F.col(text_b)
    slots = {"sentence": first, "sentence1": first, "sentence2": second}
    chosen = F.lit(None).cast("string")
    for name, template in fv.PROMPTS.items():
        chosen = F.when(F.col(task) == name, render_prompt(template, slots)).otherwise(chosen)
    return chosen


def label_text(task: str = "task", label: str = "label") -> Column:
    """Word of a label; null for an unknown label or task."""
    words = {
        f"{name}:{i}": word for name, pair in fv.LABEL_WORDS.items() for i, word in enumerate(pair)
    }
    return lookup(words, F.concat_ws(":", task, label))


def prompt_rows(examples: DataFrame) -> DataFrame:
    """Add prompt, label_text, training text and a violation for labels without a word."""
    return examples.withColumns(
        {"prompt": prompt(), "label_text": label_text()}
    ).withColumns(
        {
            "text": F.concat("prompt", F.lit(" "), "label_text"),
            "violation": F.when(
                F.col("label_text").isNull(),
                F.concat(F.lit("no word for label "), F.coalesce(F.col("label").cast("string"), F.lit("None"))),
            ),
        }
    )


def tokens(text: str) -> Column:
    """All whitespace-separated tokens of the whole text."""
    return F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))


def tokenise(examples: DataFrame, text: str = "text_a", max_length: int = 256) -> DataFrame:
    """Token ids cut to a length, the full token count and whether anything was cut."""
    return (
        examples.withColumn("_tokens", tokens(text))
        .withColumn("n_tokens", F.size("_tokens"))
        .withColumn("input_ids", F.slice("_tokens", 1, max_length))
        .withColumn("was_truncated", F.col("n_tokens") > max_length)
        .drop("_tokens")
    )


def pair_budget(x: str, y: str, budget: int) -> tuple[str, str]:
    """How many tokens of two texts fit a common budget when the longer one is cut first."""
    half_up, half_down = (budget + 1) // 2, budget // 2
    first = (
        f"case when {x} + {y} <= {budget} then {x} "
        f"when {x} <= {half_up} and {x} <= {y} then {x} "
        f"when {y} <= {half_down} and {y} <= {x} then {budget} - {y} else {half_up} end"
    )
    second = (
        f"case when {x} + {y} <= {budget} then {y} "
        f"when {x} <= {half_up} and {x} <= {y} then {budget} - {x} "
        f"when {y} <= {half_down} and {y} <= {x} then {y} else {half_down} end"
    )
    return first, second


def encode_pair(
    pairs: DataFrame, text_a: str = "text_a", text_b: str = "text_b", max_length: int = 256
) -> DataFrame:
    """Tokens of a text pair under one length budget, with segment numbers 0 and 1.

    A null second text leaves the whole budget to the first.
    """
    second = F.coalesce(tokens(text_b), F.array().cast("array<string>"))
    keep_a, keep_b = pair_budget("size(_a)", "size(_b)", max_length)
    return (
        pairs.withColumns({"_a": tokens(text_a), "_b": second})
        .withColumns({"kept_a": F.expr(keep_a), "kept_b": F.expr(keep_b)})
        .withColumns(
            {
                "input_ids": F.expr("concat(slice(_a, 1, kept_a), slice(_b, 1, kept_b))"),
                "token_type_ids": F.expr("concat(array_repeat(0, kept_a), array_repeat(1, kept_b))"),
            }
        )
        .drop("_a", "_b")
    )


def pad(tokenised: DataFrame, length: int = 256, padding: str = "<pad>") -> DataFrame:
    """Fixed-length token ids, their attention mask and the training labels (a copy)."""
    real, missing = F.size("input_ids"), F.lit(length) - F.size("input_ids")
    filled = F.concat("input_ids", F.array_repeat(F.lit(padding), missing))
    mask = F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), missing))
    return tokenised.withColumns({"attention_mask": mask, "input_ids": filled}).withColumn(
        "labels", F.col("input_ids")
    )


def token_budget(
    tokenised: DataFrame, placed: DataFrame, sizes: Sequence[int], max_length: int = 256
) -> DataFrame:
    """What a length budget costs each training subset: rows (task, seed, train_subset_size, ...).

    `tokenised` has task, example_id and n_tokens (see tokenise), `placed` the places of
    the examples per seed (see sampling.placed). Returned are the number of texts there (effective_n), all their
    tokens, those kept under `max_length`, the shares of cut texts and of cut tokens, and the share
    of padding when every text is padded to `max_length`. All sizes come from one aggregate, as subsets
    are nested. Null texts count as texts without tokens.
    """
    n = F.coalesce("n_tokens", F.lit(0)).cast("bigint")
    kept = F.least(n, F.lit(max_length))
    reports = []
    for size in sizes:
        inside = F.col("place") <= size
        count = lambda value: F.coalesce(F.sum(F.when(inside, value)), F.lit(0))  # noqa: B023, E731
        reports.append(
            F.struct(
                F.lit(size).cast("bigint").alias("train_subset_size"),
                F.count(F.when(inside, True)).alias("effective_n"),
                count(n).alias("n_tokens"),
                count(kept).alias("kept_tokens"),
                count((n > max_length).cast("bigint")).alias("cut_texts"),
            )
        )
    return (
        placed.join(tokenised.select("task", "example_id", "n_tokens"), ["task", "example_id"])
        .groupBy("task", "seed")
        .agg(F.array(*reports).alias("reports"))
        .select("task", "seed", F.explode("reports").alias("x"))
        .select("task", "seed", "x.*")
        .withColumns(
            {
                "cut_text_share": F.try_divide("cut_texts", "effective_n"),
                "cut_token_share": F.try_divide(F.col("n_tokens") - F.col("kept_tokens"), F.col("n_tokens")),
                "padding_share": 1 - F.try_divide(F.col("kept_tokens"), F.col("effective_n") * max_length),
            }
        )
        .drop("cut_texts")
    )
