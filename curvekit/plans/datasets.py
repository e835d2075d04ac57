"""Training and evaluation sets of one experiment, from labelled text to token columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvekit.operators.flatten import drop_originals, keep_model_inputs
from curvekit.operators.sampling import evaluation_split, seeded_subset
from curvekit.operators.text import encode_pair, pad, prompt_rows, tokenise
from curvekit.session import materialize

KEYS = ["task", "example_id"]


def training_split(examples: DataFrame, seed: int, size: int) -> DataFrame:
    """The seeded subset of each task with its texts.

    Places are found on the ids alone and written down; the texts are then filtered by
    them in the scan when the subset is small, and shuffled only when it is not.
    """
    train = examples.where(F.col("split") == "train")
    chosen = materialize(seeded_subset(train, seed, size).select(*KEYS, "place"), "subset")
    return train.join(chosen, KEYS)


def _encoded(examples: DataFrame, max_length: int) -> DataFrame:
    encoded = encode_pair(examples, max_length=max_length)
    return encoded.withColumn("attention_mask", F.expr("array_repeat(1, size(input_ids))"))


def encoder_datasets(
    examples: DataFrame, seed: int, size: int, max_length: int = 256, keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Training subset and whole validation split as token, mask, segment and label columns.

    Padding is left to the batches. `keep` names columns to carry along, such as the id.
    """

    def inputs(part: DataFrame) -> DataFrame:
        encoded = _encoded(part, max_length)
        columns = keep_model_inputs(encoded).columns
        return encoded.select(*keep, *columns)

    return inputs(training_split(examples, seed, size)), inputs(evaluation_split(examples))


def decoder_datasets(
    examples: DataFrame, seed: int, size: int, max_length: int = 256, keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Training subset and whole validation split as padded prompts with answers.

    Only what the text steps add is returned, and `keep`. Rows without a prompt or a label
    word stay, with null tokens; `violation` tells why.
    """

    def inputs(part: DataFrame) -> DataFrame:
        originals = [c for c in part.columns if c not in keep]
        padded = pad(tokenise(prompt_rows(part), "text", max_length), max_length)
        return drop_originals(padded, [*originals, "prompt", "label_text", "text"])

    return inputs(training_split(examples, seed, size)), inputs(evaluation_split(examples))
