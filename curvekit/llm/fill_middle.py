"""Fill-in-the-middle: texts cut in three at token or character borders and put in another order.

A text's code points and its UTF-8 bytes differ only behind characters of several bytes. Their places and
excess bytes, and nothing else, are the text's index; between two of them places differ by a constant,
so cuts are converted by one binary search and arithmetic, and an ASCII text has an empty index.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvekit.llm.common import map_slices

# The marks in front of the three parts, and shares in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMED_PERCENT, SPM_PERCENT = 90, 20
SEED = 1

COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class ExceptionIndex:
    """Places of the characters of several bytes in a text (given as its UTF-8 bytes).

    `chars` and `starts` are their places in code points and in bytes, `excess[i]` is the number of bytes beyond
    one each of the first i of them.
    """

    def __init__(self, raw: np.ndarray):
        self.n_bytes = len(raw)
        self.starts = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.starts]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(more)])
        self.chars = self.starts - self.excess[:-1]
        self.n_chars = self.n_bytes - int(self.excess[-1])

    def to_bytes(self, chars):
        """Byte places of cuts after so many code points."""
        return chars + self.excess[np.searchsorted(self.chars, chars, "left")]

    def to_chars(self, places):
        """Code points before cuts at byte places, which must not be inside a character."""
        return places - self.excess[np.searchsorted(self.starts, places, "left")]


def token_starts(raw: np.ndarray) -> np.ndarray:
    """Byte places at which the tokens `[A-Za-z]+|[^A-Za-z]` start."""
    letter = ((raw | 0x20) - np.uint8(0x61)) < 26  # unsigned: what lies below wraps around
    starts = (raw & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts)


def draws(key, seed: int = SEED) -> list[int]:
    """The first four 32-bit numbers of sha256 over `seed:key`; a null key is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def rearranged(raw: bytes, key, unit: str = "token", seed: int = SEED, formed: int = FORMED_PERCENT, spm: int = SPM_PERCENT):
    """(n, form, prefix_chars, middle_chars, output bytes) of one text."""
    view = np.frombuffer(raw, np.uint8)
    index = None
    if unit == "token":
        starts = token_starts(view)
        n = len(starts)
    else:
        index = ExceptionIndex(view)
        n = index.n_chars
    h1, h2, h3, h4 = draws(key, seed)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not raw or h3 % 100 >= formed or any(m in raw for m in marks):
        return n, "plain", None, None, raw
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    if unit == "token":
        low, high = (int(starts[c]) if c < n else len(raw) for c in cuts)
        index = ExceptionIndex(view)
        first, last = (int(c) for c in index.to_chars(np.array([low, high])))
    else:
        first, last = cuts
        low, high = (int(p) for p in index.to_bytes(np.array(cuts)))
    prefix, middle, suffix = raw[:low], raw[low:high], raw[high:]
    if h4 % 100 < spm:
        return n, "spm", first, last - first, b"".join([marks[1], suffix, marks[0], prefix, marks[2], middle])
    return n, "psm", first, last - first, b"".join([marks[0], prefix, marks[1], suffix, marks[2], middle])


def fill_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "token",
    seed: int = SEED, formed: int = FORMED_PERCENT, spm: int = SPM_PERCENT,
) -> DataFrame:
    """Per row: doc_id, n (units of the text), form, prefix_chars, middle_chars and output.

    Both cuts, and whether a text is formed (`formed` percent) and as spm (`spm` percent of these), depend on
    `seed` and key alone, so reruns agree and rows need no order. `unit` is token or char. A null text
    is empty; empty texts and texts that hold a mark stay plain, with null lengths; a null key draws like an
    empty one. Rows with repeated keys are cut alike, each by its own length. Other columns are not read.
    """
    if unit not in ("token", "char"):
        raise ValueError(f"unknown unit {unit}")

    def work():
        def one(part):
            keys = part.column("doc_id").to_pylist()
            raws = part.column("text").cast(pa.binary()).to_pylist()
            found = [rearranged(raw, k, unit, seed, formed, spm) for k, raw in zip(keys, raws)]
            n, form, first, middle, out = zip(*found) if found else ((),) * 5
            return {
                "doc_id": part.column("doc_id"), "n": n, "form": form, "prefix_chars": first,
                "middle_chars": middle, "output": pa.array(out, pa.binary()).cast(pa.string()),
            }

        return one

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_slices(rows, work, COLUMNS)


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output was made of. Its parts hold no mark, so each mark occurs once."""
    out = F.col(output) if isinstance(output, str) else output
    form = F.col(form) if isinstance(form, str) else form
    body = F.substring(out, len(PREFIX) + 1, 2**31 - 1)
    parts = F.substring_index(body, MIDDLE, 1)
    middle = F.substring_index(body, MIDDLE, -1)
    psm = F.concat(F.substring_index(parts, SUFFIX, 1), middle, F.substring_index(parts, SUFFIX, -1))
    spm = F.concat(F.substring_index(parts, PREFIX, -1), middle, F.substring_index(parts, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(out)


def digests(formed: DataFrame) -> DataFrame:
    """Rows of fill_middle() with digests of the output and of the text restored from it."""
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )
