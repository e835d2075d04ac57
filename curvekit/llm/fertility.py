"""Quality rules by tokeniser fertility: how a public vocabulary cuts a text up."""

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvekit.llm.common import map_slices, process_memo
from curvekit.llm.tokens import MEMO_CHARS, MEMO_ENTRIES, read_file
from curvekit.session import materialize

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
LEAST_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5

# Bands reach this many times the distance from the median to the quartiles, which junk in the
# tails does not move. On labelled documents of the test tables 6 rejects 0.3 % of the good ones.
WIDEN = 6.0
BIN = 0.002
#: Each measure's smallest distance from the median to a limit, on its own scale: near copies, which
#: are different texts, can bring the quartiles together as well.
LEAST_WIDTHS = {"chars_per_token": 0.15, "byte_share": 0.04, "entropy": 0.08}
MEASURES = tuple(LEAST_WIDTHS)

_SCHEMA = (
    "doc_id long, band string, digest binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"
)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(codes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per document: words inside 5-word windows found twice or more in it.

    codes: one number per distinct word, documents end to end; doc: each word's document.
    Windows are sorted by hash; neighbours of equal hash are compared word by word, and a
    document in which different windows share a hash is counted again from the words alone.
    """
    n = len(codes)
    out = np.zeros(docs, np.int64)
    if n < WINDOW:
        return out
    at = np.arange(n - WINDOW + 1)
    at = at[doc[at] == doc[at + WINDOW - 1]]
    with np.errstate(over="ignore"):
        h = (doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        for k in range(WINDOW):
            x = (codes[at + k].astype(np.uint64) + np.uint64(1)) * _MIX[k]
            h += x ^ (x >> np.uint64(29))
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    left, right = at[order[:-1][same]], at[order[1:][same]]
    equal = doc[left] == doc[right]
    for k in range(WINDOW):
        equal &= codes[left + k] == codes[right + k]
    marks = np.zeros(n + 1, np.int64)
    for side in (left[equal], right[equal]):
        side = np.unique(side)
        marks[side] += 1
        np.subtract.at(marks, side + WINDOW, 1)
    covered = np.cumsum(marks[:n]) > 0
    out += np.bincount(doc[covered], minlength=docs)
    for d in np.unique(doc[left[~equal]]):  # a hash collision: exact
        mine = codes[doc == d].tolist()
        seen: dict = {}
        for i in range(len(mine) - WINDOW + 1):
            seen.setdefault(tuple(mine[i : i + WINDOW]), []).append(i)
        inside = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(WINDOW)}
        out[d] = len(inside)
    return out


def script_of(text: str) -> str:
    """The most frequent script among the letters: the band where no language is given."""
    import unicodedata
    from collections import Counter

    found: Counter = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            found[unicodedata.name(c, "?").split(" ")[0]] += n
    return f"script {min(found, key=lambda s: (-found[s], s))}" if found else "script none"


class _Measurer:
    """Counts of the base rules and the fertility of whole texts."""

    def __init__(self, model: bytes):
        import sentencepiece
        import zlib

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.known = process_memo(f"spm-{zlib.crc32(model)}")
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.size = size

    def tokens(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, with its space in front, as bytes of unsigned 32-bit numbers."""
        known, new = self.known, {}
        asked = [w for w in words if w not in known]
        if asked:
            ids = self.model.encode([w.decode() for w in asked], num_threads=1)
            new = {w: np.array(x, "<u4").tobytes() for w, x in zip(asked, ids)}
            short = {w: ids for w, ids in new.items() if len(w) <= MEMO_CHARS}
            if len(known) + len(short) <= MEMO_ENTRIES:
                known.update(short)
        return [new[w] if w in new else known[w] for w in words]

    def __call__(self, part) -> dict:
        texts = [t or "" for t in part.column("text").to_pylist()]
        bands = part.column("band").to_pylist()
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        n_words = np.array([len(s) for s in split], np.int64)
        numbers: dict = {}
        flat = [numbers.setdefault(w, len(numbers)) for s in split for w in s]
        codes, doc = np.array(flat, np.int64), np.repeat(np.arange(len(texts)), n_words)
        ids = self.tokens(list(numbers))
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        joined = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
        many = lengths[codes] if len(codes) else lengths[:0]
        total = int(many.sum())
        place = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[codes] if total else many, many)
        token, of = joined[place] if total else place, np.repeat(doc, many)
        n_tokens = np.bincount(of, minlength=len(texts)).astype(np.int64)
        n_bytes = np.bincount(of[self.is_byte[token]], minlength=len(texts)) if total else n_tokens
        pairs, counts = np.unique(of * self.size + token, return_counts=True)
        p = counts / n_tokens[pairs // self.size] if total else counts.astype(float)
        entropy = np.bincount(pairs // self.size, weights=-p * np.log2(p), minlength=len(texts)) if total else np.zeros(len(texts))
        some = np.maximum(n_tokens, 1)
        word_chars = [len(t) - sum(map(t.count, BLANKS)) for t in texts]
        return {
            "doc_id": part.column("doc_id"),
            "band": [b if b is not None else script_of(t) for b, t in zip(bands, texts)],
            "digest": [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in split],
            "n_words": n_words,
            "word_chars": word_chars,
            "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
            "n_dup_lines": [_repeated_lines(t) for t in texts],
            "n_repeat_words": repeated_words(codes, doc, len(texts)),
            "n_tokens": n_tokens,
            "chars_per_token": np.array(word_chars) / some,
            "byte_share": n_bytes / some,
            "entropy": entropy / np.log2(np.maximum(np.minimum(n_tokens, self.size), 2)),
        }


def _repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def measure(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", lang: str | None = "lang"
) -> DataFrame:
    """Per row: a digest of its words, the counts of the base rules, n_tokens, characters per token, byte-fallback share
    and token entropy (as a share of its largest value), and the row's band.

    The band is the language, or the main script where `lang` is None or null. A null text
    counts as empty: all counts 0. Other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_file(model))
    chosen = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        (F.col(lang) if lang else F.lit(None)).cast("string").alias("band"),
    )
    return map_slices(chosen, lambda: _Measurer(shipped.value), _SCHEMA)


def _length(n: str = "n_words"):
    """Length class of a text: its measures scatter less the longer it is."""
    return F.floor(F.log2(F.greatest(F.col(n), F.lit(1))) / 2).cast("int")


def bands(measured: DataFrame, widen: float = WIDEN) -> DataFrame:
    """Per band and length class: the lowest and highest value accepted of each measure.

    From all documents that pass the base rules, each different text counted once however often
    it repeats: rows of equal words have equal measures. What is shuffled for that is a digest and the
    bins for each text; what is ordered is a bounded number of bins per band and never documents. A
    band goes from the median down and up by `widen` times the distance to the quartiles, and
    by the measure's LEAST_WIDTHS at least.
    """
    passed = measured.where("n_tokens > 0 and not base_failed")
    bins = [F.floor(F.col(m) / BIN).cast("long").alias(m) for m in MEASURES]
    counted = (
        passed.select("band", _length().alias("length"), "digest", *bins)
        .distinct()
        .drop("digest")
        .unpivot(["band", "length"], list(MEASURES), "measure", "bin")
        .groupBy("band", "length", "measure", "bin")
        .count()
    )
    whole = Window.partitionBy("band", "length", "measure")
    ranked = counted.withColumn("upto", F.sum("count").over(whole.orderBy("bin")) / F.sum("count").over(whole))
    at = {name: F.min(F.when(F.col("upto") >= q, F.col("bin"))) for name, q in (("low", 0.25), ("mid", 0.5), ("high", 0.75))}
    points = ranked.groupBy("band", "length", "measure").agg(*[v.alias(k) for k, v in at.items()])
    width = F.lit(None)
    for m, w in LEAST_WIDTHS.items():
        width = F.when(F.col("measure") == m, w / BIN).otherwise(width)
    least = F.col("mid") - F.greatest(F.lit(widen) * (F.col("mid") - F.col("low")), width)
    most = F.col("mid") + F.greatest(F.lit(widen) * (F.col("high") - F.col("mid")), width) + 1
    limits = points.select("band", "length", "measure", (least * BIN).alias("least"), (most * BIN).alias("most"))
    return limits.groupBy(F.col("band").alias("_band"), F.col("length").alias("_length")).agg(
        *[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("least", "most")]
    )


def judge(docs: DataFrame, model: str, **columns) -> DataFrame:
    """measure() with base_failed and kept: no base rule broken and all measures inside the band.

    Bands need tokens: a text without words fails the base rules. A band whose documents all
    fail has no limits and rejects no more. An empty table gives no rows.
    """
    measured = measure(docs, model, **columns).withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT),
    )
    measured = materialize(measured, "fertility")
    limits = materialize(bands(measured), "bands")
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce(F.col(m).between(F.col(f"{m}_least"), F.col(f"{m}_most")), F.lit(True))
    return (
        measured.join(limits, (F.col("band") == F.col("_band")) & (_length() == F.col("_length")), "left")
        .withColumn("kept", ~F.col("base_failed") & inside)
        .drop("digest", "_band", "_length", *[f"{m}_{side}" for m in MEASURES for side in ("least", "most")])
    )
