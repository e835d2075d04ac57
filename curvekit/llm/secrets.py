"""Secret scans: fixed patterns, and character Markov models of random against ordinary strings."""

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvekit.llm.common import map_slices

# The kinds of the base rules, in their order.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Shortest string that the Markov models judge. Below it random and ordinary strings are hard to tell apart by pairs
#: of characters alone; keys of that length are found by the base rules, next to a keyword.
LEAST_CANDIDATE = 16
# What the Markov models look at: runs of these characters.
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_CANDIDATE},}}={{0,2}}")
# Strings that are no secrets whatever their characters: a UUID, and one to four characters repeated.
PUBLIC = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|(.{1,4}?)\1{3,}.{0,3}")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_CODE = np.full(128, len(SYMBOLS), np.int64)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
_STATES = len(SYMBOLS) + 1  # the last one is the begin of a string

#: A candidate is a secret if its log-likelihood ratio reaches both, in nats.
LEAST_RATIO, LEAST_RATIO_PER_CHAR = 10.0, 0.5

#: Bounds of the training sample: documents that give ordinary strings, words of these that identifiers are made of, random
#: strings of each alphabet, and identifiers of each style.
TRAINING_DOCUMENTS, TRAINING_WORDS = 2000, 2000
RANDOM_STRINGS = IDENTIFIERS = 2000
ALPHABETS = {
    "base64": SYMBOLS[:62] + "+/",
    "url64": SYMBOLS[:62] + "_-",
    "base62": SYMBOLS[:62],
    "hex": "0123456789abcdef",
    "base32": SYMBOLS[:26] + "234567",
}

# Words that names in programs are made of.
PROGRAM_WORDS = (
    "get set is has add new old to of by in on at id key map list array string int long double char byte file path dir folder "
    "name type class object value node tree root leaf parent child index count size length width height depth max min sum "
    "total average first last next prev current user account profile email address phone city country order item product "
    "price customer client server service request response http https html xml json url uri api rest socket port host "
    "domain query table column row field record schema database connection session token cache buffer stream reader writer "
    "parser builder factory manager handler listener event message queue thread pool task job worker process system config "
    "option setting default property attribute parameter argument result error exception status code state flag mode level "
    "date time year month day hour minute second update delete insert create load save open close read write send receive "
    "start stop run test check validate convert format encode decode upload download image page link header footer"
).split()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the base rules, leftmost and not overlapping per kind."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


KINDS = ("assign", "access", "hex", "random")


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def random_strings(spark: SparkSession, each: int = RANDOM_STRINGS, seed: int = 5) -> DataFrame:
    """Labelled random strings (text, is_random) of LEAST_CANDIDATE to 64 characters over known alphabets."""
    draws = np.random.default_rng(seed)
    rows = [
        ("".join(np.array(list(letters))[draws.integers(0, len(letters), draws.integers(LEAST_CANDIDATE, 65))]), True)
        for letters in ALPHABETS.values()
        for _ in range(each)
    ]
    return spark.createDataFrame(rows, "text string, is_random boolean")


def _chosen(docs: DataFrame, key: str, text: str, bound: int) -> DataFrame:
    """Texts of the `bound` documents with the smallest hash of their key, without what the base rules find in them."""
    chosen = docs.select(F.col(key).alias("k")).orderBy(F.xxhash64("k"), "k").limit(bound)
    some = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k", "left_semi")
    rules = f"(?i:{ASSIGN.pattern})|{ACCESS.pattern}|{HEX.pattern}"
    return some.select(F.regexp_replace("text", F.lit(rules), F.lit(" ")).alias("text"))


def ordinary_strings(docs: DataFrame, key: str = "doc_id", text: str = "text", bound: int = TRAINING_DOCUMENTS) -> DataFrame:
    """Labelled ordinary strings: words, names and paths of 4 characters or more, of `bound` documents.

    What the base rules find is cut out first, with its surroundings; strings in which digits and letters
    mix do not count as ordinary, as they may be keys that no rule knows.
    """
    found = _chosen(docs, key, text, bound).select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_-]{4,}"), F.lit(0))).alias("text")
    )
    mixed = F.col("text").rlike("[0-9]") & F.col("text").rlike("[A-Za-z]")
    return found.where(~mixed).select("text", F.lit(False).alias("is_random"))


def training_words(docs: DataFrame, key: str = "doc_id", text: str = "text", bound: int = TRAINING_WORDS) -> list[str]:
    """At most `bound` different words of the training documents, in lower case, by the hash of the word."""
    words = _chosen(docs, key, text, TRAINING_DOCUMENTS).select(
        F.explode(F.regexp_extract_all("text", F.lit("(?<![A-Za-z0-9])[A-Za-z]{2,12}(?![A-Za-z0-9])"), F.lit(0))).alias("w")
    ).select(F.lower("w").alias("w")).distinct()
    return [r["w"] for r in words.orderBy(F.xxhash64("w"), "w").limit(bound).collect()]


def _cased(words, first=str.lower):
    return first(words[0]) + "".join(w.capitalize() for w in words[1:])


#: Styles of identifiers, from a few words and a number below 10,000 that is drawn with them.
STYLES = {
    "camel": lambda w, n: _cased(w),
    "pascal": lambda w, n: _cased(w, str.capitalize),
    "acronym": lambda w, n: w[0][:4].upper() + _cased(w[1:] or w, str.capitalize) + (str(n) if n % 3 == 0 else ""),
    "numbered": lambda w, n: _cased(w) + str(n),
    "snake": lambda w, n: "_".join(w),
    "constant": lambda w, n: "_".join(w).upper(),
    "kebab": lambda w, n: "-".join(w),
    "title": lambda w, n: "_".join(x.capitalize() for x in w),
    "path": lambda w, n: "/" * (n % 2) + "/".join(w),
    "versioned": lambda w, n: f"{'-'.join(w)}-{n % 10}-{n % 100}",
    "joined": lambda w, n: "".join(w),
    "loud": lambda w, n: "".join(w).upper(),
    "dated": lambda w, n: f"{w[0]}-{1970 + n % 80}-{1 + n % 12:02d}-{1 + n % 28:02d}",
    "dates": lambda w, n: "-".join(f"{1970 + n % 80}-{1 + (n + i) % 12:02d}-{1 + (n + i) % 28:02d}" for i in range(3)),
    "digits": lambda w, n: str(n) * 5,
    "repeated": lambda w, n: (SYMBOLS[n % 65] * (4 + n % 40)),
    "link": lambda w, n: f"https/www/{w[0]}/com/{'/'.join(w[1:])}",
    "module": lambda w, n: f"/{w[0][:3]}/lib/{w[0]}{n % 10}/{'-'.join(w[1:])}",
}


def identifiers(words: list[str], each: int = IDENTIFIERS, seed: int = 6) -> list[tuple[str, str]]:
    """(style, identifier): `each` of every style, made of the given words and of words of programs, by turns."""
    draws = np.random.default_rng(seed)
    out = []
    for style, make in STYLES.items():
        for i in range(each):
            source = words if words and i % 2 else PROGRAM_WORDS
            picked = [source[k] for k in draws.integers(0, len(source), draws.integers(2, 7))]
            out.append((style, make(picked, int(draws.integers(0, 10_000)))))
    return out


def identifier_strings(spark: SparkSession, words: list[str], each: int = IDENTIFIERS) -> DataFrame:
    """Labelled identifiers (text, is_random) of all styles."""
    return spark.createDataFrame([(text, False) for _, text in identifiers(words, each)], "text string, is_random boolean")


def train(samples: DataFrame, smoothing: float = 0.5, backoff: float = 8.0) -> np.ndarray:
    """log P(next | last, random) - log P(next | last, ordinary) for each pair of characters.

    samples(text, is_random). Pairs are counted by a grouped aggregation; what comes back is
    at most one count for each class and pair of the fixed alphabet. A pair's probability backs
    off, by the weight of `backoff` pairs, to the frequency of its second character.
    """
    letters = F.split("text", "")
    pairs = samples.where(F.length("text") > 0).select(
        "is_random",
        F.explode(
            F.arrays_zip(
                F.concat(F.array(F.lit("")), letters).alias("last"), letters.alias("next")
            )
        ).alias("pair"),
    )
    counted = pairs.where("pair.next is not null and pair.next != ''").groupBy(
        "is_random", "pair.last", "pair.next"
    ).count()
    known = [*SYMBOLS, ""]
    table = np.zeros((2, _STATES, len(SYMBOLS)))
    for row in counted.where(F.col("last").isin(known) & F.col("next").isin(list(SYMBOLS))).collect():
        last = _STATES - 1 if row["last"] == "" else int(_CODE[ord(row["last"])])
        table[int(row["is_random"]), last, int(_CODE[ord(row["next"])])] += row["count"]
    single = table.sum(axis=1, keepdims=True) + smoothing
    table += backoff * single / single.sum(axis=2, keepdims=True)
    logs = np.log(table / table.sum(axis=2, keepdims=True))
    return logs[1] - logs[0]


def log_ratio(model: np.ndarray, text: str) -> float:
    """Sum of the model's log ratios over a string of SYMBOLS."""
    codes = _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
    return float(model[np.concatenate([[_STATES - 1], codes[:-1]]), codes].sum())


def is_secret(model: np.ndarray, text: str) -> bool:
    """Whether a string of SYMBOLS is random rather than ordinary, and not of a public format."""
    score = log_ratio(model, text)
    return score >= LEAST_RATIO and score >= LEAST_RATIO_PER_CHAR * len(text) and not PUBLIC.fullmatch(text)


def find_secrets(docs: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans.

    Whole texts are scanned. A span is kind:start:end in code points, end exclusive, ordered by
    start, then kind. Candidates that a base span overlaps are left to it. A null text
    counts as empty: no spans, and the hash of the empty string. Other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        ratios = shipped.value

        def scan(text):
            base = base_spans(text)
            starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
            more = []
            for m in CANDIDATE.finditer(text):
                a, b = m.span()
                before = bisect_left(starts, b)  # base spans that start before the candidate ends
                if not (before and reach[before - 1] > a) and is_secret(ratios, m[0]):
                    more.append((a, 3, b))
            return base, more

        def one(part):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")}
            for text in part.column("text").to_pylist():
                base, more = scan(text or "")
                for rank, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(k == rank for _, k, _ in base))
                out["n_random"].append(len(more))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(sorted(base + more)))
            return out | {"doc_id": part.column("doc_id")}

        return one

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_slices(
        chosen,
        work,
        "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string",
    )
