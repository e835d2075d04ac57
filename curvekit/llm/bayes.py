"""Quality classifier: document evidence and site posteriors, joined by hierarchical empirical Bayes."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvekit.llm.common import map_slices
from curvekit.session import materialize

FEATURES = ("words", "upper", "digits", "symbols", "marks", "distinct", "adjacent", "lines", "word_length", "top_word")
BINS = 24
#: Pseudo-counts of a feature's bin, and the share of an evidence sum that counts, as features overlap.
SMOOTHING, TEMPER = 1.0, 0.5
#: Limits of the prior's weight, in labelled documents.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0
KEEP_FROM = 0.5

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>@=+~^_{}[]\\/"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?;:\"'()"]] = True


def _bins(text: str) -> list[int]:
    """The bin of each feature, from 0 to BINS - 1, over the whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0] * len(FEATURES)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = sum(map(len, words))
    seen: dict = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [line for line in raw.split(b"\n") if line.strip()]
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    shares = [
        np.sqrt(bytes_[kind].sum() / chars) for kind in (_UPPER, _DIGIT, _SYMBOL, _MARK)
    ]
    levels = [
        np.log2(n) / BINS,
        *shares,
        min(1.0, len(seen) / n**0.8),
        np.sqrt(adjacent / n),
        1 - len(set(lines)) / len(lines),
        chars / n / BINS,
        np.sqrt(max(seen.values()) / n),
    ]
    return [min(BINS - 1, int(v * BINS)) for v in levels]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """Per row: doc_id, host, path and `bins`, one small number per feature of the whole text."""
    chosen = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.col(host).cast("string").alias("host"),
        F.col(path).cast("string").alias("path"),
    )

    def work():
        def one(part):
            return {
                "doc_id": part.column("doc_id"),
                "host": part.column("host"),
                "path": part.column("path"),
                "bins": [_bins(t or "") for t in part.column("text").to_pylist()],
            }

        return one

    return map_slices(chosen, work, "doc_id long, host string, path string, bins array<int>")


def _logit(p: Column) -> Column:
    return F.ln(p / (F.lit(1.0) - p))


def evidence(labelled: DataFrame) -> DataFrame:
    """Per (feature, bin): the log-likelihood ratio of good against bad labelled documents.

    labelled(bins, good). One grouped aggregation; the result has at most
    len(FEATURES) * BINS rows.
    """
    counted = (
        labelled.select("good", F.posexplode("bins").alias("feature", "bin"))
        .groupBy("feature", "bin")
        .agg(F.sum("good").cast("double").alias("good"), F.count(F.lit(1)).cast("double").alias("n"))
    )
    every = labelled.sparkSession.range(len(FEATURES) * BINS).select(
        (F.col("id") / BINS).cast("int").alias("feature"), (F.col("id") % BINS).cast("int").alias("bin")
    )
    whole = Window.partitionBy("feature")
    good = F.coalesce("good", F.lit(0.0)) + SMOOTHING
    bad = F.coalesce(F.col("n") - F.col("good"), F.lit(0.0)) + SMOOTHING
    return every.join(counted, ["feature", "bin"], "left").select(
        "feature", "bin", (F.ln(good / F.sum(good).over(whole)) - F.ln(bad / F.sum(bad).over(whole))).alias("ratio")
    )


def _prior_weight(sites: DataFrame) -> float:
    """Weight of the prior by moments: how much less rates differ between sites than labels do.

    sites(parent, good, n): sites are compared with their own parent's rate, so that differences between parents
    do not count. The variance between the sites of a parent is what the observed one has beyond chance, pooled over the
    parents; the weight is large where sites are alike and small where they differ.
    """
    parents = sites.groupBy("parent").agg(
        F.sum("good").alias("g"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"), F.sum(F.pow("n", F.lit(2.0))).alias("n2"),
        F.sum(F.col("good") * F.col("good") / F.col("n")).alias("squares"),
    )
    rate = F.col("g") / F.col("n")
    chance = rate * (1 - rate)
    m = parents.agg(
        F.sum(F.col("squares") - F.col("g") * rate).alias("ss"),  # n (rate of the site - rate of the parent)^2
        F.sum((F.col("sites") - 1) * chance).alias("expected"),
        F.sum(F.col("n") - F.col("n2") / F.col("n")).alias("spread"),
        F.sum(F.col("n") * chance).alias("within"),
        F.sum("n").alias("n"),
        F.max("sites").alias("most"),
    ).first()
    if not m["n"] or m["most"] < 2:
        return LEAST_PRIOR
    within = m["within"] / m["n"]
    between = max(0.0, (m["ss"] - m["expected"]) / m["spread"]) if m["spread"] > 0 else 0.0
    return float(min(MOST_PRIOR, max(LEAST_PRIOR, within / between - 1 if between > 1e-12 else MOST_PRIOR)))


def site_rates(labelled: DataFrame) -> tuple[DataFrame, float]:
    """Posterior share of good documents per (host, path), and the global share.

    labelled(host, path, good). A path shrinks towards its host and a host towards the global
    share, each by a weight estimated from the spread between the sites of one parent. The counts and weights
    are returned, too: good, n, host_good, host_n, path_weight, host_weight.
    """
    paths = materialize(
        labelled.groupBy("host", "path").agg(F.sum("good").cast("double").alias("good"), F.count(F.lit(1)).cast("double").alias("n")),
        "labelled-paths",
    )
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    overall = ((total["good"] or 0.0) + 1) / ((total["n"] or 0.0) + 2)
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    host_weight = _prior_weight(hosts.select(F.lit(0).alias("parent"), F.col("host_good").alias("good"), F.col("host_n").alias("n")))
    path_weight = _prior_weight(paths.select(F.col("host").alias("parent"), "good", "n"))
    known = paths.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    known = known.withColumns({"host_weight": F.lit(host_weight), "path_weight": F.lit(path_weight)})
    host_rate, path_rate = _rates(overall, F.lit(0.0), F.lit(0.0))
    return known.withColumns({"host_rate": host_rate, "path_rate": path_rate}), overall


def _rates(overall: float, own_n: Column, own_good: Column) -> tuple[Column, Column]:
    """Shrunk rates of a host and a path from their counts, without `own_n` labels of which `own_good` are good.

    Counts that are null stand for sites without labels.
    """
    zero = F.lit(0.0)
    n, good = F.coalesce("n", own_n) - own_n, F.coalesce("good", own_good) - own_good
    host_n, host_good = F.coalesce("host_n", own_n) - own_n, F.coalesce("host_good", own_good) - own_good
    host_weight, path_weight = F.coalesce("host_weight", F.lit(1.0)), F.coalesce("path_weight", F.lit(1.0))
    host_rate = (F.greatest(host_good, zero) + host_weight * overall) / (host_n + host_weight)
    return host_rate, (F.greatest(good, zero) + path_weight * host_rate) / (n + path_weight)


def classify(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, **columns) -> DataFrame:
    """Per row: doc_id, evidence, host_rate, path_rate, quality (posterior) and kept.

    labels(doc_id, quality): 1 good, 0 bad; the mean counts where a document has several, and
    rows without either value are left out. Posterior log odds are the site's log odds plus the
    tempered log-likelihood ratios of the features. Documents of a path without labels take
    their host's rate, and of a host without labels the global rate. A labelled document's own label does not count in its
    site's rates. Without any label the
    posterior is one half and everything is kept. A null text counts as empty; null host and path
    are sites of their own; repeated keys keep their rows. Other columns are not read.
    """
    found = materialize(features(docs, **columns), "features")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("good")
    )
    labelled = materialize(found.join(marks, "doc_id"), "labelled")
    ratios = {
        (r["feature"], r["bin"]): r["ratio"] for r in evidence(labelled).collect()
    }  # len(FEATURES) * BINS rows
    table = F.array(*[F.array(*[F.lit(ratios[f, b]) for b in range(BINS)]) for f in range(len(FEATURES))])
    terms = F.transform("bins", lambda b, i: F.element_at(F.element_at(table, i + 1), b + 1))
    summed = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) * F.lit(TEMPER)
    rates, overall = site_rates(labelled)
    rates = materialize(rates, "site-rates")
    of_host = rates.groupBy("host").agg(*[F.first(c).alias(c) for c in ("host_good", "host_n", "host_weight")])
    sites = rates.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "good", "n", "path_weight")
    hosts = materialize(of_host.withColumnRenamed("host", "_g"), "host-rates")
    own = marks.select("doc_id", F.col("good").cast("double").alias("own_good"), F.lit(1.0).alias("own_n"))
    joined = (
        found.join(own, "doc_id", "left")
        .join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")), "left")
        .join(hosts, F.col("host").eqNullSafe(F.col("_g")), "left")
    )
    host_rate, path_rate = _rates(overall, F.coalesce("own_n", F.lit(0.0)), F.coalesce("own_good", F.lit(0.0)))
    log_odds = _logit(path_rate) + summed
    quality = F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))
    return joined.select(
        "doc_id",
        summed.alias("evidence"),
        host_rate.alias("host_rate"),
        path_rate.alias("path_rate"),
        quality.alias("quality"),
        (quality >= keep_from).alias("kept"),
    )
