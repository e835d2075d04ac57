"""Near duplicates by MinHash: minima of universal hashes in bands, verified signatures, alternating stars.

A set's signature are the minima of HASHES universal hash functions over its shingles. ROWS of them make a band;
sets that agree in a band are in one bucket. Pairs of a bucket are verified twice: by one bit of each
minimum, which bounds the similarity from above with a stated risk, and what is left on the full sets.

Each different set is one node, so exact copies meet nobody. At first each node meets one pivot; what is found linked is
joined into classes, and buckets of one class are closed. Of the others, those of a few entries are compared
whole. A larger one is not expanded into its pairs: its entries meet its most central one, and go on as their
differences from it (shingles that one of the two has and the other has not). Two sets differ in what their differences do not
share, so a link needs differences that share their first parts in an order with rare ones first; only such entries meet. Every link between two classes of
a bucket is found, and copies with edits of their own, however many, do not meet each other.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvekit.llm.common import map_slices
from curvekit.llm.links import (
    alternating_stars,
    confirmed,
    differences_from_centre,
    gather_sets,
    pairs_by_differences,
    popular_centres,
    set_digest,
    shingle_sets,
)
from curvekit.session import materialize

WORDS, PERCENT = 5, 85
#: Sets of similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS: all but one in a million at 0.85.
ROWS, BANDS = 7, 36
HASHES = 256
#: Standard deviations beyond the mean at which a pair at the threshold counts as refuted by its signatures.
DEVIATIONS = 7.5
#: Entries of a bucket that is compared whole, and entries asked for a bucket's centre.
WHOLE, ASKED = 16, 64
SEED = 20
#: Shingles hashed at once: what fits in a core's cache.
CHUNK = 1 << 14

_LANES = [f"s{i}" for i in range(HASHES // 64)]


def universal(count: int = HASHES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of hash functions x -> a * x + b modulo 2**64, compared by their upper bits."""
    draw = np.random.default_rng(seed)
    a, b = draw.integers(0, 1 << 64, (2, count), np.uint64)
    return a | np.uint64(1), b


def minima(sets: list[np.ndarray], functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of minima for each (not empty) set."""
    factors, offsets = functions
    out = np.empty((len(factors), len(sets)), np.uint64)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sets):
        base = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        x = np.concatenate(sets[first:last])
        starts = ends[first:last] - sizes[first:last] - base
        hashed = np.empty_like(x)
        for k in range(len(factors)):
            np.multiply(x, factors[k], out=hashed)
            hashed += offsets[k]
            np.minimum.reduceat(hashed, starts, out=out[k, first:last])
        first = last
    return np.ascontiguousarray(out.T)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """BANDS keys of each signature; bands have keys of their own."""
    keys = np.empty((len(signatures), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(signatures), 2 * band + 1, np.uint64)
        for row in range(ROWS):
            key = (key ^ signatures[:, band * ROWS + row]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys.view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """One bit of each minimum, 64 to a word."""
    bits = ((signatures >> np.uint64(20)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def most_unlike(percent: int = PERCENT) -> int:
    """Bits in which sketches of sets at the threshold differ at most: half of the minima that differ do."""
    share = (100 - percent) / 200
    return math.floor(HASHES * share + DEVIATIONS * math.sqrt(HASHES * share * (1 - share)))


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, name, n, digest, bands and sketch of each row; the name finds one row of a set in a later scan."""

    def work():
        functions = universal()

        def one(part):
            sets = shingle_sets(part.column("text").to_pylist(), words)
            some = [i for i, s in enumerate(sets) if len(s)]
            out = {c: [None] * len(sets) for c in ("digest", "bands", *_LANES)}
            with np.errstate(over="ignore"):
                signatures = minima([sets[i] for i in some], functions)
                keys = band_keys(signatures).tolist()
            words_of = sketches(signatures)
            for at, i in enumerate(some):
                out["digest"][i] = set_digest(sets[i])
                out["bands"][i] = keys[at]
                for lane, value in zip(_LANES, words_of[at].tolist()):
                    out[lane][i] = value
            return out | {"doc_id": part.column("doc_id"), "name": part.column("name"), "n": [len(s) for s in sets]}

        return one

    lanes = ", ".join(f"{lane} long" for lane in _LANES)
    return map_slices(docs, work, f"doc_id long, name long, n long, digest binary, bands array<bigint>, {lanes}")


def _nodes(rows: DataFrame) -> DataFrame:
    """One row for each different set, with a number of its own and the smallest key of its documents."""
    kept = ["n", "name", "bands", *_LANES]
    grouped = rows.where("n > 0").groupBy("digest").agg(
        *[F.first(c).alias(c) for c in kept], F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    return materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")


def _buckets(nodes: DataFrame) -> DataFrame:
    """Entries (key, node, n, sketch, class) of the buckets that hold more than one node.

    The keys are written first: while they are few the planner broadcasts them, and no entry is shuffled again.
    """
    entries = nodes.select(F.explode("bands").alias("key"), "node")
    shared = materialize(
        entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "minhash-keys"
    )
    found = materialize(entries.join(shared, "key"), "minhash-entries")
    known = nodes.select("node", "n", *_LANES, F.col("node").alias("class"))
    return materialize(found.join(known, "node"), "minhash-buckets")


def _open(entries: DataFrame) -> DataFrame:
    """Entries of the buckets that still hold more than one class."""
    keys = entries.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x != y").select("key")
    return entries.join(keys, "key", "left_semi")


def _may_link(percent: int) -> Column:
    """Whether sizes and sketches of an entry and a pivot (columns p_*) leave the threshold possible."""
    differ = sum((F.bit_count(F.col(lane).bitwiseXOR(F.col(f"p_{lane}"))) for lane in _LANES[1:]), F.bit_count(F.col(_LANES[0]).bitwiseXOR(F.col(f"p_{_LANES[0]}"))))
    return (
        (F.col("class") != F.col("p_class"))
        & (F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent)
        & (differ <= most_unlike(percent))
    )


def _as_pivots(entries: DataFrame, *more: str) -> DataFrame:
    return entries.select("key", *more, *[F.col(c).alias(f"p_{c}") for c in ("node", "n", "class", *_LANES)])


def _first_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each node with one pivot of its buckets: the one whose hash is the smallest."""
    fields = ["node", "n", "class", *_LANES]
    pivots = entries.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), *fields)).alias("p")).select("key", "p.*")
    met = entries.join(_as_pivots(pivots), "key").where(_may_link(percent))
    chosen = met.groupBy("node").agg(F.min(F.struct(F.xxhash64("p_node").alias("h"), "p_node")).alias("p"))
    return chosen.select(F.col("node").alias("a"), F.col("p.p_node").alias("b"))


def _pairs_of_small(entries: DataFrame, percent: int) -> DataFrame:
    """Every pair of two classes of a bucket that may be linked."""
    met = entries.join(_as_pivots(entries), "key").where(F.col("node") < F.col("p_node")).where(_may_link(percent))
    return met.select(F.col("node").alias("a"), F.col("p_node").alias("b")).distinct()


def _centres(entries: DataFrame) -> DataFrame:
    """(key, pivot): the entry whose sketch is nearest to the majority of ASKED entries' sketches, bit by bit.

    Any entry would do; a central one has small differences.
    """
    slot = F.pmod(F.xxhash64("node"), F.lit(ASKED)).alias("slot")
    some = entries.groupBy("key", slot).agg(F.min(F.struct("node", *_LANES)).alias("p"))
    lists = some.groupBy("key").agg(*[F.collect_list(f"p.{lane}").alias(lane) for lane in _LANES])

    def majority(batches):
        for batch in batches:
            out = []
            for lanes in zip(*(batch.column(lane).to_pylist() for lane in _LANES)):
                words = np.ascontiguousarray(np.array(lanes, "<i8").T)
                bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                half = (2 * bits.sum(axis=0, dtype=np.int64) > len(words)).astype(np.uint8)
                out.append(np.packbits(half, bitorder="little").view("<i8").tolist())
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[] for _ in _LANES])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", *[f"c_{lane}" for lane in _LANES]])

    centre = lists.mapInArrow(majority, ", ".join(["key long", *[f"c_{lane} long" for lane in _LANES]]))
    away = sum((F.bit_count(F.col(lane).bitwiseXOR(F.col(f"c_{lane}"))) for lane in _LANES), F.lit(0))
    nearest = entries.join(materialize(centre, "minhash-centres"), "key")
    best = F.min(F.struct(away.alias("away"), F.xxhash64("node").alias("h"), "node"))
    return nearest.groupBy("key").agg(best.alias("p")).select("key", F.col("p.node").alias("pivot"))


def _link(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Labels of all linked nodes but the labels themselves, or None where there is no bucket."""
    if entries.isEmpty():
        return None
    checked = confirmed(materialize(_first_pairs(entries, percent), "minhash-pairs"), sets, percent)
    labels = alternating_stars(checked.where("linked"))
    of = labels.select(F.col("node").alias("_node"), "label")
    moved = entries.join(of, F.col("node") == F.col("_node"), "left")
    moved = moved.withColumn("class", F.coalesce("label", "node")).drop("_node", "label")
    left = materialize(_open(moved), "minhash-open")
    if left.isEmpty():
        return labels

    sizes = materialize(left.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "minhash-sizes")
    small = left.join(sizes.where(F.col("m") <= WHOLE).select("key"), "key")
    large = materialize(left.join(sizes.where(F.col("m") > WHOLE).select("key"), "key"), "minhash-large")
    pairs = _pairs_of_small(small, percent)
    edges = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    if not large.isEmpty():
        centres = popular_centres(large, _centres(large))
        met = large.select("key", F.col("node").alias("a")).join(centres, "key")
        met = materialize(met.select("a", F.col("pivot").alias("b")).where("a != b").distinct(), "minhash-met")
        differences = differences_from_centre(met, sets, percent)
        edges = edges.union(differences.where("linked").select("a", "b"))
        classes = large.select("node", "class").distinct()
        pairs = pairs.union(pairs_by_differences(differences, classes, percent)).distinct()
    tested = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "minhash-pairs")
    linked = confirmed(pairs, sets, percent).where("linked").select("a", "b")
    return alternating_stars(edges.union(linked))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept and class_size.

    Rows are linked whose sets of shingles of `words` words have a Jaccard similarity of `percent` or more; links are confirmed
    on the full sets (64-bit hashes). component_id is the smallest doc_id reachable over links, itself
    included, and `kept` marks the row that has it. A pair at the very threshold that is alone in its component is
    missed with a probability of one in a million (bands) and less (signatures); more similar ones with far less.
    A text with fewer words is one shingle; a null text is empty, and a row without words is linked with nothing.
    A null key is a component_id only where a component has no other one. Repeated keys keep their rows. Other
    columns are not read.
    """
    chosen = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(key, text).alias("name")
    )
    rows = materialize(_signed(chosen, words), "minhash-rows")
    nodes = _nodes(rows)
    entries = _buckets(nodes)
    wanted = nodes.select("node", "digest", "name").join(entries.select("node").distinct(), "node", "left_semi")
    labels = _link(entries, gather_sets(chosen, materialize(wanted, "minhash-wanted"), words), percent)

    classes = nodes.select("digest", "node", "least", "copies").withColumn("class", F.col("node"))
    if labels is not None:
        of = labels.select(F.col("node").alias("_node"), "label")
        classes = classes.join(of, F.col("node") == F.col("_node"), "left").withColumn("class", F.coalesce("label", "class"))
    totals = classes.groupBy("class").agg(F.min("least").alias("component_id"), F.sum("copies").alias("class_size"))
    known = classes.join(totals, "class").select(F.col("digest").alias("_digest"), "component_id", "class_size")
    empty = F.col("n") == 0
    found = rows.select("doc_id", "n", "digest").join(known, F.col("digest") == F.col("_digest"), "left")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
