"""Links between sets of shingles: the sets themselves, their verification, large groups, and connected components.

Helpers that the two near-duplicate operators share. Nodes are numbers that stand for one set each.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvekit.llm.common import map_slices, release_memos
from curvekit.session import materialize

#: Parts that a node's partners are dealt into, so that one with very many of them is no single task's.
SALTS = 32
#: Nodes of a pivot that are asked for common differences, and how many of them must have one.
SAMPLED, COMMON = 16, 3

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; none without words.

    Two shingles share a hash with probability 2**-64.
    """
    import xxhash

    known: dict[bytes, int] = {}
    flat, counts = [], []
    for text in texts:
        split = (text or "").encode("utf-8", "surrogatepass").lower().split()
        counts.append(len(split))
        flat += split
    for w in flat:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    codes = np.array([known[w] for w in flat], np.uint64)
    out, at = [], 0
    with np.errstate(over="ignore"):
        rolled = _mix(codes + np.uint64(words))
        for k in range(1, words):
            longer = _mix(rolled[: max(0, len(codes) - k)] * np.uint64(0x9E3779B97F4A7C15) + codes[k:])
            rolled = longer
        for n in counts:
            if n >= words:
                out.append(np.unique(rolled[at : at + n - words + 1]))
            elif n:
                whole = np.uint64(n)
                for c in codes[at : at + n]:
                    whole = _mix(np.array([whole * np.uint64(31) + c], np.uint64))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(codes[:0])
            at += n
    return out


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def odd_parts(shingles: np.ndarray) -> bytes:
    """Bits of a set: whether each of equal parts of the hashes holds an odd number of its shingles, about one part for a shingle."""
    parts = 64 << max(0, (len(shingles) - 1).bit_length() - 6)
    held = np.bincount((shingles & np.uint64(parts - 1)).astype(np.int64), minlength=parts)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").tobytes()


def differing_parts(a: bytes, b: bytes) -> int:
    """In how many of odd_parts() two sets differ, in the coarser parts of the two: they differ in as many shingles at least."""
    size = min(len(a), len(b))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8).reshape(-1, size), axis=0) for raw in (a, b))
    return int(np.unpackbits(x ^ y).sum())


def likely_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that odd_parts() do not rule out, from sketches(node, n, odd). Sets of n and m shingles that
    are linked differ in (100 - percent) / (100 + percent) of n + m at most."""

    def work():
        def one(part):
            columns = (part.column(c).to_pylist() for c in ("a", "b", "n", "p_n", "odd", "p_odd"))
            kept = [
                (a, b) for a, b, n, m, x, y in zip(*columns)
                if (100 + percent) * differing_parts(x, y) <= (100 - percent) * (n + m)
            ]
            return {"a": [a for a, _ in kept], "b": [b for _, b in kept]}

        return one

    of_a = sketches.select(F.col("node").alias("a"), "n", "odd")
    of_b = sketches.select(F.col("node").alias("b"), F.col("n").alias("p_n"), F.col("odd").alias("p_odd"))
    return map_slices(pairs.select("a", "b").join(of_a, "a").join(of_b, "b"), work, "a long, b long")


def gather_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and full set (sorted 64-bit hashes) of wanted(name, digest, node), from the rows of docs(name, text) so named.

    While the names are few the planner broadcasts them and only the texts wanted leave the scan. Sets are moved once: rows
    of one node have one digest, by which they are already dealt.
    """

    def work():
        release_memos()

        def one(part):
            sets = shingle_sets(part.column("text").to_pylist(), words)
            return {"digest": [set_digest(s) for s in sets], "shingles": [s.astype("<u8").tobytes() for s in sets]}

        return one

    texts = docs.join(wanted.select("name").distinct(), "name", "left_semi").select("text")
    found = map_slices(texts, work, "digest binary, shingles binary").join(wanted.select("digest", "node"), "digest")
    return materialize(found.dropDuplicates(["digest", "node"]).select("node", "shingles"), "sets")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with both sets, sa and sb. Partners of one b are dealt into SALTS parts, each with its set."""
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).alias("salt")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    right = pairs.select("b", salt).distinct().join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return left.withColumn("salt", salt).join(right, ["b", "salt"]).select("a", "b", "sa", "sb")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with `linked`: whether their full sets reach the threshold."""

    def work():
        def one(part):
            keep = []
            for raw in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist()):
                a, b = (np.frombuffer(x, "<u8") for x in raw)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            return {"a": part.column("a"), "b": part.column("b"), "linked": keep}

        return one

    return materialize(map_slices(with_sets(pairs, sets), work, "a long, b long, linked boolean"), "confirmed")


def popular_centres(entries: DataFrame, centres: DataFrame) -> DataFrame:
    """centres(key, pivot) with each pivot replaced by the one that most groups have, of the groups it is in itself.

    Groups of entries(key, node) overlap, so one pivot can serve many of them: any set near the group will do.
    """
    centres = materialize(centres.select("key", "pivot"), "centres")
    groups = centres.groupBy("pivot").agg(F.count(F.lit(1)).alias("groups"))
    own = centres.select(F.col("pivot").alias("node")).distinct()
    near = entries.select("key", "node").join(own, "node").join(centres, "key").join(groups, "pivot")
    best = F.max(F.struct("groups", F.xxhash64("pivot").alias("h"), "pivot"))["pivot"].alias("better")
    better = near.groupBy(F.col("node").alias("pivot")).agg(best)
    return centres.join(better, "pivot").select("key", F.col("better").alias("pivot"))


def differences_from_centre(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b) of a node and its pivot with linked, n, p_n and the shingles that only one has: added (a's) and removed (b's)."""

    def work():
        def one(part):
            out = {c: [] for c in ("linked", "n", "p_n", "added", "removed")}
            for raw in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist()):
                a, b = (np.frombuffer(x, "<u8") for x in raw)
                out["n"].append(len(a))
                out["p_n"].append(len(b))
                out["added"].append(np.setdiff1d(a, b, True).view("<i8").tolist())
                out["removed"].append(np.setdiff1d(b, a, True).view("<i8").tolist())
                differ = len(out["added"][-1]) + len(out["removed"][-1])
                out["linked"].append((100 + percent) * differ <= (100 - percent) * (len(a) + len(b)))
            return out | {"a": part.column("a"), "b": part.column("b")}

        return one

    schema = "a long, b long, linked boolean, n long, p_n long, added array<bigint>, removed array<bigint>"
    return materialize(map_slices(with_sets(met, sets), work, schema), "differences")


def _common_differences(differences: DataFrame) -> DataFrame:
    """(b, common): shingles in which COMMON of SAMPLED nodes of a pivot differ from it. They order, they never decide."""
    both = F.concat("added", "removed")
    slot = F.pmod(F.xxhash64("a"), F.lit(SAMPLED)).alias("slot")
    some = differences.groupBy("b", slot).agg(F.min_by(both, "a").alias("differ"))
    often = some.select("b", F.explode("differ").alias("shingle")).groupBy("b", "shingle").agg(F.count(F.lit(1)).alias("m"))
    return often.where(F.col("m") >= COMMON).groupBy("b").agg(F.collect_list("shingle").alias("common"))


def pairs_by_differences(differences: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes with one pivot whose differences from it may share enough for a link.

    Sets of n and m shingles are linked if they differ in no more than q (n + m) of them, where q = (100 - percent) /
    (100 + percent); differences of s and t shingles must thus share (s + t - q (n + m)) / 2 of them. A node that is not linked with
    the pivot has s > q (n + n of the pivot), which bounds what a partner must share with it: at least `share`. In
    any one order, the partner's first t - share + 1 hold one of the shared ones; of a partner
    that is not linked with the pivot either, so do this node's own first ones. If it is the first shared one, what
    stands behind it on both sides must be enough. Nodes linked with the pivot are in one class and need not meet.

    The order puts first what is likely rare: shingles that the pivot has not, then its own, then those common to the nodes.
    """
    up, down = 100 + percent, 100 - percent

    def work():
        def one(part):
            out = {"early": [], "shingles": []}
            columns = (part.column(c).to_pylist() for c in ("linked", "n", "p_n", "added", "removed", "common"))
            for linked, n, p_n, added, removed, common in zip(*columns):
                differ = np.array(added + removed, np.int64)
                late = np.isin(differ, np.array(common or [], np.int64))
                order = np.lexsort((differ, np.arange(len(differ)) >= len(added), late))
                share = max(1, (up * len(differ) + down * (p_n - n)) // (2 * up) + 1)
                early = max(0, len(differ) - share + 1)
                out["early"].append(early)
                out["shingles"].append(differ[order[:early] if linked else order].tolist())
            return out | {c: part.column(c) for c in ("a", "b", "linked", "n", "s", "class")}

        return one

    known = differences.withColumn("s", (F.size("added") + F.size("removed")).cast("long"))
    known = known.join(classes.withColumnRenamed("node", "a"), "a").join(_common_differences(differences), "b", "left")
    ordered = map_slices(
        known, work, "a long, b long, linked boolean, n long, s long, class long, early long, shingles array<bigint>"
    )
    placed = materialize(
        ordered.select(
            F.col("a").alias("node"), F.col("b").alias("pivot"), "linked", "n", "s", "class", "early",
            F.posexplode("shingles").alias("place", "shingle"),
        ).withColumn("early", F.col("place") < F.col("early")),
        "placed",
    )
    this = placed.where(~F.col("linked"))
    that = placed.where("early").select("pivot", "shingle", *[F.col(c).alias(f"p_{c}") for c in ("node", "n", "s", "linked", "place", "class")])
    behind = F.least(F.col("s") - F.col("place"), F.col("p_s") - F.col("p_place"))
    enough = 2 * up * behind >= up * (F.col("s") + F.col("p_s")) - down * (F.col("n") + F.col("p_n"))
    sizes = F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent
    turn = F.col("p_linked") | (F.col("early") & (F.col("node") < F.col("p_node")))
    met = this.join(that, ["pivot", "shingle"]).where((F.col("class") != F.col("p_class")) & turn & sizes & enough)
    return met.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()


def alternating_stars(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over edges (a, b), for all nodes but the labels themselves.

    Large-star hands the larger neighbours of a node to the smallest one around it, small-star the
    node and its smaller neighbours; both keep what is connected. Alternated until only stars are left, each around its
    label: the centre of every edge is the smaller node.
    """
    current = materialize(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars"
    )
    while not _only_stars(current):
        around = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        current = materialize(small.distinct(), "small-stars")
    return current.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, or edges from larger ones only."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    mixed = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return mixed.where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()
