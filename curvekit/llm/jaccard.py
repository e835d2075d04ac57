"""N-gram Jaccard join: blocks of a sparse document-by-shingle product, and the classes its links make.

A document's shingles are put in one global order, rare ones first. Two sets whose Jaccard
similarity reaches the threshold share one of the first few shingles of each, so the product
is formed over these only: a shingle's column is a block. Pairs are dropped whose sizes rule out
the threshold, or whose places of the shared shingle do: what stands before the first shared
one is missing in the other set; or whose parities differ in too many bits: first of 64 parts of the hashes, then, for
pairs that are left, of about as many parts as a set has shingles. For the rest
whole sets are intersected.

No block is expanded into all its pairs. At first each document meets one pivot of its blocks, and blocks whose
documents are in one class by then are closed. Of the others, those of a few documents are compared whole; in a larger one
all meet the document with the fewest rarer shingles, and go on by their differences from it: see
links.pairs_by_differences(). A block of near copies therefore takes about as many pairs as it has documents.

The links of each document are counted once the classes are known: inside a class, blocks of
sets are multiplied, and what comes out is a number for each set, never a pair.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvekit.llm.common import map_slices, release_memos, slices
from curvekit.llm.links import (
    alternating_stars,
    confirmed,
    differences_from_centre,
    gather_sets,
    likely_pairs,
    odd_parts,
    pairs_by_differences,
    popular_centres,
    set_digest,
    shingle_sets,
)
from curvekit.session import materialize

WORDS, PERCENT = 3, 90
#: Counters of shingle frequencies: a fixed number whatever the input, in which every shingle of every row counts. They
#: order, they never decide.
SKETCH_BITS, SKETCH_BLOCKS = 24, 32
#: Entries of a block that is compared whole.
WHOLE = 16

#: Sets and shingles that a block of the link count has about at most, and the columns it is multiplied in.
COUNT_SETS, COUNT_SHINGLES, COUNT_COLUMNS = 512, 1 << 19, 2048


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many first shingles of a set of n must be looked at: n less the smallest overlap, plus 1."""
    return n + (-percent * n // 100) + 1


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, name, n and signature of each row; and the frequency counters of each task, in blocks."""

    def run(batches):
        release_memos()
        counters = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text").to_pylist(), words)
                digests, n = [set_digest(s) for s in sets], len(sets)
                if sets:
                    places = (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                    np.add.at(counters, places, 1)
                yield row(part.column("doc_id"), part.column("name"), [len(s) for s in sets], digests, [None] * n, [None] * n)
        if counters.any():
            for block, values in enumerate(np.split(counters, SKETCH_BLOCKS)):
                yield row([None], [None], [None], [None], [block], [zlib.compress(values.astype("<u4").tobytes(), 1)])

    def row(ids, name, n, signature, block, counts):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [a if isinstance(a, pa.Array) else pa.array(a, k) for a, k in zip((ids, name, n, signature, block, counts), kinds)],
            names=["doc_id", "name", "n", "signature", "block", "counts"],
        )

    return docs.mapInArrow(run, "doc_id long, name long, n long, signature binary, block int, counts binary")


def _frequencies(parts: DataFrame) -> np.ndarray:
    """Eighths of log2 of all tasks' summed counters, one byte each: a fixed 16 megabytes."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                values = np.frombuffer(zlib.decompress(raw), "<u4")
                total[block] = total.get(block, 0) + values.astype(np.uint64)
        for block, values in total.items():
            logs = np.minimum(8 * np.log2(values + 1.0), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([zlib.compress(logs.tobytes())], pa.binary())],
                names=["block", "counts"],
            )

    summed = parts.select("block", "counts").repartition(SKETCH_BLOCKS, "block").mapInArrow(run, "block int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    size = len(out) // SKETCH_BLOCKS
    for r in summed.collect():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return out


def _prefixes(docs: DataFrame, frequencies: np.ndarray, words: int, percent: int) -> DataFrame:
    """signature, parity, odd parts and the first shingles in the global order (frequency class, hash) of each row.

    parity has a bit for each of 64 parts of the hashes, set where the part holds an odd number of
    shingles: two sets differ in as many shingles at least as their parities in bits.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(frequencies)

    def work():
        release_memos()
        rank = shipped.value

        def one(part):
            signatures, parity, odd, first = [], [], [], []
            for s in shingle_sets(part.column("text").to_pylist(), words):
                signatures.append(set_digest(s))
                parity.append(int(np.bitwise_xor.reduce(np.uint64(1) << (s & np.uint64(63))).view(np.int64)) if len(s) else 0)
                odd.append(odd_parts(s))
                seldom = rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((s, seldom))[: prefix_length(len(s), percent)] if len(s) else []
                first.append(s[order].view(np.int64).tolist() if len(s) else [])
            return {"signature": signatures, "parity": parity, "odd": odd, "first": first}

        return one

    return map_slices(docs.select("text"), work, "signature binary, parity long, odd binary, first array<bigint>")


def _relabelled(table: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    new = labels.select(F.col("node").alias("_node"), "label")
    return table.join(new, F.col(column) == F.col("_node"), "left").withColumn(
        column, F.coalesce("label", column)
    ).drop("_node", "label")


def _open_blocks(entries: DataFrame) -> DataFrame:
    """Entries of the blocks that still hold more than one class."""
    blocks = entries.groupBy("block").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x != y")
    return entries.join(blocks.select("block"), "block", "left_semi")


def _may_link(percent: int):
    """Whether sizes, places of the shared shingle and parities of an entry and another (columns p_*) allow a link."""
    # The overlap needed, and the largest one possible if this is the first shared shingle.
    # Where it is not, the pair comes up in the block of the first one as well.
    need = F.ceil((F.col("n") + F.col("p_n")) * percent / F.lit(100 + percent))
    most = F.least(F.col("n") - F.col("place"), F.col("p_n") - F.col("p_place"))
    differ = F.bit_count(F.col("parity").bitwiseXOR(F.col("p_parity")))
    return (
        (F.col("class") != F.col("p_class"))
        & (F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent)
        & (most >= need)
        & (F.col("n") + F.col("p_n") - 2 * need >= differ)
    )


_FIELDS = ("node", "n", "class", "place", "parity")


def _as_partners(entries: DataFrame) -> DataFrame:
    return entries.select("block", *[F.col(c).alias(f"p_{c}") for c in _FIELDS])


def similar_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
    count_links: bool = True,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, class_size and n_links.

    component_id is the smallest doc_id reachable over links of at least `percent` Jaccard
    similarity, itself included; rows of equal sets are linked. n_links is the number of
    other different sets that the row's set is linked with, however many rows have them (left out without
    `count_links`, which saves the work). A null text is empty; a row without shingles has size 0, is
    its own component and is linked with nothing. Null keys take part, and are a component_id only
    where a component has no other key. Repeated keys keep their rows. Other columns are not read.
    """
    chosen = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(key, text).alias("name")
    )
    found = materialize(_signatures(chosen, words), "signatures")
    rows = found.where("block is null").select("doc_id", "name", "n", "signature")
    classes = _classes(rows)
    frequencies = _frequencies(found.where("block is not null"))
    first = _prefixes(chosen, frequencies, words, percent).where(F.size("first") > 0)
    known = classes.select("signature", "node", "n", F.col("node").alias("class"))
    prefixes = materialize(first.dropDuplicates(["signature"]).join(known, "signature").drop("signature"), "prefixes")
    shared = prefixes.select(F.explode("first").alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    shared = materialize(shared.where("m > 1").select("block"), "shared-blocks")
    # Narrow rows are shuffled; what is known of a node joins what is left.
    places = prefixes.select("node", F.posexplode("first").alias("place", "block"))
    places = materialize(places.join(shared, "block"), "places")
    entries = materialize(places.join(prefixes.drop("first", "odd"), "node"), "blocks")
    names = classes.select(F.col("signature").alias("digest"), "node", "name")

    def gather(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Full sets of the nodes of pairs(a, b), and those known before."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if known is not None:
            nodes = nodes.join(known.select("node"), "node", "left_anti")
        wanted = materialize(names.join(nodes, "node", "left_semi"), "wanted")
        sets = gather_sets(chosen.select("name", "text"), wanted, words)
        return sets if known is None else known.union(sets)

    def likely(pairs: DataFrame) -> DataFrame:
        return likely_pairs(pairs, prefixes, percent)

    labels, links, sets = _link(entries, gather, likely, percent)
    numbers = _link_numbers(classes, labels, links, sets, percent) if count_links and links is not None else None
    result = _result(rows, classes, labels, numbers)
    return result if count_links else result.drop("n_links")


def _classes(rows: DataFrame) -> DataFrame:
    """signature, n, node, least key: one row for each different set that is not empty.

    The node is the smallest key; where keys are null or repeat over sets, a hash of the set.
    """
    from pyspark.sql.window import Window

    grouped = rows.where("n > 0").groupBy("signature").agg(
        F.first("n").alias("n"), F.first("name").alias("name"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    other = F.xxhash64("signature")
    place = Window.partitionBy(F.coalesce("least", other)).orderBy(F.col("least").isNull(), "signature")
    return materialize(
        grouped.withColumn("place", F.row_number().over(place)).select(
            "signature", "n", "name", "least", "copies", F.when(F.col("least").isNotNull() & (F.col("place") == 1), F.col("least")).otherwise(other).alias("node")
        ),
        "classes",
    )


def _link(entries: DataFrame, gather, likely, percent: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(node, label) of the nodes in links, the links found, and the sets of all nodes that met another, or
    None three times where no block is shared."""
    if entries.isEmpty():
        return None, None, None
    pivots = entries.groupBy("block").agg(F.min(F.struct(F.xxhash64("node").alias("h"), *_FIELDS)).alias("p"))
    met = entries.join(_as_partners(pivots.select("block", "p.*")), "block").where(_may_link(percent))
    one = met.groupBy("node").agg(F.min(F.struct(F.xxhash64("p_node").alias("h"), "p_node")).alias("p"))
    pairs = materialize(one.select(F.col("node").alias("a"), F.col("p.p_node").alias("b")), "pairs")
    pairs = materialize(likely(pairs), "likely-pairs")
    sets = gather(pairs)
    checked = confirmed(pairs, sets, percent)
    links = checked.where("linked").select("a", "b")
    labels = _labels(links)
    left = materialize(_open_blocks(_relabelled(entries, "class", labels)), "blocks")
    if left.isEmpty():
        return labels, links, sets

    sizes = materialize(left.groupBy("block").agg(F.count(F.lit(1)).alias("m")), "block-sizes")
    small = left.join(sizes.where(F.col("m") <= WHOLE).select("block"), "block")
    large = materialize(left.join(sizes.where(F.col("m") > WHOLE).select("block"), "block"), "large-blocks")
    pairs = small.join(_as_partners(small), "block").where(F.col("node") < F.col("p_node")).where(_may_link(percent))
    pairs = materialize(pairs.select(F.col("node").alias("a"), F.col("p_node").alias("b")).distinct(), "pairs")
    if not large.isEmpty():
        # The fewest rarer shingles: the document with the fewest edits of its own.
        centre = large.groupBy("block").agg(F.min(F.struct("place", F.xxhash64("node").alias("h"), "node")).alias("p"))
        groups = large.select(F.col("block").alias("key"), "node")
        centres = popular_centres(groups, centre.select(F.col("block").alias("key"), F.col("p.node").alias("pivot")))
        met = groups.join(centres, "key").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        met = materialize(met.where("a != b").distinct(), "met-centres")
        sets = gather(met, sets)
        differences = differences_from_centre(met, sets, percent)
        links = links.union(differences.where("linked").select("a", "b"))
        pairs = pairs.union(pairs_by_differences(differences, large.select("node", "class").distinct(), percent)).distinct()
    tested = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    pairs = materialize(likely(pairs), "likely-pairs")
    sets = gather(pairs, sets)
    links = links.union(confirmed(pairs, sets, percent).where("linked").select("a", "b"))
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return _labels(links), links, sets


def _labels(links: DataFrame) -> DataFrame:
    """(node, label) of every node of a link, labels themselves included."""
    stars = alternating_stars(links)
    return materialize(stars.union(stars.select(F.col("label").alias("node"), "label").distinct()), "labels")


def _link_numbers(classes: DataFrame, labels: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, n_links of each node with a label: the sets it is linked with, all in its class.

    A class whose pairs have all been found linked, as every class of two, needs no more. The sets
    of the others are dealt into blocks: by size, so that linked
    sets are in the same or in adjoining size classes, and by hash where those are large. Each
    pair of blocks is one group of bounded size, and gives one row for each of its sets.
    """
    named = labels.select(F.col("node").alias("a"), F.col("label").alias("class"))
    found = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(named, "a").groupBy("class").agg(F.count(F.lit(1)).alias("found"))
    known = labels.groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("k")).join(found, "class", "left")
    known = materialize(
        known.select("class", "k", (F.coalesce("found", F.lit(0)) == F.col("k") * (F.col("k") - 1) / 2).alias("complete")), "class-links"
    )
    members = classes.join(labels, "node").withColumnRenamed("label", "class").select("node", "n", "class")
    done = members.join(known.where("complete"), "class").select("node", (F.col("k") - 1).alias("n_links"))
    left = members.join(known.where("not complete"), "class", "left_semi")
    # Sizes of linked sets differ by a factor of 100 / percent at most; a little more, for rounding.
    step = max(1e-3, 1.001 * math.log(100 / percent))
    left = materialize(left.withColumn("size", F.floor(F.log("n") / step).cast("int")), "count-members")
    if left.isEmpty():
        return done
    shares = F.greatest(F.count(F.lit(1)) / COUNT_SETS, F.sum("n") / COUNT_SHINGLES)
    cells = materialize(left.groupBy("class", "size").agg(F.ceil(shares).cast("int").alias("parts")), "count-cells")
    beside = lambda d, name: cells.select("class", (F.col("size") - d).alias("size"), F.col("parts").alias(name))
    dealt = (
        left.join(cells, ["class", "size"])
        .join(beside(1, "above"), ["class", "size"], "left")
        .join(beside(-1, "below"), ["class", "size"], "left")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    )
    # Blocks (low, p) and (high, q); side 0 is the first, 1 the second, 2 both.
    meets = F.expr(
        "concat(transform(sequence(0, parts - 1), x -> struct(size as low, least(x, part) as p, size as high, greatest(x, part) as q,"
        " case when x = part then 2 when part < x then 0 else 1 end as side)),"
        " coalesce(transform(sequence(0, above - 1), x -> struct(size as low, part as p, size + 1 as high, x as q, 0 as side)), array()),"
        " coalesce(transform(sequence(0, below - 1), x -> struct(size - 1 as low, x as p, size as high, part as q, 1 as side)), array()))"
    )
    dealt = dealt.select("node", "n", "class", F.explode(meets).alias("m")).select("node", "n", "class", "m.*")

    def count(table: pa.Table) -> pa.Table:
        side, n = table.column("side").to_numpy(), table.column("n").to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
        first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        total = np.zeros(len(side), np.int64)
        if len(first) and len(second):
            both = overlaps([sets[i] for i in first], [sets[i] for i in second])
            linked = 100 * both >= percent * (n[first][:, None] + n[second][None, :] - both)
            linked &= first[:, None] != second[None, :]
            total[first] += linked.sum(1)
            total[second[side[second] == 1]] += linked.sum(0)[side[second] == 1]
        return pa.table({"node": table.column("node").combine_chunks(), "n_links": pa.array(total, pa.int64())})

    counted = (
        dealt.join(sets, "node")
        .groupBy("class", "low", "p", "high", "q")
        .applyInArrow(count, "node long, n_links long")
        .groupBy("node")
        .agg(F.sum("n_links").alias("n_links"))
    )
    return done.union(materialize(counted, "link-numbers"))


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared entries of each set of a with each of b: a product of two set-by-entry matrices, some columns at a time."""
    columns = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.int64)

    def entries(sets):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(columns, flat), max(0, len(columns) - 1))
        there = columns[at] == flat if len(columns) else np.zeros(len(flat), bool)
        order = np.argsort(at[there], kind="stable")
        return at[there][order], row[there][order]

    (ca, ra), (cb, rb) = entries(a), entries(b)
    for start in range(0, len(columns), COUNT_COLUMNS):
        width = min(COUNT_COLUMNS, len(columns) - start)
        matrices = []
        for column, row, many in ((ca, ra, len(a)), (cb, rb, len(b))):
            i, j = np.searchsorted(column, [start, start + width])
            matrices.append(np.zeros((many, width), np.float32))
            matrices[-1][row[i:j], column[i:j] - start] = 1
        out += (matrices[0] @ matrices[1].T).astype(np.int64)
    return out


def _result(rows, classes, labels, numbers) -> DataFrame:
    nodes = classes
    if labels is not None:
        nodes = _relabelled(classes.withColumn("class", F.col("node")), "class", labels)
    else:
        nodes = nodes.withColumn("class", F.col("node"))
    if numbers is not None:
        numbers = numbers.select(F.col("node").alias("_a"), "n_links")
        nodes = nodes.join(numbers, F.col("node") == F.col("_a"), "left").drop("_a")
    else:
        nodes = nodes.withColumn("n_links", F.lit(None).cast("long"))
    totals = nodes.groupBy("class").agg(F.min("least").alias("component_id"), F.sum("copies").alias("class_size"))
    known = nodes.join(totals, "class").select(
        F.col("signature").alias("_signature"), "component_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    empty = F.col("n") == 0
    return rows.join(known, F.col("signature") == F.col("_signature"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )
