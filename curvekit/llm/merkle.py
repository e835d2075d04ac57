"""A Merkle manifest of a table: a content-addressed graph, proofs by descent from its root.

Rows are leaves, ordered within their source; a node is the hash of up to three children. The leaves of a source
make a tree, and the roots of the sources make the tree above them.

Nodes are stored by content: a record maps the digest of a node to its children and to theirs, down through
SEGMENT levels, so a whole segment of a path is found by one join. Requests are the blocks of leaves
under one lowest record. All start at the root; in each round a request looks up the record of the digest that it
has reached, follows the digits of its rank, and collects the children not selected. In the lowest record
it splits into its leaves, whose segments are then reversed to lead from leaf to root.
"""

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvekit.session import materialize

# Children of a node, and the columns of a leaf in their order.
FAN = 3
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a record: FAN ** SEGMENT leaves (23 KB of digests, 35 KB with those above) are the most that one row holds.
SEGMENT = 6


def leaf_digest(columns: Sequence[Column]) -> Column:
    """sha256 of the values in order, each as its UTF-8 byte count, a colon and itself, or - if null; 32 bytes."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _above(nodes: list[str]) -> list[str]:
    return [_hash("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]


def _ranked(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Rows with rank: their place from 0 on within their `tree`, in the given order.

    Rows are dealt into ranges of (tree, order) and sorted there, so one large tree spreads over
    many tasks. A range's place in its tree comes from one row per range and tree.
    """
    order = ["tree", *order]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), f"{label}-ranges")
    part, place = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    ahead = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = materialize(
        dealt.groupBy("tree", part)
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        .select(
            F.col("tree").alias("_tree"),
            F.col("_part").alias("_of"),
            (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("shift"),
        ),
        f"{label}-shifts",
    )
    same = (F.col("tree") == F.col("_tree")) & (F.shiftright("_at", 33) == F.col("_of"))
    return dealt.join(ranges, same).withColumn("rank", place + F.col("shift")).drop("_at", "_tree", "_of", "shift")


def _segments(nodes: DataFrame, sizes: DataFrame, width: int, carried: Sequence[str], segment: int) -> DataFrame:
    """Blocks of `width` neighbours: (tree, block, last, digest, levels, carried).

    `digest` is that of the node above a block and `levels` its record: the nodes of every level below it, lowest
    first. A block that is a whole tree (`last`) ends where one node remains; others go up all levels.
    """
    fields = ["rank", "digest", *carried]
    blocks = (
        nodes.groupBy("tree", F.floor(F.col("rank") / width).cast("long").alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("x"))
        .join(sizes.select("tree", (F.col("n") <= width).alias("last")), "tree")
        .select("tree", "block", "last", F.col("x.digest").alias("nodes"), *[F.col(f"x.{c}").alias(c) for c in carried])
    )
    kinds = dict(blocks.dtypes)
    arrow = pa.list_(pa.list_(pa.binary()))

    def run(batches):
        for batch in batches:
            tops, records = [], []
            for whole, raw in zip(batch.column("last").to_pylist(), batch.column("nodes")):
                level, below = [x.hex() for x in raw.as_py()], []
                while len(level) > 1 if whole else len(below) < segment:
                    below.append([bytes.fromhex(x) for x in level])
                    level = _above(level)
                tops.append(bytes.fromhex(level[0]))
                records.append(below)
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), batch.column("block"), batch.column("last"), pa.array(tops, pa.binary()),
                 pa.array(records, arrow), *[batch.column(c) for c in carried]],
                names=["tree", "block", "last", "digest", "levels", *carried],
            )

    schema = "tree string, block long, last boolean, digest binary, levels array<array<binary>>"
    return blocks.mapInArrow(run, ", ".join([schema, *[f"{c} {kinds[c]}" for c in carried]]))


def _build(leaves: DataFrame, segment: int, carried: Sequence[str], label: str):
    """(requests, records, roots) of the trees over ranked leaves (tree, rank, digest, carried).

    Requests are the lowest blocks with their numbers; records have a row for each different segment; roots have
    the digest, size and number of segments (`rounds`) of each tree. Every round shrinks the nodes FAN ** segment fold.
    """
    width, carried = FAN**segment, list(carried)
    sizes = materialize(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), f"{label}-sizes")
    nodes, requests, records, roots, rounds = leaves, None, None, None, 0
    while True:
        keep = carried if requests is None else []
        blocks = materialize(_segments(nodes, sizes, width, keep, segment), f"{label}-segments")
        rounds += 1
        if requests is None:
            requests = blocks.select("tree", "block", *carried)
        found = blocks.where(F.size("levels") > 0).select("digest", "levels")
        done = blocks.where("last").select("tree", "digest", F.lit(rounds).alias("rounds"))
        records = found if records is None else records.union(found)
        roots = done if roots is None else roots.union(done)
        nodes = blocks.where("not last").select("tree", F.col("block").alias("rank"), "digest")
        if nodes.isEmpty():
            return requests, records.dropDuplicates(["digest"]), materialize(roots, f"{label}-roots")
        sizes = materialize(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), f"{label}-sizes")


def _steps(levels: list[list[bytes]], at: int) -> list[tuple[str, str]]:
    """Children not selected, left and right of the path, on the way down a record to its lowest node `at`."""
    down = []
    for depth in range(len(levels) - 1, -1, -1):
        node = at // FAN**depth
        run = node - node % FAN
        level = levels[depth]
        down.append((b"".join(level[run:node]).hex(), b"".join(level[node + 1 : run + FAN]).hex()))
    return down


_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _named(path):
    return [{"left": a, "right": b} for a, b in path]


def folded(digest: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf's digest leads to along a path of siblings left and right of it, as hex."""
    for left, right in path:
        digest = _hash(left + digest + right)
    return digest


def _descend(requests: DataFrame, records: DataFrame, width: int, label: str) -> DataFrame:
    """Lead requests (reached, left_rounds, number, path) down to the record with no round below it.

    A request's `number` is its rank among the nodes of the level it wants; its digits in base `width` say which
    node of each segment is on its way. A request that reaches the wanted level waits for the others.
    """
    columns = requests.columns
    kinds = dict(requests.dtypes)

    def run(batches):
        for batch in batches:
            reached, paths, rounds = [], [], []
            for number, left, path, levels in zip(*(batch.column(c) for c in ("number", "left_rounds", "path", "levels"))):
                levels, left = levels.as_py(), left.as_py()
                at = number.as_py() // width ** (left - 1) % width
                reached.append(levels[0][at])
                paths.append(path.as_py() + _named(_steps(levels, at)))
                rounds.append(left - 1)
            new = {"reached": pa.array(reached, pa.binary()), "path": pa.array(paths, _PATH), "left_rounds": pa.array(rounds, pa.int32())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in columns], names=columns)

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    known = records.select(F.col("digest").alias("_digest"), "levels")
    there = requests.where("left_rounds <= 0")
    under_way = requests.where("left_rounds > 0")
    while not under_way.isEmpty():
        moved = under_way.join(known, F.col("reached") == F.col("_digest")).drop("_digest")
        moved = materialize(moved.select(*columns, "levels").mapInArrow(run, schema), f"{label}-requests")
        there = there.union(moved.where("left_rounds <= 0"))
        under_way = moved.where("left_rounds > 0")
    return there


def manifest(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "source",
    columns: Sequence[str] = LEAF_COLUMNS,
    found: dict[str, Column] | None = None,
    suspect: Column | None = None,
    segment: int = SEGMENT,
    paths: bool = True,
) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, path, proof_sha256, folded_root and verified.

    Leaves ascend by key within a group (ties by digest, null keys first); groups ascend by their UTF-8
    bytes, null first. `path` leads from leaf to root: in each level the siblings left and right of the node, as hex;
    `proof_sha256` is the digest of them all. `folded_root` is the root that the row as found folds to:
    `found` has expressions for columns whose found value may differ from the recorded one, read where
    `suspect` holds; without them a row is found as recorded. Rows that are equal in all columns are leaves of
    their own. A table with one row has it as leaf, subroot and root. An empty table gives no rows. Other
    columns are not read. With `paths` False the paths are used but not returned.
    """
    width = FAN**segment
    as_recorded = [F.col(c) for c in columns]
    as_found = [(found or {}).get(c, F.col(c)) for c in columns]
    changed = F.coalesce(suspect, F.lit(False)) if suspect is not None and found else F.lit(False)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(key).cast("long").alias("doc_id"),
        leaf_digest(as_recorded).alias("digest"),
        F.when(changed, leaf_digest(as_found)).alias("found"),
    )
    leaves = _ranked(rows, ["doc_id", "digest"], "leaves")
    carried = ["doc_id", "found"]
    requests, records, subroots = _build(leaves, segment, carried, "leaves")

    tops = _ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest", "rounds"), ["of"], "sources")
    top_requests, top_records, roots = _build(tops, segment, ["of", "rounds"], "sources")
    root = roots.select("tree", F.col("digest").alias("root"), F.col("rounds").alias("top_rounds"))

    # From the root to the roots of the sources, a request for each lowest block of them.
    empty = F.array().cast("array<struct<left:string,right:string>>")
    asked = top_requests.join(root, "tree").select(
        F.col("block").alias("number"), F.col("root").alias("reached"), (F.col("top_rounds") - 1).alias("left_rounds"),
        empty.alias("path"), "root", "of", "rounds",
    )
    reached = _descend(asked, top_records, width, "sources")
    sources = materialize(_split_sources(reached, top_records), "source-paths")

    # From there to the lowest records, a request for each block of leaves.
    blocks = requests.join(sources, "tree").select(
        F.col("block").alias("number"), F.col("subroot").alias("reached"), (F.col("rounds") - 1).alias("left_rounds"),
        "path", "root", "subroot", *carried,
    )
    reached = _descend(blocks, records, width, "leaves")
    return _split_leaves(reached, records, paths)


def _with_record(requests: DataFrame, records: DataFrame) -> DataFrame:
    known = records.select(F.col("digest").alias("_digest"), "levels")
    return requests.join(known, F.col("reached") == F.col("_digest"), "left").drop("_digest")


def _split_sources(requests: DataFrame, records: DataFrame) -> DataFrame:
    """tree, rounds, subroot, root and the path down to the subroot of each source."""

    def run(batches):
        for batch in batches:
            out = {"tree": [], "rounds": [], "subroot": [], "root": [], "path": []}
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                levels = row["levels"] or []
                for at, tree in enumerate(row["of"]):
                    out["tree"].append(tree)
                    out["rounds"].append(row["rounds"][at])
                    out["subroot"].append(levels[0][at] if levels else row["reached"])
                    out["root"].append(row["root"])
                    out["path"].append(row["path"] + _named(_steps(levels, at)))
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), _PATH)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return _with_record(requests, records).mapInArrow(
        run, "tree string, rounds int, subroot binary, root binary, path array<struct<left:string,right:string>>"
    )


#: Leaves that go out in one batch, each with its whole path.
BATCH_LEAVES = 512


def _split_leaves(requests: DataFrame, records: DataFrame, paths: bool) -> DataFrame:
    """The rows of manifest(): each leaf of a block with its path, reversed, folded from the leaf as found."""
    kinds = {"doc_id": pa.int64(), "leaf": pa.string(), "subroot": pa.string(), "root": pa.string(), "path": _PATH,
             "proof_sha256": pa.string(), "folded_root": pa.string(), "verified": pa.bool_()}
    if not paths:
        del kinds["path"]

    def leaves(row):
        levels, root, subroot = row["levels"] or [], row["root"].hex(), row["subroot"].hex()
        nodes = levels[0] if levels else [row["reached"]]
        above = [(s["left"], s["right"]) for s in reversed(row["path"])]
        for at, node in enumerate(nodes):
            path, leaf = _steps(levels, at)[::-1] + above, node.hex()
            found = row["found"][at]
            end = folded(leaf if found is None else found.hex(), path)
            out = {"doc_id": row["doc_id"][at], "leaf": leaf, "subroot": subroot, "root": root, "folded_root": end,
                   "verified": end == root, "proof_sha256": _hash("".join([a + b for a, b in path]))}
            yield out | {"path": _named(path)} if paths else out

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(leaves(batch.slice(i, 1).to_pylist()[0]))
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))

    path = "path array<struct<left:string,right:string>>, " if paths else ""
    return _with_record(requests, records).mapInArrow(
        run,
        f"doc_id long, leaf string, subroot string, root string, {path}proof_sha256 string, folded_root string, verified boolean",
    )
