"""Which columns tell rows apart: unique counts of all column subsets, and the minimal keys among them."""

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvekit.session import materialize

#: Columns of a lattice: twelve have 4,095 subsets, up to 924 of them counted in one pass.
MOST_COLUMNS = 12
#: Cells that grouping sets count at once, and about the cells of a part that one row holds in codes.
FEW_CELLS, PART_CELLS = 100_000, 100_000

RESULT = (
    "columns string, n_columns int, n_unique bigint, n_surplus bigint, is_key boolean, is_minimal boolean, matches boolean"
)


def key_lattice(rows: DataFrame, columns: Sequence[str], unique: int | None = None) -> DataFrame:
    """One row for every subset of `columns`, named by its columns joined by `+` in the given order.

    n_unique is the number of different rows of the subset (nulls are values) and n_surplus what all rows
    have beyond that. is_key: the subset tells apart whatever all the columns tell apart; is_minimal: and no
    part of it does. `matches` marks the subsets with `unique` different rows, to find the key behind a published count.

    The rows are read once and reduced to their different values. Then the lattice is walked upwards, a pass for
    each size of subsets at most; what holds a key is one and is not counted again.

    Of many values, those of the column with the most different ones are dealt into parts, once. Rows that differ in
    it are different, so a subset that holds it is counted part by part and the numbers are added. Subsets
    without it are counted on what is left when it is dropped, in the same way.
    """
    columns = list(columns)
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"{len(columns)} columns have too many subsets; at most {MOST_COLUMNS}")
    spark = rows.sparkSession
    cells = materialize(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")), "key-cells")
    n_rows, n_cells = cells.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    levels = _levels(cells.drop("_n"), columns, n_cells)
    counts: dict[tuple, int] = {}
    minimal: list[set] = []
    for size in range(1, len(columns) + 1):
        subsets = list(combinations(columns, size))
        implied = [s for s in subsets if any(key <= set(s) for key in minimal)]
        counts |= dict.fromkeys(implied, n_cells)
        asked = [s for s in subsets if s not in counts]
        if size == len(columns):
            counts |= dict.fromkeys(asked, n_cells)
        elif asked:
            counts |= _counted(levels, columns, asked)
        minimal += [set(s) for s in asked if counts[s] == n_cells]
    found = [
        ("+".join(s), len(s), n, n_rows - n, n == n_cells, set(s) in minimal, None if unique is None else n == unique)
        for s, n in counts.items()
    ]
    return spark.createDataFrame(found, RESULT)


@dataclass
class _Level:
    """Different values of some columns; `parts` holds those dealt by the anchor, `rest` those that are not, as cells."""

    columns: list[str]
    rest: DataFrame | None
    anchor: str | None = None
    parts: DataFrame | None = None


def _levels(cells: DataFrame, columns: list[str], n_cells: int) -> list[_Level]:
    """A level for each anchor: the next has the cells without it. The last is counted by grouping sets."""
    levels, left = [], list(columns)
    while n_cells > FEW_CELLS and len(left) > 1 and all(_has_codes(cells.schema[c].dataType) for c in left):
        # An estimate names the anchor only: any column gives the same counts.
        several = cells.agg(*[F.approx_count_distinct(c).alias(c) for c in left]).first()
        anchor = max(left, key=lambda c: several[c])
        level = _dealt(cells, left, anchor, n_cells)
        if level is None:
            break
        levels.append(level)
        left = [c for c in left if c != anchor]
        cells = materialize(cells.select(*left).distinct(), "key-cells")
        n_cells = cells.count()
    return [*levels, _Level(left, cells)]


def _has_codes(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.UserDefinedType, T.CalendarIntervalType))


def _dealt(cells: DataFrame, columns: list[str], anchor: str, n_cells: int) -> _Level | None:
    """The cells in parts by their anchor, a row of codes for each part. An anchor of more than a part's cells stays outside;
    None where all are such."""
    large = cells.groupBy(anchor).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > PART_CELLS)
    large = materialize(large.select(F.col(anchor).alias("_large")), "large-anchors")
    same = F.col(anchor).eqNullSafe(F.col("_large"))
    rest = None
    if not large.isEmpty():
        rest = materialize(cells.join(large, same, "left_semi"), "large-cells")
        cells = cells.join(large, same, "left_anti")
        if rest.count() == n_cells:
            return None
    parts = max(1, math.ceil(n_cells / PART_CELLS))

    def codes(table: pa.Table) -> pa.Table:
        packed = [
            table.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            for c in columns
        ]
        return pa.table({"codes": pa.array([packed], pa.list_(pa.binary()))})

    part = F.pmod(F.xxhash64(anchor), F.lit(parts)).cast("int").alias("_part")
    # Every part is one row, whatever its bytes: the number of tasks is not left to AQE.
    packed = cells.repartition(min(parts, 10_000), part).groupBy(part).applyInArrow(codes, "codes array<binary>")
    return _Level(columns, rest, anchor, materialize(packed, "key-codes"))


def _counted(levels: list[_Level], columns: list[str], subsets: list[tuple]) -> dict[tuple, int]:
    """Numbers of different rows of the subsets: each on the first level whose anchor it holds, the others on the last one."""
    counts, left = {}, list(subsets)
    for level in levels:
        mine = [s for s in left if level.anchor is None or level.anchor in s]
        left = [s for s in left if s not in mine]
        if not mine:
            continue
        found = dict.fromkeys(mine, 0)
        if level.parts is not None:
            for s, n in _counted_in_parts(level, mine).items():
                found[s] += n
        if level.rest is not None:
            for s, n in _counted_in_cells(level.rest, level.columns, mine).items():
                found[s] += n
        counts |= found
    return counts


def _counted_in_parts(level: _Level, subsets: list[tuple]) -> dict[tuple, int]:
    """Added over the parts: no two of them share a value of the anchor."""
    places = [[level.columns.index(c) for c in s] for s in subsets]

    def run(batches):
        total = np.zeros(len(places), np.int64)
        for batch in batches:
            for packed in batch.column("codes"):
                codes = [np.frombuffer(x.as_py(), "<i4").astype(np.int64) for x in packed]
                known = {(): (np.zeros(len(codes[0]), np.int64), 1)}
                for i, place in enumerate(places):
                    total[i] += _numbered(tuple(place), codes, known)[1]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n"])

    sums = level.parts.mapInArrow(run, "n array<bigint>").select(F.posexplode("n").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    numbers = {r["i"]: r["n"] for r in sums.collect()}
    return {s: numbers.get(i, 0) for i, s in enumerate(subsets)}


def _numbered(place: tuple, codes: list[np.ndarray], known: dict) -> tuple[np.ndarray, int]:
    """Numbers of the rows of some columns, equal where the rows are, and how many there are."""
    if place not in known:
        before, _ = _numbered(place[:-1], codes, known)
        own = codes[place[-1]]
        values, numbers = np.unique(before * (int(own.max(initial=0)) + 1) + own, return_inverse=True)
        known[place] = numbers, len(values)
    return known[place]


def _counted_in_cells(cells: DataFrame, columns: list[str], subsets: list[tuple]) -> dict[tuple, int]:
    """From one pass of grouping sets."""
    used = [c for c in columns if any(c in s for s in subsets)]
    groups = cells.groupingSets([[F.col(c) for c in s] for s in subsets], *used).agg(F.grouping_id().alias("_set"))
    numbers = {r["_set"]: r["n"] for r in groups.groupBy("_set").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = {c: len(used) - 1 - i for i, c in enumerate(used)}
    return {s: numbers.get(sum(1 << place[c] for c in used if c not in s), 0) for s in subsets}
