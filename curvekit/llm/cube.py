"""Mixing sources to target weights: balanced sampling by the cube method."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvekit.llm.common import words_column
from curvekit.session import materialize

BLOCK_UNITS = 4096
_ALMOST = 1e-9


def targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Per source of sizes(source, source_size): the words to take.

    The sources in code-point order, null last, have the repeating weights. They share
    `share` of all words by weight; a source stops at `most` times its own words and the
    excess goes to the others by weight, until none is above. Each round is one aggregation
    over the sources; at least one more source stops in a round, and few rounds are needed.
    """
    placed = materialize(_ranked(sizes).withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"),
        ),
    ).withColumn("limit", F.lit(float(most)) * F.col("source_size")), "sources")
    everything = placed.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    level, stopped = 0.0, -1
    while True:
        free = F.col("weight") * F.lit(level) <= F.col("limit") if stopped >= 0 else F.lit(True)
        x = placed.agg(
            F.sum(F.when(free, F.col("weight"))).alias("w"),
            F.sum(F.when(~free, F.col("limit"))).alias("used"),
            F.count_if(~free).alias("n"),
        ).first()
        if x["n"] == stopped or not x["w"]:
            break
        stopped, level = x["n"], (share * everything - (x["used"] or 0.0)) / x["w"]
    return placed.select(
        "source", "source_size", "units", F.least("limit", F.col("weight") * F.lit(level)).alias("target")
    )


def _ranked(sizes: DataFrame) -> DataFrame:
    """Add `rank`, the place of each source in code-point order from 0, null last.

    The sources are cut into ranges by their first bytes, so that no task orders all of them.
    """
    cut = sizes.withColumn("_head", F.coalesce(F.hex(F.substring(F.encode("source", "UTF-8"), 1, 3)), F.lit("~")))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_head").count().select(
        "_head", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_head").orderBy("source")
    return (
        cut.withColumn("_row", F.row_number().over(inside) - 1)
        .join(starts, "_head")
        .withColumn("rank", F.col("_start") + F.col("_row"))
        .drop("_head", "_start", "_row")
    )


def flight(p: np.ndarray, x: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Cube flight: move p inside the null space of the balancing columns x until stuck.

    p: inclusion probabilities; x: one row of balancing values per unit. Each step takes as
    many open units as there are columns plus one, and moves them along a null vector of
    their values to a face of the cube, in one of the two directions at random such that
    expectations stay. At most as many units as columns keep a fraction.
    """
    p, k = p.astype(float).tolist(), x.shape[1]
    rows = x.astype(float).tolist()
    waiting, held = iter(range(len(p))), []
    toss = iter(draws.random(2 * len(p) + 8).tolist())
    while True:
        while len(held) < k + 1:
            unit = next(waiting, None)
            if unit is None:
                return np.array(p)
            if _ALMOST < p[unit] < 1 - _ALMOST:
                held.append(unit)
            else:
                p[unit] = float(round(p[unit]))
        v = _null_vector([rows[u] for u in held], k)
        up = min((1 - p[u]) / d if d > 0 else -p[u] / d for u, d in zip(held, v) if d)
        down = min(p[u] / d if d > 0 else (p[u] - 1) / d for u, d in zip(held, v) if d)
        step = up if next(toss) * (up + down) < down else -down
        still = []
        for u, d in zip(held, v):
            p[u] += step * d
            if _ALMOST < p[u] < 1 - _ALMOST:
                still.append(u)
            else:
                p[u] = float(round(p[u]))
        held = still


def _null_vector(rows: list[list[float]], k: int) -> list[float]:
    """A vector v, not zero, with sum(v[i] * rows[i]) = 0 for k + 1 rows of k values."""
    if k == 1:
        (a,), (b,) = rows
        return [b, -a] if a or b else [1.0, -1.0]
    if k == 2:
        (a, d), (b, e), (c, f) = rows
        v = [b * f - c * e, c * d - a * f, a * e - b * d]
        if max(map(abs, v)) > 1e-12:
            return v
        if a != b or d != e:  # the rows lie on one line: two of them are enough
            return [b, -a, 0.0] if (a or b) else [e, -d, 0.0]
        return [1.0, -1.0, 0.0]
    *_, v = np.linalg.svd(np.array(rows).T)
    return v[-1].tolist()


def landing(p: np.ndarray, x: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Decide the few units that a flight leaves: give up the last balancing column, and so on."""
    p = p.copy()
    for columns in range(x.shape[1] - 1, 0, -1):
        open_ = np.flatnonzero((p > _ALMOST) & (p < 1 - _ALMOST))
        p[open_] = flight(p[open_], x[open_, :columns], draws)
    open_ = (p > _ALMOST) & (p < 1 - _ALMOST)
    p[open_] = draws.random(int(open_.sum())) < p[open_]
    return np.round(p)


def _fly_block(last: bool, seed: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop(columns="_block").sort_values(["words", "unit"], ascending=[False, True], kind="stable")
        x = block[["words", "rows"]].to_numpy(float)
        x /= np.maximum(x.max(axis=0), 1.0)
        draws = np.random.default_rng([seed, int(block["unit"].iloc[0]) & 0xFFFFFFFF, len(block)])
        p = flight(block["p"].to_numpy(), x, draws)
        return block.assign(p=landing(p, x, draws) if last else p)

    return run


def draw_balanced(units: DataFrame, seed: int = 7) -> DataFrame:
    """Decide each of units(stratum, unit, words, rows, p); p becomes 0 or 1.

    Every stratum keeps its totals of words and rows. Units are dealt by hash into blocks of
    about BLOCK_UNITS that fly on their own; a block leaves at most two units open. Open units
    of all blocks are dealt again, round after round, until one block per stratum remains,
    which also lands. Decisions depend on the units and the seed only.
    """
    decided, open_ = [], units
    while True:
        counts = open_.groupBy("stratum").count()
        most = counts.agg(F.max("count")).first()[0] or 0
        last = most <= BLOCK_UNITS
        dealt = open_.withColumn("_block", F.lit(0))
        if not last:
            n = counts.select(
                F.col("stratum").alias("_stratum"),
                F.ceil(F.col("count") / BLOCK_UNITS).alias("_blocks"),
            )
            dealt = open_.join(n, F.col("stratum").eqNullSafe(F.col("_stratum"))).withColumn(
                "_block", F.pmod(F.xxhash64("unit", F.lit(len(decided))), "_blocks")
            ).drop("_stratum", "_blocks")
        flown = materialize(
            dealt.groupBy("stratum", "_block").applyInPandas(_fly_block(last, seed), units.schema),
            "cube-flight",
        )
        if last:
            break
        decided.append(flown.where("p in (0, 1)"))
        open_ = flown.where("p not in (0, 1)")
    for more in decided:
        flown = flown.unionByName(more)
    return flown


def row_key(columns: Sequence[str]) -> Column:
    """Hash of whole rows: rows equal in all columns are one unit that is taken as often as it repeats.

    Nulls count by their place, which the hash function alone would pass over.
    """
    return F.xxhash64(*[part for c in columns for part in (F.col(c).isNull(), F.col(c))])


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 7,
) -> DataFrame:
    """Per row of `docs`: doc_id, size, source_size, target, taken, copies, source and `unit`, its hash.

    A row is taken target / source_size times on average: the whole part for sure, the rest
    by balanced drawing, so no row is taken more than `most` times, rounded up. Null texts have size 0; null is
    a source of its own, last in order. Rows equal in key, text and source are drawn together.
    A source without words takes nothing. An empty table gives no rows. Other columns are not read.
    """
    sized = materialize(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).alias("source"),
            words_column(F.col(text)).alias("size"),
            row_key([key, text, source]).alias("unit"),
        ),
        "sized",
    )
    goals = materialize(
        targets(
            sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("units")),
            weights,
            share,
            most,
        ),
        "targets",
    ).select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )
    known = sized.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    part = F.col("rate") - F.floor("rate")
    drawn = draw_balanced(
        known.where(part > 0)
        .groupBy(F.col("source").alias("stratum"), "unit")
        .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.first(part).alias("p")),
        seed,
    ).where("p = 1").select("stratum", F.col("unit").alias("_unit"), F.lit(1).alias("extra"))
    copies = (F.floor("rate") + F.coalesce("extra", F.lit(0))).cast("long")
    # A unit belongs to its source: two sources may have units of the same hash.
    same = (F.col("unit") == F.col("_unit")) & F.col("source").eqNullSafe(F.col("stratum"))
    return known.join(drawn, same, "left").withColumn("copies", copies).select(
        "doc_id",
        "size",
        "source_size",
        F.col("target"),
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
        "source",
        "unit",
    )
