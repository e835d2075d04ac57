"""Exact duplicates, shards and mixing against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from curvekit.llm import content_sort, cube, rendezvous

from .conftest import AWKWARD


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def expected_groups(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[norm(text)].append(key)
    out = []
    for text, keys in groups.items():
        least = min((k for k in keys if k is not None), default=None)
        sha, first = hashlib.sha256(text.encode()).hexdigest(), True
        for k in keys:
            out.append((k, least, len(keys), k == least and first, sha))
            first = first and k != least
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_equal_texts(spark, awkward, partitions):
    more = [(100 + i, "one large group of copies" if i % 3 else f"text {i}") for i in range(400)]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = content_sort.group_equal_texts(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got), key=repr) == expected_groups([r[:2] for r in AWKWARD] + more)


def test_empty_tables(nothing):
    assert content_sort.group_equal_texts(nothing).collect() == []
    assert rendezvous.assign_shards(nothing, [1.0]).collect() == []
    assert cube.mix(nothing).collect() == []


def test_shards(awkward):
    rows = rendezvous.assign_shards(awkward, [1.0] * 8).collect()
    want = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in AWKWARD)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "key" and (r["grown_shard"] == r["shard"] or r["grown_shard"] == 8)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_key = defaultdict(set)
    for r in rows:
        by_key[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(s) == 1 for s in by_key.values())


def test_weights_and_growth(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    weights = [1.0, 2.0, 5.0]
    got = keys.select(
        rendezvous.shard_of(keys["k"], weights).alias("a"), rendezvous.shard_of(keys["k"], [*weights, 2.0]).alias("b")
    ).collect()
    share = Counter(r["a"] for r in got)
    assert all(abs(share[i] / 20_000 - w / 8) < 0.02 for i, w in enumerate(weights))
    moved = [r for r in got if r["a"] != r["b"]]
    assert {r["b"] for r in moved} == {3} and abs(len(moved) / 20_000 - 0.2) < 0.02


def test_slots_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(rendezvous, "ROWS_PER_BUCKET", 10)
    docs = spark.range(500).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', string(id)) as text")
    slots = defaultdict(list)
    for r in rendezvous.assign_shards(docs, [1.0] * 3).collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def expected_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in free}
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= above
    return out


def test_mix(spark, awkward):
    more = [(1000 + i, "w " * (1 + i % 37), None, f"src{i % 5 if i % 2 else 0}") for i in range(3000)]
    docs = awkward.select("doc_id", "text", "lang", "source").union(
        spark.createDataFrame(more, "doc_id long, text string, lang string, source string")
    )
    first = cube.mix(docs, seed=1)
    rows = first.collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    every = AWKWARD + more
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((k, size(t)) for k, t, *_ in every)
    total = Counter()
    for _, t, _, s in every:
        total[s] += size(t)
    goals = expected_targets(total)
    by_size = {v: s for s, v in total.items()}
    taken = Counter()
    for r in rows:
        source = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(goals[source])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source] += r["taken"]
    for s in total:
        largest = max(size(t) for _, t, _, x in every if x == s)
        assert abs(taken[s] - goals[s]) <= largest
    assert abs(taken["src0"] - goals["src0"]) < 0.01 * goals["src0"]
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, cube.mix(docs.repartition(5), seed=1).collect()), key=repr)


def test_flight_keeps_totals_and_expectations():
    draws = np.random.default_rng(1)
    x = np.column_stack([draws.integers(1, 500, 300), np.ones(300)]).astype(float)
    hits = np.zeros(300)
    for seed in range(200):
        p = cube.flight(np.full(300, 0.37), x, np.random.default_rng(seed))
        assert np.allclose(x.T @ p, x.sum(axis=0) * 0.37)
        assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 2
        hits += p
    assert abs(hits.mean() / 200 - 0.37) < 0.001 and abs(hits / 200 - 0.37).max() < 0.16


def test_blocks_of_a_large_source(spark, monkeypatch):
    monkeypatch.setattr(cube, "BLOCK_UNITS", 50)
    units = spark.range(2000).selectExpr("'s' as stratum", "id as unit", "1 + id % 40 as words", "1L as rows", "0.3D as p")
    got = cube.draw_balanced(units).collect()
    assert len(got) == 2000 and {r["p"] for r in got} == {0.0, 1.0}
    assert abs(sum(r["words"] for r in got if r["p"]) - 0.3 * sum(r["words"] for r in got)) <= 40
    assert abs(sum(r["p"] for r in got) - 600) <= 3
