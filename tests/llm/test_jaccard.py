"""Shingle sets, links and components against brute force."""

import random

import numpy as np
import pytest

from curvekit.llm import jaccard


def sets_by_words(text, words=3):
    found = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).translate(
        {9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def components(rows):
    """{row number: smallest doc_id of its component}, by comparing all pairs."""
    sets = [sets_by_words(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return [least.get(top(i)) for i in range(len(rows))]


def some_texts(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 6)))
    shared = " ".join(word() for _ in range(60))
    rows, key = [], 0
    for group in range(12):
        base = [word() for _ in range(draw.choice([1, 2, 3, 12, 40, 150]))]
        for _ in range(draw.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 2])):
                copy[draw.randrange(len(copy))] = word()
            rows.append((key, " ".join(copy) + (" " + shared if group % 4 == 0 else "")))
            key += 1
    # A chain: neighbours are similar, ends are not.
    chain = [word() for _ in range(200)]
    for step in range(10):
        chain = list(chain)
        chain[step * 7] = f"new{step}"
        rows.append((key, "\n".join(chain)))
        key += 1
    return rows


EDGES = [(9001, None), (9002, ""), (9003, " \t"), (9004, "One two"), (9005, "one\x0bTWO"), (9006, "one"), (9007, "a\x1cb c d"),
         (9008, "É é a b"), (9009, "é É a b"), (None, "one two"), (9010, "x y z"), (9010, "x y z"), (9010, "other text here")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = some_texts(seed) + EDGES
    frame = spark.createDataFrame([(a, b, 0, "x") for a, b in rows], "doc_id long, text string, n int, class string")
    got = jaccard.similar_documents(frame).collect()
    want = sorted(zip([r[0] for r in rows], map(len, map(sets_by_words, [r[1] for r in rows])), components(rows)), key=repr)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want


@pytest.mark.parametrize("block", [512, 7])
def test_link_numbers_equal_brute_force(spark, monkeypatch, block):
    """Groups of near copies, a chain and copies, in one block and in many."""
    monkeypatch.setattr(jaccard, "COUNT_SETS", block)
    draw = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = some_texts(3) + EDGES
    for key in range(70):
        copy = list(base) + [f"more{i}" for i in range(key % 14)]
        copy[draw.randrange(120)] = f"new{key % 60}"
        rows.append((20000 + key, " ".join(copy)))
    got = {}
    for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault((r["doc_id"], r["n_shingles"]), set()).add(r["n_links"])
    sets = [sets_by_words(t) for _, t in rows]
    different = {s for s in sets if s}
    links = {s: sum(100 * len(s & o) >= 90 * len(s | o) for o in different if o != s) for s in different}
    want = {}
    for (key, _), s in zip(rows, sets):
        want.setdefault((key, len(s)), set()).add(links.get(s, 0))
    assert got == want and max(links.values()) > 20


def test_empty_table(spark):
    assert jaccard.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_group_of_copies_makes_few_pairs(spark, monkeypatch):
    """600 different copies of a text: verified pairs stay near the number of copies."""
    draw, pairs = random.Random(3), []
    base = [f"w{i}" for i in range(200)]
    rows = []
    for key in range(600):
        copy = list(base)
        copy[draw.randrange(200)] = f"new{key}"
        rows.append((key, " ".join(copy)))
    real = jaccard.confirmed
    monkeypatch.setattr(jaccard, "confirmed", lambda *a: pairs.append((out := real(*a)).count()) or out)
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sum(pairs) < 5 * len(rows)


@pytest.mark.parametrize("whole", [2, 16])
def test_large_blocks_of_unlike_variants(spark, monkeypatch, whole):
    """Variants of one text with up to 9 edits each, few of them linked: all links, and not many pairs."""
    monkeypatch.setattr(jaccard, "WHOLE", whole)
    draw, compared, rows = random.Random(12), [], []
    base = [f"w{draw.randrange(5000)}" for _ in range(130)]
    for k in range(400):
        copy = list(base)
        for at in draw.sample(range(130), k % 10):
            copy[at] = f"edit{k}.{at}"
        rows.append((3 * k, " ".join(copy)))
        if k % 25 == 9:
            copy[draw.randrange(130)] = f"more{k}"
            rows.append((3 * k + 1, " ".join(copy)))
            rows.append((3 * k + 2, " ".join(copy[:-4])))
    real = jaccard.confirmed
    monkeypatch.setattr(jaccard, "confirmed", lambda pairs, *a: compared.append(pairs.count()) or real(pairs, *a))
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), count_links=False)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "class_size"]
    assert [r["component_id"] for r in got.orderBy("doc_id").collect()] == components(rows)
    assert sum(compared) < 12 * len(rows)


def test_prefix_length_is_exact():
    assert [jaccard.prefix_length(n) for n in (1, 9, 10, 11, 100)] == [1, 1, 2, 2, 11]


def test_every_shingle_is_counted(spark, monkeypatch):
    import zlib

    monkeypatch.setattr(jaccard, "SKETCH_BITS", 6)
    monkeypatch.setattr(jaccard, "SKETCH_BLOCKS", 2)
    docs = spark.range(60).selectExpr("id as doc_id", "id as name", "concat_ws(' ', transform(sequence(1, 20), i -> string(id * 20 + i))) as text")
    found = jaccard._signatures(docs, 3)
    counts = [np.frombuffer(zlib.decompress(r.counts), "<u4").sum() for r in found.where("block is not null").select("counts").collect()]
    assert sum(counts) == found.agg({"n": "sum"}).first()[0] == 60 * 18


def test_odd_parts_never_exceed_the_difference():
    from curvekit.llm import links

    draw = np.random.default_rng(2)
    for n, more, less in [(1, 0, 0), (1, 1, 1), (64, 3, 2), (65, 0, 5), (500, 40, 20), (2000, 90, 200), (3000, 3000, 3000)]:
        a = np.unique(draw.integers(0, 2**63, n, np.uint64))
        b = np.unique(np.concatenate([a[less:], draw.integers(0, 2**63, more, np.uint64)]))
        if len(b):
            assert links.differing_parts(links.odd_parts(a), links.odd_parts(b)) <= len(np.setxor1d(a, b))
    assert links.differing_parts(links.odd_parts(a), links.odd_parts(b)) > 1000


def test_sets_of_unlike_documents_stay(spark, monkeypatch):
    """Long documents that share a passage only, all shingles being about as frequent: their pairs are ruled out before
    whole sets are gathered."""
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 6)
    monkeypatch.setattr(jaccard, "SKETCH_BLOCKS", 2)
    gathered, draw = [], random.Random(9)
    real = jaccard.gather_sets
    monkeypatch.setattr(jaccard, "gather_sets", lambda *a: gathered.append((out := real(*a)).count()) or out)
    rows = [(k, " ".join(f"w{draw.randrange(10**6)}" for _ in range(800)) + "".join(f" p{k // 2}.{i}" for i in range(60))) for k in range(60)]
    rows += [(100, rows[0][1] + " end"), (101, rows[0][1])]
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: 0 if k in (100, 101) else k for k, _ in rows}
    assert sum(gathered) <= 4


def test_a_worker_keeps_one_memo():
    from curvekit.llm import common

    common.process_memo("one")["a"] = 1
    assert common.process_memo("one") == {"a": 1}
    assert common.process_memo("two") == {} and common.process_memo("one") == {}
    common.process_memo("one")["a"] = 1
    common.release_memos()
    assert common.process_memo("one") == {}
