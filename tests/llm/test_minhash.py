"""MinHash near duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from curvekit.llm import minhash
from curvekit.llm.jaccard import shingle_sets
from tests.llm.test_jaccard import sets_by_words


def brute_force(rows, words=5, percent=85):
    """Sorted (doc_id, n_shingles, component_id) of all rows."""
    sets = [sets_by_words(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return sorted(((k, len(s), least.get(top(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr)


def texts(seed):
    """Copies with few and many edits, a passage shared by many, a chain, short texts, and exact copies."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 6)))
    shared = [word() for _ in range(80)]
    out = []
    for group in range(14):
        base = [word() for _ in range(draw.choice([1, 3, 5, 6, 30, 90, 250]))]
        for _ in range(draw.choice([1, 2, 5, 30])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 3])):
                copy[draw.randrange(len(copy))] = word()
            out.append(" ".join(copy + shared * (group % 4 == 0)))
    chain = [word() for _ in range(150)]
    for step in range(12):
        chain[step * 9] = f"new{step}"
        out.append("\n".join(chain))
    far = [word() for _ in range(120)]  # many variants of one text, some linked and some not
    for k in range(60):
        copy = list(far)
        for at in draw.sample(range(120), k % 5):
            copy[at] = word()
        out.append(" ".join(copy))
    draw.shuffle(out)
    return [(3 * i + 1, t) for i, t in enumerate(out)] + [(9000, None), (9001, ""), (9002, " \n"), (None, out[0]), (None, "alone here"), (1, out[5])]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    table = texts(seed)
    found = minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(7)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_force(table)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_other_words_and_threshold(spark):
    table = texts(4)
    found = minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), words=3, percent=90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_force(table, 3, 90)


def test_awkward_rows(awkward, nothing):
    table = [(r.doc_id, r.text) for r in awkward.collect()]
    found = minhash.near_duplicates(awkward).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_force(table)
    assert minhash.near_duplicates(nothing).count() == 0


def test_large_group_takes_about_as_many_pairs_as_it_has_rows(spark, monkeypatch):
    draw = random.Random(8)
    base = [f"w{draw.randrange(500)}" for _ in range(200)]
    table = []
    for k in range(400):
        copy = list(base)
        copy[draw.randrange(200)] = f"edit{k}"
        table.append((k, " ".join(copy)))
    compared = []
    confirmed = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *rest: compared.append(pairs.count()) or confirmed(pairs, *rest))
    found = minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0} and sum(r.kept for r in found) == 1 and found[0].class_size == 400
    assert sum(compared) < 1200


@pytest.mark.parametrize("whole", [2, 16])
def test_large_group_of_unlike_variants_is_whole_and_not_quadratic(spark, monkeypatch, whole):
    """Variants of one text with 0 to 9 edits, of which some are linked, by twos and threes, only with each other."""
    monkeypatch.setattr(minhash, "WHOLE", whole)
    draw = random.Random(12)
    base = [f"w{draw.randrange(5000)}" for _ in range(130)]
    table = []
    for k in range(500):
        copy = list(base)
        for at in draw.sample(range(130), k % 10):
            copy[at] = f"edit{k}.{at}"
        table.append((3 * k, " ".join(copy)))
        if k % 25 == 9:  # a second copy with the same edits and one more
            copy[draw.randrange(130)] = f"more{k}"
            table.append((3 * k + 1, " ".join(copy)))
        if k % 50 == 9:  # and one cut short
            table.append((3 * k + 2, " ".join(copy[:-4])))
    compared = []
    confirmed = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *rest: compared.append(pairs.count()) or confirmed(pairs, *rest))
    found = minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_force(table)
    assert sum(compared) < 12 * len(table)


def test_signatures_estimate_similarity():
    draw = random.Random(3)
    words = [f"w{draw.randrange(10**6)}" for _ in range(4000)]
    for edits in (0, 20, 60, 200):
        copy = list(words)
        for at in draw.sample(range(4000), edits):
            copy[at] = f"x{at}"
        a, b = shingle_sets([" ".join(words), " ".join(copy)], 5)
        with np.errstate(over="ignore"):
            signatures = minhash.minima([a, b], minhash.universal())
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((signatures[0] == signatures[1]).mean() - truth) < 0.12
        differ = bin(int.from_bytes((minhash.sketches(signatures)[0] ^ minhash.sketches(signatures)[1]).tobytes(), "little")).count("1")
        assert abs(differ / minhash.HASHES - (1 - truth) / 2) < 0.1
    one = np.array([5], np.uint64)
    with np.errstate(over="ignore"):
        a, b = minhash.universal(4)
        assert (minhash.minima([one], (a, b))[0] == a * np.uint64(5) + b).all()


def test_stars_reach_the_smallest_node(spark):
    draw = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 160)] + [(900, k) for k in range(901, 940)] + [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(150)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r.node: r.label for r in minhash.alternating_stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent if top(x) != x}
