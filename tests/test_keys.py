"""The lattice of column subsets against sets in Python."""

import random
from itertools import combinations

import pytest

from curvekit.operators import keys as K


def brute_force(rows, columns):
    out = {}
    whole = len(set(rows))
    for size in range(1, len(columns) + 1):
        for subset in combinations(range(len(columns)), size):
            n = len({tuple(r[i] for i in subset) for r in rows})
            out[subset] = (n, len(rows) - n, n == whole)
    minimal = {s for s, v in out.items() if v[2] and not any(out[t][2] for t in out if set(t) < set(s))}
    return {"+".join(columns[i] for i in s): (*v, s in minimal) for s, v in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_lattice(spark, seed):
    draw = random.Random(seed)
    columns = ["a", "b", "c", "d", "e"][: 2 + seed]
    rows = [tuple(draw.choice([None, *range(2 + 3 * i)]) for i in range(len(columns))) for _ in range(60)]
    rows += rows[:7]
    found = K.key_lattice(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in columns)), columns, unique=3).collect()
    want = brute_force(rows, columns)
    assert {r.columns: (r.n_unique, r.n_surplus, r.is_key, r.is_minimal) for r in found} == want
    assert {r.columns for r in found if r.matches} == {c for c, v in want.items() if v[0] == 3}


def test_supersets_of_keys_are_not_counted(spark, monkeypatch):
    asked = []
    counted = K._counted
    monkeypatch.setattr(K, "_counted", lambda cells, columns, subsets: asked.extend(subsets) or counted(cells, columns, subsets))
    rows = spark.range(50).selectExpr("id as a", "id % 7 as b", "id % 3 as c", "1 as d")
    found = {r.columns: r for r in K.key_lattice(rows, ["a", "b", "c", "d"]).collect()}
    assert [c for c, r in found.items() if r.is_minimal] == ["a"] and found["a+b+c+d"].is_key
    assert all("a" not in s for s in asked if len(s) > 1) and found["b+c"].n_unique == 21


def test_nothing_and_too_much(spark):
    none = spark.createDataFrame([], "a int, b int")
    assert {(r.columns, r.n_unique, r.n_surplus) for r in K.key_lattice(none, ["a", "b"]).collect()} == {("a", 0, 0), ("b", 0, 0), ("a+b", 0, 0)}
    with pytest.raises(ValueError):
        K.key_lattice(none, [f"c{i}" for i in range(13)])


@pytest.mark.parametrize("part", [1, 9, 1000])
def test_lattice_counted_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(K, "FEW_CELLS", 5)
    monkeypatch.setattr(K, "PART_CELLS", part)
    draw = random.Random(part)
    columns, nan = ["a", "b", "c", "d"], float("nan")
    values = ([None, *"stu"], [None, *range(40)], [None, 0.0, -0.0, nan, 1.5], [None, b"x", b"y"])
    # Column b has one value in most rows, which is more than a part.
    rows = [tuple(draw.choice(v) if i != 1 or draw.random() < 0.6 else 7 for i, v in enumerate(values)) for _ in range(300)]
    table = spark.createDataFrame(rows, "a string, b int, c double, d binary")
    found = K.key_lattice(table, columns).collect()
    plain = [tuple("nan" if x != x else x for x in r) for r in rows]
    assert {r.columns: (r.n_unique, r.n_surplus, r.is_key, r.is_minimal) for r in found} == brute_force(plain, columns)


def test_many_cells_are_not_multiplied_by_the_subsets(spark, monkeypatch):
    monkeypatch.setattr(K, "FEW_CELLS", 50)
    multiplied = []
    counted = K._counted_in_cells
    monkeypatch.setattr(K, "_counted_in_cells", lambda cells, columns, subsets: multiplied.append(cells.count()) or counted(cells, columns, subsets))
    rows = spark.range(2000).selectExpr("id % 900 as a", "id % 7 as b", "id % 3 as c", "id % 2 as d")
    found = {r.columns: r.n_unique for r in K.key_lattice(rows, ["a", "b", "c", "d"]).collect()}
    assert max(multiplied) <= 50 and found["a+b"] == len({(i % 900, i % 7) for i in range(2000)}) and found["b+c+d"] == 42
