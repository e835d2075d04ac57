"""Each stage of the pipeline against brute force on its own input, and the registered queries."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from check import compare, connect
from curvekit.llm import cube, pieces
from curvekit.llm.queries import PIECES, QUERIES

from .conftest import AWKWARD
from .test_jaccard import sets_by_words
from .test_sorting_and_shards import norm
from .test_tokens import base_counts

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(8)
    words = [f"{a}{b}" for a in "the of and in to".split() for b in ("", "re", "ing", "ed", "s", "al", "ous")]
    rows = [(k, t, g, s, 0) for k, t, g, s in AWKWARD]
    for i in range(80):
        text = " ".join(draw.choices(words, k=80))
        rows.append((100 + i, text, "en", f"src{i % 3}", 1))
        if i % 4 == 0:
            rows.append((300 + i, text.replace(" ", "\n", 1), "en", "src9", 1))
        if i % 4 == 1:
            rows.append((300 + i, text + " end", "en", "src9", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def as_rows(frame):
    return Counter(map(tuple, frame.collect()))


def test_quality_rules(spark, docs):
    kept = pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns
    before, after = as_rows(docs), as_rows(kept)
    assert after <= before and not any(base_counts(r[1])[-1] for r in after)
    clean = Counter({r: n for r, n in before.items() if r[0] and r[0] >= 100})
    assert clean <= after


def test_exact_dedup(spark, docs):
    got = as_rows(pipeline.exact_dedup(spark, docs, ""))
    groups = defaultdict(list)
    for r in docs.collect():
        groups[norm(r["text"])].append(tuple(r))
    assert sum(got.values()) == len(groups)
    for rows in groups.values():
        assert min(rows, key=lambda r: (r[0] is None, r[0] or 0))[0] in {r[0] for r in got if norm(r[1]) == norm(rows[0][1])}


def test_near_dedup(spark, docs):
    before = [tuple(r) for r in pipeline.exact_dedup(spark, docs, "").collect()]
    after = as_rows(pipeline.near_dedup(spark, spark.createDataFrame(before, docs.schema), ""))
    sets = [sets_by_words(r[1]) for r in before]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for g, r in zip(group, before):
        best[g] = min(best.get(g, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    assert after == Counter(best.values())


def test_near_dedup_at_five_words_and_80_percent(spark):
    """Against brute force, with pairs around 0.8: a block added, words replaced here and there."""
    draw, rows = random.Random(11), []
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    for i in range(24):
        base = [word() for _ in range(200)]
        rows.append((10 * i, " ".join(base)))
        rows.append((10 * i + 1, " ".join(base + [word() for _ in range(20 + 3 * i)])))
        for at in draw.sample(range(20), 4 + i % 6):
            base[10 * at] = word()
        rows.append((10 * i + 2, " ".join(base)))
    frame = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in pipeline.near_dedup(spark, frame, "").collect()}
    sets = [sets_by_words(t, 5) for _, t in rows]

    def stays(percent):
        group = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    group = [group[j] if g == group[i] else g for g in group]
        return {min(k for g, (k, _) in zip(group, rows) if g == top) for top in group}

    assert got == stays(80) and got < stays(90) and len(got) > 24


def test_mix_sources(spark, docs):
    before, after = as_rows(docs), as_rows(pipeline.mix_sources(spark, docs, ""))
    assert all(r in before and n <= 2 * before[r] for r, n in after.items())
    size = lambda rows: sum(len((r[1] or "").split()) * n for r, n in rows.items())
    assert size(after) == pytest.approx(1.5 * size(before), rel=0.2)


def test_stages_bear_any_further_column(spark):
    """Columns called as the stages' own might be, a map, and rows that differ in them only."""
    names = ["unit", "copies", "_row", "row_", "_row_", "_digest", "unit_", "source_", "copies_", "copy_", "id_", "sha_", "place_", "group", "last"]
    base = [(*r, 0) for r in AWKWARD] + [(k, None if k % 2 else f"text of words {k} " * 9, "en" if k % 3 else None, None if k % 5 else "s", k) for k in range(50, 90)]
    rows = [(*r, *[i % 3 for _ in names], {f"k{i % 2}": i, "z": None}) for i, r in enumerate(base)]
    rows += [(*rows[0][:-1], {"other": 1}), rows[1], rows[-1], (*rows[-1][:-1], None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names) + ", extra map<string,int>"
    docs = spark.createDataFrame(rows, schema)
    frozen = lambda f: Counter((*r[:-1], None if r[-1] is None else frozenset(r[-1].items())) for r in f.collect())
    before = frozen(docs)
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.schema == docs.schema
        found = frozen(after)
        assert found.keys() <= before.keys()
        if stage is not pipeline.mix_sources:
            assert found <= before
    assert pipeline.encode(spark, docs, "").count() == len(rows)
    again = [frozen(pipeline.exact_dedup(spark, docs.repartition(n), "")) for n in (1, 6)]
    assert again[0] == again[1] and sum(again[0].values()) == len({norm(r[1]) for r in rows})


def test_rows_of_null_text_and_null_source_are_told_apart(spark):
    table = [(k % 400, None, "a b" if k % 3 else "c d", None, 0) for k in range(600)]
    table += [(k % 400, "a b" if k % 3 else "c d", "en", None, 0) for k in range(600)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    swapped = [(k, None, "en", x, 0) for k, x, *_ in [(r[0], r[2]) for r in table[:600]]]
    docs = spark.createDataFrame(swapped + table[600:], schema)
    found = cube.mix(docs)
    assert found.count() == 1200
    null_source = [r for r in found.collect() if r.source is None]
    assert sum(r.taken for r in null_source) == pytest.approx(null_source[0].target, abs=2)
    mixed = pipeline.mix_sources(spark, docs, "")
    assert mixed.where("source is null").count() == sum(r.copies for r in null_source)


def test_encode(spark, docs):
    v = pieces.vocabulary(PIECES)
    encoder, decoder = pieces.Encoder(v), pieces.Decoder(v.texts)
    for r in pipeline.encode(spark, docs.where("doc_id >= 100"), "").join(docs, "doc_id").collect():
        assert decoder(r["ids"]) == r["text"] and r["n_pieces"] == len(r["ids"])
        assert np.frombuffer(encoder([r["text"]])[0], "<u4").tolist() == r["ids"]


def test_run_is_the_stages_in_turn(spark):
    assert [name for name, _ in pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "mix sources", "SentencePiece"]
    step = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in pipeline.STAGES:
        step = stage(spark, step, SF_DIR)
    hashed = lambda f: Counter((r["doc_id"], tuple(r["ids"])) for r in f.collect())
    assert hashed(step) == hashed(entry.queries()["pipeline"](spark, SF_DIR))


def test_an_empty_table_passes_all_stages(spark, docs):
    step = docs.where("false")
    for _, stage in pipeline.STAGES:
        step = stage(spark, step, SF_DIR)
    assert step.collect() == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n in entry.oracle_sql()])
def test_check_sql(spark, name):
    same, count, _, note = compare(spark, connect(SF_DIR), SF_DIR, name)
    assert same and count, note


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
