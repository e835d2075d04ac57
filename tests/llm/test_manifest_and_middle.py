"""The Merkle manifest and the fill-in-middle transformation against brute force."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from curvekit.llm import fill_middle, merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes):
    """All levels of a tree, lowest first."""
    found = [nodes]
    while len(found[-1]) > 1:
        below = found[-1]
        found.append([sha("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return found


def path(tree, at):
    """(left, right) of a leaf, from its level up."""
    steps = []
    for level in tree[:-1]:
        run = at // 3 * 3
        steps.append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        at //= 3
    return steps


def proofs(rows):
    """Rows of op11 over (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row, sha("".join(map(value, row)))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[1]))
        trees[source] = levels([leaf for _, leaf in groups[source]])
    top = levels([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for i, source in enumerate(order):
        for at, (row, leaf) in enumerate(groups[source]):
            steps = path(trees[source], at) + path(top, i)
            folded = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                folded = sha("".join(map(value, (*row[:4], row[4].replace("\n", "")))))
            for left, right in steps:
                folded = sha(left + folded + right)
            out.append((row[0], leaf, trees[source][-1][0], root, sha("".join(a + b for a, b in steps)), folded, folded == root))
    return sorted(out, key=repr)


def manifest(df, **more):
    return merkle.manifest(
        df, found={"text": F.translate("text", "\n", "")}, suspect=F.crc32(F.col("doc_id").cast("string")) % 2 == 0, **more
    )


RESULT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("segment,sizes", [(1, [1, 2, 3, 4, 28, 40]), (2, [100, 1, 9, 10]), (3, [1] * 31 + [200]), (6, [800])])
def test_manifest_equals_trees_built_whole(spark, rows, segment, sizes):
    table = [
        (100 * i + k if k % 7 else i, None if i == 1 else f"s{i * 7 % 40}é", "en" if k % 3 else None, k, None if k % 11 == 5 else f"text\n{k}\n" * (k % 2))
        for i, size in enumerate(sizes) for k in range(size)
    ]
    df = spark.createDataFrame(table, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert rows(manifest(df, segment=segment, paths=False).select(*RESULT)) == proofs(table)


def test_manifest_of_awkward_rows(spark, awkward, nothing, rows):
    table = awkward.withColumn("n_chars", F.length("text").cast("long"))
    want = [tuple(r) for r in table.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = manifest(table)
    assert rows(found.select(*RESULT)) == proofs(want)
    for row in found.collect():
        steps = [(s.left, s.right) for s in row.path]
        assert merkle.folded(row.leaf, steps) == row.root
        assert sha("".join(a + b for a, b in steps)) == row.proof_sha256
    assert manifest(nothing.withColumn("n_chars", F.lit(1))).count() == 0
    one = manifest(table.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].path == []


def test_manifest_finds_what_was_changed(spark):
    df = spark.range(500).selectExpr("id as doc_id", "concat('s', id % 3) as source", "'en' as lang", "id as n_chars", "concat('t', id) as text")
    found = merkle.manifest(df, found={"text": F.lit("other")}, suspect=F.col("doc_id") == 77)
    assert [r.doc_id for r in found.where("not verified").collect()] == [77]
    assert found.select("root").distinct().count() == 1


def formed(key, text):
    """Row of op13, by regular expression and slicing."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, digest = len(tokens), sha(f"1:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return key, n, form, len(prefix), len(middle), sha(out), sha(text)


ODD = ["", "a", "é", "\U0001F600", "aé漢\U0001F600b\n\n c1d2", "x<P>y", "<S", "P>", "<<S>", "<M", "@[`{AZaz", "\x00a\x00", "漢" * 50, "a" * 4000, "ab é " * 700]


def test_fill_middle_equals_brute_force(spark, rows):
    table = [(k, ODD[k % len(ODD)] + ("é" * (k % 3))) for k in range(600)] + [(None, None), (None, "no key"), (5, None), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = rows(fill_middle.digests(fill_middle.fill_middle(df)))
    assert got == sorted((formed(*r) for r in table), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_middle_by_characters(spark):
    table = [(k, ODD[k % len(ODD)]) for k in range(300)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    out = fill_middle.fill_middle(df, unit="char").withColumn("again", fill_middle.restored())
    for row in out.collect():
        text = ODD[row.doc_id % len(ODD)]
        assert row.again == text and row.n == len(text)
        if row.form != "plain":
            h1, h2, _, _ = fill_middle.draws(row.doc_id)
            a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
            assert (row.prefix_chars, row.middle_chars) == (a, b - a)
            assert f"<P>{text[:a]}" in row.output and row.output.endswith(f"<M>{text[a:b]}")


def test_fill_middle_of_awkward_rows(awkward, nothing, rows):
    got = fill_middle.digests(fill_middle.fill_middle(awkward))
    assert rows(got) == sorted((formed(r.doc_id, r.text) for r in awkward.collect()), key=repr)
    assert fill_middle.fill_middle(nothing).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_middle(awkward, unit="word")
