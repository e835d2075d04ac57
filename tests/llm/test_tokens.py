"""Encoders, block files and fertility against the libraries and brute force."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from curvekit.llm import fertility, frames, pieces, tokens
from curvekit.llm.common import release_memos
from curvekit.llm.queries import BYTE_BPE, PIECES
from curvekit.llm.tokens import MemoEncoder, byte_bpe_encoder, read_file

from .conftest import AWKWARD

TEXTS = [t or "" for _, t, *_ in AWKWARD] + [
    "a\n\n b", "a \nb  c", " lead", "trail ", "\n", " \n ", "don't we'll", "x  y", "tab\t x", "1234 5,678", "a<|endoftext|>b <|endoftext|>",
    "quote \" it's\r\n  next", "\x1c \x1d x", "é́ 漢字 ▁▁",
    "end.\nNew line, and. more,\n\nEmpty.\r\nReturn.", "a.b, c.,", "É., été, x2, 3.", "word.", ",", " .", "don't, y.",
]


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BYTE_BPE)
    encode = byte_bpe_encoder(read_file(BYTE_BPE))
    for _ in range(2):  # without and with what the memo holds
        assert [ids_of(r) for r in encode(TEXTS)] == [whole.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_only_unknown_runs_go_to_the_tokenizer():
    """Words known from elsewhere are not asked for again because of marks, digits or line ends at them."""
    release_memos()
    encode, asked = byte_bpe_encoder(read_file(BYTE_BPE)), []
    new = encode.encode_new
    encode.encode_new = lambda pieces: asked.extend(pieces) or new(pieces)
    encode(["Zorbel grunwick"])
    assert {"Zorbel", " grunwick"} <= set(asked) <= set(encode.known)
    asked.clear()
    encode(["Zorbel, grunwick.\nZorbel 42% grunwick,\nZorbel42 grunwick%"])
    assert not any("grunwick" in p for p in asked) and set(asked) <= {"", ",", ".", "\n", " Zorbel", " 42", "42", "%"}


def test_runs_of_all_kinds_equal_the_library():
    import random

    from tokenizers import Tokenizer

    draw = random.Random(3)
    parts = ["a", "the", "Zorbel", " ", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "é", "İ", "ʰ", "\u0301", "漢", "ー", "١", "½", "23", "-", ".", ",", "<",
             "<|endoftext|>", "|>", "_", "#%", "\x02", "\x1c", "\x85", "\xa0", "\u2028", "И", "ω", "가", "゛", "µ", "×", "\0", "\U0001F600"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(3000)]
    whole, encode = Tokenizer.from_file(BYTE_BPE), byte_bpe_encoder(read_file(BYTE_BPE))
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids_of(r) for r in encode(texts)] == want
    assert [ids_of(r) for t in texts for r in encode([t])] == want
    for kind in (pa.string(), pa.large_string()):
        assert [ids_of(r) for r in encode(pa.array(texts, kind)[1:])] == want[1:]


def test_kinds_of_characters_are_those_of_the_pattern():
    import re

    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(BYTE_BPE).pre_tokenizer.pre_tokenize_str
    letters = re.findall(f"[{tokens._LETTERS}]", "".join(map(chr, range(0xD800))))
    assert len(letters) > 30_000 and len(cut(" ".join(f"a{c}a" for c in letters))) == len(letters)
    marks = re.findall(f"[{tokens._MARKS}]", "".join(map(chr, range(128))))
    assert len(marks) == 30 and len(cut(" ".join(f"a{c}{c}b1{c}" for c in marks))) == 5 * len(marks)


def test_other_cutters_get_whole_pieces():
    """A vocabulary whose pattern is another one: pieces are not taken apart."""
    import json

    made = json.loads(read_file(BYTE_BPE))
    made["added_tokens"].append(made["added_tokens"][0] | {"id": 50257, "content": "[x1]"})
    raw = json.dumps(made).encode()
    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_str(raw.decode()), byte_bpe_encoder(raw)
    texts = ["a [x1] b", "[x1]", "is[x1]it, x1.\nNext [x1", "two  [x1] spaces"]
    assert [ids_of(r) for r in encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr("curvekit.llm.tokens.MEMO_ENTRIES", 2)
    encode = MemoEncoder("test", lambda new: [p.encode() for p in new])
    assert encode(["a b c d", "", " x  y"]) == [b"a b c d", b"", b" x  y"]
    assert len(encode.known) <= 2


@pytest.mark.parametrize("ids", [[], [7], [5] * 300, list(range(1000)), [2**32 - 1, 0] * 100, [1] * 127 + [2**31]])
def test_blocks_round_trip(ids):
    assert frames.unpack(frames.pack(np.array(ids, np.uint32))).tolist() == ids


def test_blocks_use_exceptions_and_are_small():
    draws = np.random.default_rng(0)
    ids = draws.integers(100, 164, 12_800).astype(np.uint32)
    ids[::50] = 50_000
    raw = frames.pack(ids)
    assert frames.unpack(raw).tolist() == ids.tolist()
    assert len(raw) < 12_800 * 6 / 8 + 256 * 5 + 100 * 10 + 100


@pytest.mark.parametrize("segment", [1, 1 << 18])
def test_files(spark, awkward, folder, monkeypatch, segment):
    from tokenizers import Tokenizer

    monkeypatch.setattr(frames, "SEGMENT_IDS", segment)
    frames.write_ids(awkward, f"{folder}/ids", BYTE_BPE, 2)
    whole = Tokenizer.from_file(BYTE_BPE)
    rows = sorted(AWKWARD, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for key, text, *_ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    by_start = lambda r: r["start"]
    assert [tuple(r) for r in sorted(frames.read_digests(spark, f"{folder}/ids").collect(), key=by_start)] == [w[:4] for w in want]
    assert [r["ids"] for r in sorted(frames.read_ids(spark, f"{folder}/ids").collect(), key=by_start)] == [w[4] for w in want]


def test_segments_have_about_as_many_ids_as_they_should(spark, folder, monkeypatch):
    monkeypatch.setattr(frames, "SEGMENT_IDS", 100)
    rows = spark.createDataFrame([(i, "one two three") for i in range(400)], "doc_id long, text string").coalesce(1)
    frames.write_ids(rows, f"{folder}/ids", BYTE_BPE, 2)
    sizes = [sum(r["doc_lengths"]) for r in spark.read.parquet(f"{folder}/ids").collect()]
    assert sum(sizes) == 1600 and max(sizes) <= 100 + 4


def test_no_files_for_an_empty_table(spark, nothing, folder):
    frames.write_ids(nothing, f"{folder}/ids", BYTE_BPE, 2)
    assert frames.read_ids(spark, f"{folder}/ids").collect() == []


def best_score(v, text):
    """Score of the best path over a whole marked text, one character at a time."""
    known = {v.texts[i].decode(): s for i, s in zip(v.ids.tolist(), v.scores.tolist())}
    marked = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-np.inf] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - 16), end):
            s = known.get(marked[start:end], v.worst if end - start == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


def test_paths_are_the_best():
    v = pieces.vocabulary(PIECES)
    score = dict(zip(v.ids.tolist(), v.scores.tolist()))
    encode, decode = pieces.Encoder(v), pieces.Decoder(v.texts)
    bytes_ = {i: b for b, i in enumerate(v.bytes.tolist())}
    for text in TEXTS:
        ids = ids_of(encode([text])[0])
        assert decode(ids) == text.replace("▁", " ")
        unknown = len([b for i in ids if i in bytes_ and (b := bytes_[i]) & 0xC0 != 0x80])
        got = sum(score[i] for i in ids if i not in bytes_) + unknown * v.worst
        assert not text or got == pytest.approx(best_score(v, text), abs=1e-6)


def test_paths_equal_the_library():
    """The same pieces and scores as a Unigram model of the library give the same ids."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(read_file(PIECES))
    v = pieces.vocabulary(PIECES)
    for i, s in zip(v.ids.tolist(), v.scores.tolist()):
        model.pieces[i].score = s
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    encode = pieces.Encoder(v)
    texts = [t for t in TEXTS if t and "▁" not in t and "xxx" not in t]  # a row of equal letters has ties
    assert [ids_of(r) for r in encode(texts)] == [library.encode(t) for t in texts]


def test_trie_finds_its_keys():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"\x00"]
    trie = pieces.DoubleArray(keys)

    def find(key):
        node = 0
        for c in [*key, 256]:
            child = trie.base[node] + c
            if trie.check[child] != node:
                return None
            node = child
        return -trie.base[node] - 1

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert find(b"") is None and find(b"abcd") is None and find(b"c") is None


def test_encode_and_decode_tables(spark, awkward, nothing):
    encoded = pieces.encode(awkward, PIECES)
    back = Counter((r["doc_id"], r["text"]) for r in pieces.decode(encoded, PIECES).collect())
    assert back == Counter((k, (t or "").replace("▁", " ")) for k, t, *_ in AWKWARD)
    assert pieces.encode(nothing, PIECES).collect() == []
    for r in pieces.digests(encoded, PIECES).where("doc_id is null").collect():
        assert r["n_pieces"] == 0 or r["n_chars"] > 0


def base_counts(text):
    """The base rules from their words."""
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines, repeats = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            repeats += line in lines
            lines.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), repeats, len(covered), failed


def test_base_rules(spark, awkward, nothing):
    rows = fertility.judge(awkward, PIECES).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == Counter((k, *base_counts(t)) for k, t, *_ in AWKWARD)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert fertility.judge(nothing, PIECES).collect() == []


def test_fertility_of_a_text(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = "some words and 漢字 \U0001F9FF\U0001F9FF"
    (row,) = fertility.measure(spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string"), PIECES).collect()
    ids = model.encode(text)
    p = np.array(list(Counter(ids).values())) / len(ids)
    assert row["n_tokens"] == len(ids) and row["band"] == "script LATIN"
    assert row["byte_share"] == pytest.approx(sum(map(model.is_byte, ids)) / len(ids))
    assert row["entropy"] == pytest.approx(-(p * np.log2(p)).sum() / np.log2(len(ids)))


def test_bands_reject_outliers(spark):
    import random

    draw = random.Random(1)
    words = [model_word for model_word in "the of and to in is was for that with as by on at from this which or are".split()]
    rows = [(i, " ".join(draw.choices(words, k=60)), "en") for i in range(300)]
    odd = " ".join("".join(draw.choices("0123456789ABCDEFXYZ#@", k=30)) for _ in range(60))
    rows.append((999, odd, "en"))
    got = {r["doc_id"]: r["kept"] for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    assert not got.pop(999) and sum(got.values()) >= 295


def test_copies_of_a_text_do_not_narrow_the_bands(spark):
    """A third of all rows copies of one clean text, with white space of their own: what is kept stays the same."""
    import random

    draw = random.Random(5)
    common = "the of and to in is was for that with as by on at from this which or are".split()
    rare = "fertility notwithstanding quixotic albuminous zymurgy palimpsest".split()
    rows = [(i, " ".join(draw.choices(common, k=60 - i % 30) + draw.choices(rare, k=i % 30)), "en") for i in range(200)]
    copies = [(1000 + i, rows[15][1].replace(" ", " \n"[i % 2]), "en") for i in range(100)]
    judged = lambda r: {x["doc_id"]: x["kept"] for x in fertility.judge(spark.createDataFrame(r, "doc_id long, text string, lang string"), PIECES).collect()}
    alone, together = judged(rows), judged(rows + copies)
    assert {k: together[k] for k in alone} == alone and sum(alone.values()) >= 195
    assert {together[k] for k, *_ in copies} == {alone[15]}
    row = lambda digest, c: (digest.encode(), "en", 64, 80, False, c, 0.0, 0.7)
    spread = [row(f"{i}", 2 + i / 500) for i in range(200)]
    limits = lambda r: fertility.bands(spark.createDataFrame(r, "digest binary, band string, n_words long, n_tokens long, base_failed boolean, chars_per_token double, byte_share double, entropy double")).collect()
    assert limits(spread + [row("75", 2.15)] * 100) == limits(spread)


def test_near_copies_leave_each_measure_its_least_width(spark):
    row = lambda i, c: (f"{i}".encode(), "en", 64, 80, False, c, 0.0, 0.7)
    measured = spark.createDataFrame([row(i, 2.2) for i in range(60)] + [row(100 + i, 2.0 + i / 100) for i in range(40)],
                                     "digest binary, band string, n_words long, n_tokens long, base_failed boolean, chars_per_token double, byte_share double, entropy double")
    (limits,) = fertility.bands(measured).collect()
    for m, least in fertility.LEAST_WIDTHS.items():
        assert limits[f"{m}_most"] - limits[f"{m}_least"] >= 2 * least - fertility.BIN
    assert limits["chars_per_token_least"] < 2.06


def test_repeated_windows_survive_hash_collisions(monkeypatch):
    monkeypatch.setattr(fertility, "_MIX", np.zeros(5, np.uint64))  # all windows of a document share a hash
    codes = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 1, 1, 1, 1])
    doc = np.array([0] * 15 + [1] * 5)
    assert fertility.repeated_words(codes, doc, 2).tolist() == [10, 0]
