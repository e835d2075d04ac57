"""Encoding by public tokenizers, text pieces seen before kept in a bounded memo."""

import json
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from curvekit.llm.common import process_memo

#: Entries of a memo, and the longest text of one: some 60 MB at most.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 32
#: A space behind white space: no safe place to cut. Arrow's `\s` is ASCII only.
_UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\pZ] "
_CUT = re.compile(r"(?<=\S)(?= )")
_BLANK = re.compile(r"\s|^$")
#: Letters of old blocks, the same in every version of Unicode, and marks. Not `'`, which the pattern joins with letters
#: behind it, nor `<`, which begins special tokens.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-яぁ-ゖァ-ヺ一-龥가-힣"
_MARKS = r"!-&(-/:;=-@\[-`{-~"
#: The pattern never cuts a run of one kind, and always between two, also around a line end between them.
_RUN = rf" ?(?:[{_LETTERS}]+|[0-9]+|[{_MARKS}]+)"
_RUNS = rf"\A ?[{_LETTERS}0-9{_MARKS}]+(?:\n[{_LETTERS}0-9{_MARKS}]+)*\n?\z"
_SINGLE = re.compile(_RUN)
_BEHIND = "\x02"  # behind each run
_TEXT = pa.large_string()


def read_file(path: str) -> bytes:
    """A vocabulary file, read by the driver; its bytes travel to the tasks (a few MB, fixed)."""
    with open(path, "rb") as file:
        return file.read()


class MemoEncoder:
    """encode(texts) -> ids of each text as little-endian unsigned 32-bit integers.

    A text is cut in front of every single space that follows a non-space. The byte-level
    pattern never matches across such a place, so the pieces encode independently. Arrow cuts
    the texts, numbers the different pieces and takes these apart where the pattern does so, too;
    what is left is looked up in a memo and only the unknown goes to the tokenizer. The memo lives in the
    worker and stops growing at MEMO_ENTRIES.
    """

    def __init__(self, name: str, encode_new: Callable[[list[str]], list[bytes]], apart: bool = True):
        self.known = process_memo(name).setdefault("pieces", {})
        self.encode_new = encode_new
        self.apart = apart

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        column = texts.cast(_TEXT) if isinstance(texts, pa.Array) else pa.array(texts, _TEXT)
        odd = pc.match_substring_regex(column, _UNSAFE)
        plain = iter(self.by_words(column.filter(pc.invert(odd))))
        spaced = iter(self.by_pieces(column.filter(odd).to_pylist()))
        return [next(spaced if o else plain) for o in odd.to_pylist()]

    def by_words(self, texts: pa.Array) -> list[bytes]:
        """Cuts in front of every space."""
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[:1]
        words = cut.flatten()
        coded, first = words.dictionary_encode(), words.take(pa.array(bounds[:-1])).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        codes[bounds[:-1]] = first.indices.to_numpy().astype(np.int64) + len(coded.dictionary)
        spelled = pc.binary_join_element_wise(pa.scalar("", _TEXT), coded.dictionary, pa.scalar(" ", _TEXT))
        return self.joined(pa.concat_arrays([spelled, first.dictionary]), codes, bounds)

    def by_pieces(self, texts: list[str]) -> list[bytes]:
        """Cuts where a non-space is in front of the space."""
        cut = [_CUT.split(t) for t in texts]
        coded = pa.array(list(chain.from_iterable(cut)), _TEXT).dictionary_encode()
        return self.joined(coded.dictionary, coded.indices.to_numpy(), np.cumsum([0, *map(len, cut)]))

    def joined(self, pieces: pa.Array, codes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Ids of the texts whose pieces have these codes."""
        _, ends, raw = self.ids(pieces).take(pa.array(codes)).buffers()
        ends = np.frombuffer(ends, np.int64)[bounds].tolist()
        return [raw[a:b].to_pybytes() if a < b else b"" for a, b in zip(ends, ends[1:])]

    def ids(self, pieces: pa.Array) -> pa.Array:
        """Ids of different pieces."""
        if self.apart:
            several = pc.and_(pc.invert(pc.utf8_is_alpha(pc.utf8_ltrim(pieces, " "))), pc.match_substring_regex(pieces, _RUNS))
            runs = pc.split_pattern(pc.replace_substring_regex(pieces.filter(several), f"({_RUN}|\\n)", rf"\1{_BEHIND}"), _BEHIND)
            several = several.to_numpy(zero_copy_only=False)
            count = np.ones(len(pieces), np.int64)
            count[several] = pc.list_value_length(runs).to_numpy()
            bounds = np.concatenate([[0], np.cumsum(count)])
            # The runs' places in one array of all runs, in the order of the pieces.
            both = pa.concat_arrays([runs.flatten(), pieces.filter(pa.array(~several))])
            place = np.argsort(np.repeat(~several, count), kind="stable")
            at = np.empty(len(both), np.int64)
            at[place] = np.arange(len(both))
            coded = both.dictionary_encode()
            found = self.looked_up(coded.dictionary.to_pylist()).take(coded.indices.take(pa.array(at)))
            _, ends, raw = found.buffers()
            ends = np.frombuffer(ends, np.int64)[bounds]
            return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends), raw])
        return self.looked_up(pieces.to_pylist())

    def looked_up(self, pieces: list[str]) -> pa.Array:
        known = self.known
        out = list(map(known.get, pieces))
        asked = [i for i, raw in enumerate(out) if raw is None]
        if asked:
            texts = [pieces[i] for i in asked]
            room = max(0, MEMO_ENTRIES - len(known))
            for i, text, raw in zip(asked, texts, self.encode_new(texts)):
                out[i] = raw
                if room and len(text) <= MEMO_CHARS:
                    known[text] = raw
                    room -= 1
        return pa.array(out, pa.large_binary())


class _Library:
    """A vocabulary file as the tokenizers library loads it."""

    def __init__(self, vocabulary: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        made = json.loads(vocabulary)
        cutter, model = made.get("pre_tokenizer") or {}, made["model"]
        #: Special tokens begin with "<", so that none is in runs of letters, digits and marks.
        self.apart = (
            model.get("type") == "BPE"
            and not made.get("normalizer")
            and {k: cutter.get(k) for k in ("type", "add_prefix_space", "use_regex")}
            == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
            and all("<" in t["content"] for t in made.get("added_tokens") or [])
        )
        if self.apart:
            options = {k: v for k, v in model.items() if k not in ("type", "vocab", "merges") and v is not None}
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.model = BPE(model["vocab"], merges, cache_capacity=0, **options)  # asked for unknown words only

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]


def _byte_characters() -> np.ndarray:
    """The character that byte-level vocabularies have for each byte: itself if it prints, else one from 256 on."""
    prints = np.isin(np.arange(256), [*range(33, 127), *range(161, 173), *range(174, 256)])
    return np.where(prints, np.arange(256), 255 + np.cumsum(~prints)).astype("<u2")


_CHARACTERS = _byte_characters()
_LINE_END = chr(_CHARACTERS[10])


def byte_bpe_encoder(vocabulary: bytes) -> MemoEncoder:
    """Encoder of a byte-level BPE file of the tokenizers library, without special tokens added."""
    import zlib

    name = f"bpe-{zlib.crc32(vocabulary)}"
    home = process_memo(name)
    if "library" not in home:
        home["library"] = _Library(vocabulary)
    library = home["library"]
    between = library.ids(["\n"])[0].tolist()
    joins = len(between) == 1

    def encode_new(pieces):
        """Runs of one kind go to the library's model, as the pattern would leave them whole; all others to the whole library."""
        out = [b""] * len(pieces)
        single = [i for i, p in enumerate(pieces) if library.apart and _SINGLE.fullmatch(p)]
        if single:
            joined = "\n".join([pieces[i] for i in single]).encode()
            spelled = _CHARACTERS[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le").split(_LINE_END)
            tokenize = library.model.tokenize
            found = [[t.id for t in tokenize(s)] for s in spelled]
            raw, at = np.fromiter(chain.from_iterable(found), "<u4").tobytes(), 0
            for i, x in zip(single, found):
                out[i] = raw[at : at + 4 * len(x)]
                at += 4 * len(x)
        done = set(single)
        by_library([i for i in range(len(pieces)) if i not in done], pieces, out)
        return out

    def by_library(which, pieces, out):
        """Pieces without inner white space go to the library joined by line ends, many at once."""
        plain = [i for i in which if joins and pieces[i][:1] == " " and not _BLANK.search(pieces[i][1:])]
        group = 512
        blocks = [plain[i : i + group] for i in range(0, len(plain), group)]
        for block, got in zip(blocks, library.ids(["\n".join([pieces[i] for i in b]) for b in blocks])):
            ends = np.flatnonzero(got == between[0])
            if len(ends) != len(block) - 1:  # not separable after all: one by one
                for i, x in zip(block, library.ids([pieces[i] for i in block])):
                    out[i] = x.tobytes()
                continue
            raw, bounds = got.tobytes(), [-1, *ends.tolist(), len(got)]
            for k, i in enumerate(block):
                out[i] = raw[4 * bounds[k] + 4 : 4 * bounds[k + 1]]
        done = set(plain)
        rest = [i for i in which if i not in done]
        for i, x in zip(rest, library.ids([pieces[i] for i in rest])):
            out[i] = x.tobytes()

    return MemoEncoder(name, encode_new, library.apart)
