"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces."""

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvekit.llm.common import map_slices, process_memo
from curvekit.llm.tokens import MEMO_CHARS, MEMO_ENTRIES, read_file

# Fixed values of the format: the white-space marker, and how far unknown characters lie below
# the worst piece.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
_END = 256


class DoubleArray:
    """Trie of byte strings in two arrays: child = base[node] + byte, valid where check[child] = node.

    The byte after the last one of a key is _END; the slot it leads to holds -(value + 1).
    """

    #: Slots behind the last used one that a node's place is searched in: fast, with few holes.
    REACH = 512

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        ordered = [keys[i] for i in order]
        size = 4 * _END  # the arrays grow as slots are used
        used, base, check = bytearray(size), [0] * size, [-1] * size
        used[0], check[0], top, work = 1, 0, _END + 1, [(0, 0, len(keys), 0)]
        while work:
            node, low, high, depth = work.pop()
            groups: list[tuple[int, int, int]] = []
            i = low
            while i < high:
                c = ordered[i][depth] if depth < len(ordered[i]) else _END
                j = i + 1
                while j < high and c != _END and len(ordered[j]) > depth and ordered[j][depth] == c:
                    j += 1
                groups.append((c, i, j))
                i = j
            least = min(c for c, _, _ in groups)
            at = max(_END + 1, top - self.REACH)
            if top + self.REACH + 2 * _END > len(used):
                more = len(used) + self.REACH + 2 * _END
                used, base, check = used + bytes(more), base + [0] * more, check + [-1] * more
            while True:
                at = used.find(0, at)
                if not any(used[at - least + c] for c, _, _ in groups):
                    break
                at += 1
            base[node] = at - least
            for c, i, j in groups:
                child = base[node] + c
                used[child], check[child], top = 1, node, max(top, child)
                if c == _END:
                    base[child] = -(order[i] + 1)
                else:
                    work.append((child, i, j, depth + 1))
        end = top + 2 * _END
        self.base, self.check = np.array(base[:end], np.int32), np.array(check[:end], np.int32)


class Vocabulary:
    """Pieces with log scores, their trie, and the ids of the bytes."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int] | None, unknown: int):
        """pieces[i] == "" for ids that no text gives (control, unknown and byte ids)."""
        usable = [i for i, p in enumerate(pieces) if p]
        if any(re.search(f"[^{MARK}]{MARK}", pieces[i]) for i in usable):
            raise ValueError("a piece spans two words")
        self.ids = np.array(usable, np.int32)
        self.scores = np.array([scores[i] for i in usable], np.float64)
        trie = DoubleArray([pieces[i].encode() for i in usable])
        self.base, self.check = trie.base, trie.check
        self.worst = float(self.scores.min()) - UNKNOWN_PENALTY
        self.longest = max(len(pieces[i].encode()) for i in usable)
        self.unknown = unknown
        self.bytes = None if byte_ids is None else np.array(byte_ids, np.int32)
        self.texts = [p.encode() for p in pieces]
        if byte_ids is not None:
            for value, i in enumerate(byte_ids):
                self.texts[i] = bytes([value])
        self.name = zlib.crc32(repr((pieces, scores)).encode())


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model file.

    The scores of a BPE model are merge ranks, not log probabilities; a piece of rank r then
    gets -ln(r + 1) less the log of the sum of all 1 / (r + 1), the log form of Zipf's law.
    A Unigram model's scores are used as they are.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=read_file(path))
    n = model.get_piece_size()
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
    pieces = [model.id_to_piece(i) if plain[i] else "" for i in range(n)]
    scores = [model.get_score(i) for i in range(n)]
    if all(s == int(s) for i, s in enumerate(scores) if plain[i]):
        order = sorted((i for i in range(n) if plain[i]), key=lambda i: (-scores[i], i))
        total = np.log(sum(1 / (r + 1) for r in range(len(order))))
        for r, i in enumerate(order):
            scores[i] = float(-np.log(r + 1) - total)
    bytes_ = {int(model.id_to_piece(i)[3:-1], 16): i for i in range(n) if model.is_byte(i)}
    return Vocabulary(pieces, scores, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None, model.unk_id())


class Encoder:
    """encode(texts) -> per text the ids (bytes of unsigned 32-bit numbers) of its best pieces.

    The space becomes the marker and one marker is put in front. No piece goes on past a
    marker that follows something else, so each word (with the markers in front of it) has
    a best path of its own; words are kept in a bounded memo.
    """

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, process_memo(f"unigram-{v.name}")

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self.words(t) for t in texts]
        known, extra = self.known, {}
        missing = list({w for words in cut for w in words if w not in known})
        if missing:
            extra = dict(zip(missing, self.best([MARK + w for w in missing])))
            short = {w: ids for w, ids in extra.items() if len(w) <= MEMO_CHARS}
            if len(known) + len(short) <= MEMO_ENTRIES:
                known.update(short)
                if len(short) == len(extra):
                    extra = {}
        if not extra:
            return [b"".join([known[w] for w in words]) for words in cut]
        return [b"".join([extra[w] if w in extra else known[w] for w in words]) for words in cut]

    @staticmethod
    def words(text: str) -> list[str]:
        """Words without their first marker, which all have."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def best(self, words: list[str]) -> list[bytes]:
        """The best path of each word, all words at once, a limited number of bytes at a time."""
        out: list[bytes] = []
        raw = [w.encode() for w in words]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        at = 0
        found = [b""] * len(raw)
        while at < len(order):
            end, held = at, 0
            while end < len(order) and (end == at or held + len(raw[order[end]]) <= 400_000):
                held += len(raw[order[end]])
                end += 1
            some = order[at:end]
            for i, ids in zip(some, self._paths([raw[i] for i in some])):
                found[i] = ids
            at = end
        out = found
        return out

    def _edges(self, data: np.ndarray, ends: np.ndarray):
        """All (start, end, piece) of pieces in the words, by walking the trie from every character."""
        v = self.v
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        node, pos, limit = np.zeros(len(starts), np.int32), starts.copy(), ends[starts]
        got = []
        origin = starts
        while len(pos):
            child = v.base[node] + data[pos]
            ok = v.check[child] == node
            origin, pos, node, limit = origin[ok], pos[ok] + 1, child[ok], limit[ok]
            leaf = v.base[node] + _END
            full = v.check[leaf] == node
            got.append((origin[full], pos[full], -(v.base[leaf[full]] + 1)))
            inside = pos < limit
            origin, pos, node, limit = origin[inside], pos[inside], node[inside], limit[inside]
        left, right, piece = (np.concatenate(x) if got else np.zeros(0, np.int64) for x in zip(*got))
        # Characters that are no piece by themselves get an edge of the unknown score.
        width = np.diff(np.append(starts, len(data)))
        alone = np.zeros(len(data), bool)
        alone[left[right - left == width[np.searchsorted(starts, left)]]] = True
        none = starts[~alone[starts]]
        after = none + width[np.searchsorted(starts, none)]
        return (np.concatenate([left, none]), np.concatenate([right, after]),
                np.concatenate([piece, np.full(len(none), -1)]).astype(np.int64))

    def _paths(self, raw: list[bytes]) -> list[bytes]:
        """Viterbi over all parts of words in step: the k-th step relaxes what starts at their k-th byte."""
        v = self.v
        lengths = np.array([len(r) for r in raw], np.int64)
        last_of_word = np.cumsum(lengths)
        data = np.frombuffer(b"".join(raw), np.uint8)
        left, right, piece = self._edges(data, np.repeat(last_of_word, lengths))
        # A word falls into parts where no piece crosses: a long one, as of a script without spaces, into many.
        crossing = np.bincount(left + 1, minlength=len(data) + 1) - np.bincount(right, minlength=len(data) + 1)
        whole = np.cumsum(crossing)[: len(data)] == 0
        whole &= (data & 0xC0) != 0x80
        whole[last_of_word - lengths] = True
        begins = np.flatnonzero(whole)
        stops = np.append(begins[1:], len(data))
        lengths = stops - begins
        word = np.repeat(np.arange(len(begins)), lengths)
        step = left - begins[word[left]]
        order = np.argsort(step, kind="stable")
        left, right, piece, step = left[order], right[order], piece[order], step[order]
        gain = np.where(piece >= 0, v.scores[piece], v.worst)
        # A place per byte end, and a part's begin is the place before its first byte; parts
        # lie one place apart so that their ends and begins differ.
        shift = word
        source, target = left + shift[left], right + shift[right - 1]
        best = np.full(len(data) + len(begins), -np.inf)
        best[begins + np.arange(len(begins))] = 0.0
        back = np.full(len(best), -1, np.int64)
        bounds = np.flatnonzero(np.diff(step)) + 1
        for a, b in zip(np.concatenate([[0], bounds]), np.append(bounds, len(step))):
            reached = best[source[a:b]] + gain[a:b]
            t = target[a:b]
            better = reached > best[t]
            best[t[better]] = reached[better]
            back[t[better]] = np.flatnonzero(better) + a
        # All parts' best paths from their ends back, one edge at a time.
        at, mine = stops + np.arange(len(begins)), np.arange(len(begins))
        path, owner = [], []
        first = begins + np.arange(len(begins))
        while len(mine):
            edge = back[at]
            path.append(edge)
            owner.append(mine)
            at = source[edge]
            going = at != first[mine]
            at, mine = at[going], mine[going]
        edges, owner = np.concatenate(path), np.concatenate(owner)
        order = np.lexsort((left[edges], owner))
        edges, owner = edges[order], owner[order]
        unknown = piece[edges] < 0
        count = np.where(unknown & (v.bytes is not None), right[edges] - left[edges], 1)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        flat = np.repeat(edges, count)
        spread = np.repeat(unknown, count)
        ids = np.where(spread, 0, v.ids[np.maximum(piece[flat], 0)])
        if v.bytes is None:
            ids = np.where(spread, v.unknown, ids)
        else:
            ids[spread] = v.bytes[data[(left[flat] + offset)[spread]]]
        per_part = np.cumsum(np.bincount(np.repeat(owner, count), minlength=len(begins)))
        bytes_, ends = ids.astype("<u4").tobytes(), per_part[np.searchsorted(stops, last_of_word)] * 4
        return [bytes_[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and ids, the pieces of the whole text with the largest sum of log scores.

    Characters outside the vocabulary become byte pieces (or the unknown id where it has
    none). A null text counts as empty and has no ids. Other columns are not read; repeated
    and null keys keep their rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def work():
        run = Encoder(shipped.value)

        def one(part):
            raw = run([t or "" for t in part.column("text").to_pylist()])
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)])
            values = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            return {"doc_id": part.column("doc_id"), "ids": ids}

        return one

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_slices(chosen, work, "doc_id long, ids array<int>")


class Decoder:
    """decode(ids) -> text: pieces joined, byte pieces as their bytes, markers as spaces."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts

    def __call__(self, ids: list[int]) -> str:
        plain = b"".join([self.texts[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return plain[1:] if plain[:1] == " " else plain


def _rows_of(column) -> list[list[int]]:
    flat, out, at = column.flatten().to_numpy(zero_copy_only=False), [], 0
    for n in column.value_lengths().to_pylist():
        out.append(flat[at : at + (n or 0)].tolist())
        at += n or 0
    return out


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: doc_id and the text of its ids.

    The marker that encoding put in front is taken away; bytes that are no UTF-8 become U+FFFD.
    Null ids count as none and give the empty text. A marker character in the original text
    comes back as a space, as in the format itself.
    """
    shipped = encoded.sparkSession.sparkContext.broadcast(vocabulary(path).texts)

    def work():
        text_of = Decoder(shipped.value)

        def one(part):
            return {"doc_id": part.column("doc_id"), "text": [text_of(ids) for ids in _rows_of(part.column("ids"))]}

        return one

    chosen = encoded.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return map_slices(chosen, work, "doc_id long, text string")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of encode(): doc_id, n_pieces, n_byte_pieces, ids_crc32 (ids as little-endian unsigned
    32-bit numbers), and n_chars and text_sha256 of the decoded text."""
    v = vocabulary(path)
    shipped = encoded.sparkSession.sparkContext.broadcast((v.texts, None if v.bytes is None else set(v.bytes.tolist())))

    def work():
        texts, bytes_ = shipped.value
        text_of = Decoder(texts)

        def one(part):
            rows = _rows_of(part.column("ids"))
            plain = [text_of(ids) for ids in rows]
            return {
                "doc_id": part.column("doc_id"),
                "n_pieces": [len(ids) for ids in rows],
                "n_byte_pieces": [sum(map(bytes_.__contains__, ids)) if bytes_ else 0 for ids in rows],
                "ids_crc32": [zlib.crc32(np.array(ids, "<u4").tobytes()) for ids in rows],
                "n_chars": [len(t) for t in plain],
                "text_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in plain],
            }

        return one

    return map_slices(
        encoded.select("doc_id", "ids"),
        work,
        "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, n_chars long, text_sha256 string",
    )
