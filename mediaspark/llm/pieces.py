"""SentencePiece BPE encoding and decoding (13) in vectorised merge rounds.

A text is cut into pre-tokens before runs of spaces, and those once more
between two characters that stand side by side in no piece of the vocabulary:
no merge can cross such a place.  The distinct new words of a block of texts
lie end to end in one array of symbols.  Every round finds the best (lowest)
pair rank of each word, merges all its leftmost places at once and compacts
the arrays; a word without a pair left is done.

The library merges one pair after another, best score first, then leftmost.  A
round gives the same as long as a merge cannot make a pair of the same or a
better rank.  Pieces inside a piece of better rank are *uneven*: of those, a
round only merges places that have no other one within the reach of two
longest pieces before them; the others wait.  Words that are not done after
``ROUNDS`` rounds (long runs without a space) end in the library's own order,
by a queue of pairs.

Ids of known words are kept in a table of bounded size (characters, not
entries), so the memory of a task is bounded by one block of texts.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .counting import MARK, RUNS
from .names import with_made
from .words import blocks

ROUNDS = 48
KNOWN_CHARS = 6_000_000
NEVER = np.iinfo(np.int32).max
UNKNOWN_TEXT = " ⁇ "
#: strings on which a model's own encoding is compared when it is loaded
PROBES = ("", " ", "a", "  Two  words ", "ﬁ ½ Å Ａ", "tab\t\nline\0", f"{MARK}x", "xxxxxxxxx    漢字 <s> <0x0A>")

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", _each_byte)


class PieceModel:
    """Tables of a BPE model: symbols of characters, ranks of pairs, bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(size)]
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.control = np.array([model.is_control(i) for i in range(size)])
        byte_ids = [i for i in range(size) if model.is_byte(i)]
        self.byte_ids = np.full(256, -1, np.int64)
        self.byte_ids[[int(text[i][1:-1], 16) for i in byte_ids]] = byte_ids
        special = self.control | np.isin(np.arange(size), [model.unk_id(), *byte_ids])
        normal = {text[i]: i for i in np.flatnonzero(~special).tolist()}
        if (self.byte_ids < 0).any() or any(model.is_unused(i) for i in range(size)) or any(MARK in t.lstrip(MARK) for t in normal):
            raise ValueError("needs a BPE model with byte fallback, no unused piece and no space mark inside a piece")

        # symbols: ids of pieces, then characters that are only found inside pieces
        chars = sorted({c for t in normal for c in t})
        self.symbol = normal | {c: size + k for k, c in enumerate(c for c in chars if c not in normal)}
        self.size = size + len(self.symbol) - len(normal)
        self.rank = np.full(size, NEVER, np.int32)
        own = np.array(list(normal.values()))
        self.rank[own] = np.unique([-model.get_score(int(i)) for i in own], return_inverse=True)[1]
        self.longest = max(map(len, normal))
        self._pairs(normal)

        # characters: a dense number each, their symbol, and which two may be joined
        points = np.array([ord(c) for c in chars], np.int64)
        self.number = np.full(0x110000, len(chars), np.int32)
        self.number[points] = np.arange(len(chars))
        self.of_char = np.array([self.symbol[c] for c in chars] + [-1], np.int64)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for t in normal:
            k = self.number[[ord(c) for c in t]]
            self.joined[k[:-1], k[1:]] = True

        # bytes that each id stands for when decoded
        surface = [b"" if self.control[i] else UNKNOWN_TEXT.encode() if i == model.unk_id() else text[i].replace(MARK, " ").encode() for i in range(size)]
        for value, i in enumerate(self.byte_ids.tolist()):
            surface[i] = bytes([value])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.length = np.array(list(map(len, surface)), np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.opens = np.zeros(size, bool)  # a first piece with a space mark loses it
        self.opens[[i for t, i in normal.items() if t.startswith(MARK)]] = True
        for probe in PROBES:
            if WordIds(self).encode([probe])[0].tolist() != model.encode(probe):
                raise ValueError("the model changes texts before it encodes them")

    def _pairs(self, normal: dict[str, int]) -> None:
        known, keys, made, uneven = self.symbol, [], [], set()
        for t, i in normal.items():
            for k in range(1, len(t)):
                if t[:k] in known and t[k:] in known:
                    keys.append(known[t[:k]] * self.size + known[t[k:]])
                    made.append(i)
            # pieces inside this one that are not ranked before it
            uneven |= {
                j for a in range(len(t)) for b in range(a + 2, len(t) + 1) if b - a < len(t) and (j := normal.get(t[a:b])) is not None and self.rank[j] >= self.rank[i]
            }
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.uneven = np.zeros(len(self.rank), bool)
        self.uneven[list(uneven)] = True

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs of symbols make, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    # encoding

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (with their space marks) end to end and the n + 1 places where words begin."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(lengths) - lengths
        number = self.number[points]
        new = np.zeros(len(points), bool)
        new[first[lengths > 0]] = True
        new[1:] |= ~self.joined[number[:-1], number[1:]]
        symbol, place = self.rounds(self.of_char[number], np.cumsum(new))
        # characters outside the vocabulary are written as their bytes
        alone = np.flatnonzero((symbol < 0) | (symbol >= len(self.rank)))
        times = np.ones(len(symbol), np.int64)
        spelled = [chr(c).encode() for c in points[place[alone]].tolist()]
        times[alone] = list(map(len, spelled))
        ids = np.repeat(symbol, times)
        if len(alone):
            to = np.cumsum(times)[alone]
            where = np.repeat(to - np.cumsum(times[alone]), times[alone]) + np.arange(int(times[alone].sum()))
            ids[where] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, np.append(np.concatenate(([0], np.cumsum(times)))[np.searchsorted(place, first)], len(ids))

    def rounds(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of every word; the symbols that are left and the places of their first characters."""
        place = np.arange(len(symbol))
        done = [(symbol[:0], place[:0])]
        for _ in range(ROUNDS):
            if not len(symbol):
                break
            # rank of each symbol with the next one of its word
            made = np.full(len(symbol), -1)
            inside = np.flatnonzero(word[1:] == word[:-1])
            made[inside] = self.merged(symbol[inside], symbol[inside + 1])
            rank = np.where(made >= 0, self.rank[made], NEVER)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(rank, first)
            sizes = np.diff(first, append=len(word))
            low = np.repeat(low, sizes)
            live = low < NEVER
            hit = np.flatnonzero(live & (rank == low))
            hit = hit[self._at_once(hit, word[hit], place[hit], made[hit])]
            symbol[hit] = made[hit]
            stays = np.ones(len(symbol), bool)
            stays[hit + 1] = False
            if not live.all():
                ended = ~live
                done.append((symbol[ended], place[ended]))
                stays &= live
            symbol, word, place = symbol[stays], word[stays], place[stays]
        for a, b in zip(*(np.flatnonzero(np.diff(word, prepend=-1)), np.flatnonzero(np.diff(word, append=-1)) + 1), strict=True):
            done.append(self._by_queue(symbol[a:b].tolist(), place[a:b]))
        symbol, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        return symbol[order], place[order]

    def _at_once(self, hit: np.ndarray, word: np.ndarray, place: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Which of the places with the best rank of their word can be merged in one round."""
        same = np.zeros(len(hit), bool)
        same[1:] = word[1:] == word[:-1]
        # pairs that share a symbol: every second one of a run
        linked = same.copy()
        linked[1:] &= hit[1:] == hit[:-1] + 1
        at = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(linked, 0, at))
        fine = (at - run) % 2 == 0
        if self.uneven[made].any():
            odd = np.zeros(int(word[-1]) + 1, bool)
            odd[word[self.uneven[made]]] = True
            near = same.copy()
            near[1:] &= place[1:] - place[:-1] < 2 * self.longest
            fine &= ~(near & odd[word])
        return fine

    def _by_queue(self, symbol: list[int], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one word, pair after pair."""
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made = dict(zip(self.keys.tolist(), self.made.tolist(), strict=True)) if not hasattr(self, "table") else self.table
        self.table, rank, queue = made, self.rank, []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < n and symbol[a] >= 0 and symbol[b] >= 0 and (m := made.get(symbol[a] * self.size + symbol[b])) is not None:
                heapq.heappush(queue, (int(rank[m]), a, b, symbol[a], symbol[b], m))

        gone = [False] * n
        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, left, right, m = heapq.heappop(queue)
            if gone[a] or gone[b] or symbol[a] != left or symbol[b] != right or after[a] != b:
                continue
            symbol[a], gone[b], after[a] = m, True, after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        left = [i for i in range(n) if not gone[i]]
        return np.array([symbol[i] for i in left], np.int64), place[left]

    # decoding

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
        """UTF-8 of the texts of flat ids, end to end, and the n + 1 places where texts begin.

        ``first`` has the n + 1 places where the ids of each text begin.  Control ids are silent,
        the space mark of the first piece is dropped, bytes that are no UTF-8 become U+FFFD each.
        """
        length = self.length[ids]
        begin = self.start[ids]
        spoken = np.flatnonzero(length > 0)
        at = np.searchsorted(spoken, first[:-1])
        has = at < len(spoken)
        heads = spoken[at[has]]
        heads = heads[heads < first[1:][has]]
        heads = heads[self.opens[ids[heads]]]
        length[heads] -= 1
        begin[heads] += 1
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        data = self.surface[np.repeat(begin - ends + length, length) + np.arange(total)].tobytes()
        starts = np.concatenate(([0], ends))
        places = starts[first]
        silent = np.flatnonzero(self.control[ids])
        heard = np.flatnonzero(~self.control[ids])
        byte = np.isin(ids[heard], self.byte_ids)
        try:
            data.decode()
            if not (byte[:-1] & byte[1:] & (np.diff(heard) > 1)).any():
                return data, places
        except UnicodeDecodeError:
            pass
        # bytes on two sides of a control id do not make one character
        cuts = np.unique(np.concatenate((places, starts[silent])))
        parts = [data[a:b].decode(errors="each_byte").encode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        sizes = np.cumsum([0, *map(len, parts)])
        return b"".join(parts), sizes[np.searchsorted(cuts, places)]


class WordIds:
    """Encoder of texts that remembers the ids of words, up to ``most`` characters of words."""

    def __init__(self, model: PieceModel, most: int = KNOWN_CHARS):
        self.model, self.most = model, most
        self.reset()

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.chars = 0
        self.ids, self.sizes, self.starts = (np.zeros(0, np.int64) for _ in range(3))

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pre-tokens, each without the space mark that it starts with."""
        if "  " in text or MARK in text or text[:1] in ("", " ") or text[-1] == " ":
            return [t[1:] for t in RUNS.findall(MARK + text.replace(" ", MARK))] if text else []
        return text.split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the n + 1 places where texts begin."""
        if self.chars > self.most:
            self.reset()
        parts = [self.cut(t) for t in texts]
        code = self.code
        new = [w for w in set().union(*parts) if w not in code]
        if new:
            ids, at = self.model.words([MARK + w for w in new])
            code.update(zip(new, range(len(code), len(code) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + at[:-1]])
            self.sizes = np.concatenate([self.sizes, np.diff(at)])
            self.ids = np.concatenate([self.ids, ids])
            self.chars += sum(map(len, new)) + 8 * len(new)
        counts = np.cumsum([0, *map(len, parts)])
        flat = np.fromiter((code[w] for p in parts for w in p), np.int64, int(counts[-1]))
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[flat] - ends + sizes, sizes) + np.arange(total)]
        return ids, np.concatenate(([0], ends))[counts]


def framed(ids: np.ndarray, first: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with a begin id before and an end id behind each."""
    n = len(first) - 1
    out = np.empty(len(ids) + 2 * n, np.int64)
    places = first + 2 * np.arange(n + 1)
    out[places[:-1]], out[places[1:] - 1] = begin, end
    inner = np.ones(len(out), bool)
    inner[places[:-1]] = inner[places[1:] - 1] = False
    out[inner] = ids
    return out, places


def _texts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _encoded(batches: Iterator[pa.RecordBatch], text: int, path: str, ends: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, PieceModel]]:
    model = PieceModel(path)
    encoder = WordIds(model)
    for part, data, offsets in blocks(batches, text):
        ids, first = encoder.encode(_texts(data, offsets))
        yield part, *(framed(ids, first, model.begin, model.end) if ends else (ids, first)), model


def encode(docs: DataFrame, model_path: str, text: str = "text", ends: bool = True) -> DataFrame:
    """``docs`` with the ids of ``text`` in a new column ``ids`` (``ids_`` and so on where that name is taken).

    Null text is empty.  ``ends`` puts the begin id before and the end id behind.
    Rows are independent: repeated rows, null keys and clashing names pass through.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, first, _ in _encoded(batches, at, model_path, ends):
            made = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "made"])

    return with_made(docs, "ids", T.ArrayType(T.IntegerType()), run)


def decode(coded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``coded`` with the texts of its id lists in a new column ``decoded``.

    A null list gives null, an empty one an empty text; null ids inside a list are
    left out.  An id outside the vocabulary is an error.
    """
    at = coded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                part = whole.slice(k, 64)
                lists = [[i for i in x or () if i is not None] for x in part.column(at).to_pylist()]
                flat = np.array([i for x in lists for i in x], np.int64)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(model.length)):
                    raise ValueError("an id is outside the vocabulary")
                data, places = model.decode(flat, np.cumsum([0, *map(len, lists)]))
                texts = [None if x is None else data[a:b].decode() for x, a, b in zip(part.column(at).to_pylist(), places[:-1], places[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "made"])

    return with_made(coded, "decoded", T.StringType(), run)


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded with both end ids, then decoded.

    Null texts are empty (two ids), a null doc_id stays null, repeated rows give
    a row each, other columns are not used.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, first, model in _encoded(batches, 1, model_path, True):
            data, places = model.decode(ids, first)
            raw, view = memoryview(ids.astype("<u4").tobytes()), memoryview(data)
            cuts, ends = (4 * first).tolist(), places.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(first)),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string()),
                    pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)
