"""Token ids of whole texts with a byte-level BPE file of ``tokenizers`` or ``tiktoken``.

The library's split pattern always cuts before a space that a visible
character follows, so a text is encoded as the chunks between such places.
Every distinct chunk is encoded by the library once while it is remembered;
ids of a block of texts are then gathered from one table.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable

import numpy as np

KNOWN = 400_000
#: fixed value: the special token of the vocabulary
SPECIAL = "<|endoftext|>"
CUT = re.compile(r" (?=\S)")


Encoder = Callable[[list[str]], list]


def _tokenizers(path: str) -> tuple[np.ndarray, Encoder]:
    """Bytes of every id and the encoder of a ``tokenizers`` file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    # pieces of a byte-level vocabulary have one character per byte
    sizes = np.array([len(library.id_to_token(i) or "") for i in range(library.get_vocab_size())], np.int64)
    return sizes, lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def _tiktoken(path: str) -> tuple[np.ndarray, Encoder]:
    """The same for a rank file; the special token that the file leaves out has the next id, as in the ``tokenizers`` file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    special = {SPECIAL: max(ranks.values()) + 1}
    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    sizes = np.zeros(len(ranks) + 1, np.int64)
    sizes[list(ranks.values())] = list(map(len, ranks))
    sizes[-1] = len(SPECIAL)
    return sizes, lambda texts: [library.encode_to_numpy(t, allowed_special="all") for t in texts]


class ChunkEncoder:
    def __init__(self, path: str, known: int = KNOWN):
        self.bytes, self.library = _tiktoken(path) if path.endswith(".tiktoken") else _tokenizers(path)
        self.most = known
        self.reset()

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.opens = np.zeros(0, bool)  # begins with white space after its own space
        self.closes = np.zeros(0, bool)  # ends with white space

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.code]
        if not new:
            return
        # chunks that begin with a space and a visible character can be encoded end to end
        odd = [c for c in new if c[:1] != " " or len(c) < 2 or c[1].isspace()]
        other = set(odd)
        plain = [c for c in new if c not in other] if odd else new
        new = plain + odd
        alone = self.library(odd)
        flat, sizes = self._together(plain)
        sizes = np.concatenate([sizes, np.fromiter(map(len, alone), np.int64, len(alone))])
        flat = np.concatenate([flat, *(np.array(x, np.int32) for x in alone)])
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, flat])
        self.opens = np.concatenate([self.opens, np.zeros(len(plain), bool), np.array([len(c) < 2 or c[1].isspace() for c in odd], bool)])
        self.closes = np.concatenate([self.closes, np.array([not c or c[-1].isspace() for c in new], bool)])

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of chunks from few long texts; places are found by the bytes that every id stands for."""
        texts = ["".join(chunks[i : i + 2000]) for i in range(0, len(chunks), 2000)]
        found = [np.array(ids, np.int32) for ids in self.library(texts)]
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)))
        at = np.searchsorted(np.cumsum(self.bytes[flat]), ends) + 1
        return flat, np.diff(at, prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the n + 1 places where texts begin."""
        if len(self.code) > self.most:
            self.reset()
        parts = [t.replace(" ", "\0 ").split("\0") if "\0" not in t else self._cut(t) for t in texts]
        self.learn(set().union(*parts))
        code = self.code
        codes = [np.fromiter(map(code.__getitem__, p), np.int64, len(p)) for p in parts]
        # a lone space between white space belongs to a longer run: cut such texts only where it is safe
        again = [i for i, c in enumerate(codes) if (self.closes[c[:-1]] & self.opens[c[1:]]).any()]
        for i in again:
            parts[i] = self._cut(texts[i])
        if again:
            self.learn({c for i in again for c in parts[i]})
            for i in again:
                codes[i] = np.array([code[c] for c in parts[i]], np.int64)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[flat] - ends + sizes, sizes) + np.arange(total)]
        per_text = np.cumsum([0, *map(len, codes)])
        return ids, np.concatenate(([0], ends))[per_text]

    @staticmethod
    def _cut(text: str) -> list[str]:
        first, *rest = CUT.split(text)
        return [first, *(" " + r for r in rest)]


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with an end id behind each."""
    return np.insert(ids, first[1:], end), first + np.arange(len(first))


def cut_pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of one document; of an overlong one only the first may be shorter than the capacity."""
    head = (length - 1) % capacity + 1 if length else 0
    return [(0, head), *((s, capacity) for s in range(head, length, capacity))]
