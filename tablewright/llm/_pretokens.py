"""Pre-tokens of byte-level BPE as spans, and a cache of their ids.

Texts of characters below 256 are cut with array operations; any other text, and one that
holds a special token, goes through the pattern itself. A pre-token is known by its bytes, never
by a hash alone; each Python worker keeps the ids of those it has met."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tablewright.llm._arrow import Texts, distinct_spans

CACHED_WORDS = 1_000_000
OTHER, LETTER, NUMBER, SPACE = range(4)


def latin_classes() -> np.ndarray:
    """The class of each character below 256."""
    out = np.zeros(256, np.uint8)
    for code in range(256):
        c = chr(code)
        out[code] = LETTER if c.isalpha() else NUMBER if c.isnumeric() else SPACE if c.isspace() and not 0x1C <= code <= 0x1F else OTHER
    return out


_CLASS = latin_classes()
_ONE = np.zeros(256, bool)
_ONE[list(b"stmd")] = True


def latin_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the pre-tokens of UTF-8 texts with characters below 256."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].copy()
    wide = np.flatnonzero(code >= 0x80)
    code[wide] = ((code[wide] & 3) << 6) | (data[at[wide] + 1] & 0x3F)
    kind = _CLASS[code]
    n = len(at)
    opens = np.zeros(n + 1, bool)  # at the first character of a text
    opens[np.searchsorted(at, offsets[(offsets < len(data))])] = True
    opens[n] = True
    differs = opens[:-1].copy()
    differs[1:] |= kind[1:] != kind[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (code[:-1] == 32) & ~opens[1:-1]
    space = kind == SPACE
    last = np.zeros(n, bool)
    last[:-1] = ~space[1:] & ~opens[1:-1]
    start = np.where(space, differs | last, differs & ~after_blank)
    quote = np.flatnonzero((code == 39) & start)
    follows = lambda k: np.where((quote + k < n) & ~opens[np.minimum(quote + 1, n)] & ~opens[np.minimum(quote + k, n)], code[np.minimum(quote + k, n - 1)], 0)
    one, two = follows(1), follows(2)
    short = _ONE[one]
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[quote[short | long] + 1] = False
    rest = np.concatenate([quote[short] + 2, quote[long] + 3])
    rest = rest[rest < n]
    start[rest[kind[rest] == LETTER]] = True
    begin = at[start]
    return begin, np.append(begin[1:], len(data))


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    def values(self) -> np.ndarray:
        return self.held[: self.n]


class IdCache:
    """Ids of pre-tokens by their bytes; `learn` encodes distinct new ones."""

    def __init__(self, pretokens: Callable[[str], list[str]], special: dict[str, int], cut, learn: Callable[[list[bytes]], list[tuple[int, ...]]]):
        self.pretokens, self.special, self.cut, self.learn = pretokens, special, cut, learn
        self.marks = [s.encode() for s in special]
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}  # of each pre-token in the tables below
        self.ids, self.first, self.size = Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def slow(self, text: str) -> list[str]:
        if self.cut is None:
            return self.pretokens(text)
        return [w for k, piece in enumerate(self.cut.split(text)) for w in ([piece] if k % 2 else self.pretokens(piece))]

    def spans(self, texts: Texts) -> np.ndarray:
        """Where the pre-tokens begin; each one ends where the next one begins."""
        whole = texts.data.tobytes()
        odd = texts.per_text(texts.data >= 0xC4) > 0
        if any(m in whole for m in self.marks):
            odd |= np.array([any(m in whole[a:b] for m in self.marks) for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)])
        begin = latin_spans(texts.data, texts.offsets)[0]
        if not odd.any():
            return begin
        kept = [begin[~odd[np.searchsorted(texts.offsets, begin, "right") - 1]]]
        for i in np.flatnonzero(odd).tolist():
            a, b = int(texts.offsets[i]), int(texts.offsets[i + 1])
            sizes = [len(w.encode()) for w in self.slow(whole[a:b].decode()) if w]
            kept.append(a + np.cumsum([0, *sizes])[:-1])
        return np.sort(np.concatenate(kept))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and the first of each text (n + 1 numbers)."""
        texts = Texts(column)
        begin = self.spans(texts)
        codes, words = distinct_spans(texts.data, begin)
        place = self.places(words)
        size = self.size.values()[place][codes]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids.values()[np.repeat(self.first.values()[place][codes] - upto[:-1], size) + np.arange(upto[-1])]
        return flat, upto[np.searchsorted(begin, texts.offsets)]

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where the ids of each distinct pre-token lie; learns what is new."""
        if len(self.place) > CACHED_WORDS:
            self.clear()
        get = self.place.get
        place = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            new = [words[k] for k in fresh.tolist()]
            made = self.learn(new)
            size = np.fromiter(map(len, made), np.int64, len(made))
            place[fresh] = self.size.n + np.arange(len(new))
            self.place.update(zip(new, place[fresh].tolist(), strict=True))
            self.first.add(self.ids.n + np.cumsum(size) - size)
            self.size.add(size)
            self.ids.add(np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(size.sum())))
        return place
