"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many short strings.

The collection's strings grow to the left by one symbol a round. Round j puts what string i reads
from its j-th symbol before its end marker into the sorted list of all shorter suffixes: its place
follows from the place of the suffix it extends, by counting symbols of the transform before it,
and its common prefixes with its two neighbours from range minima over the common prefixes so
far. End markers are in a given order and have given common prefixes, as if each stood for a text
that follows it.

The columns (transform, common prefix, suffix) are read and written once a round each, front to
back and block by block; beyond `block_rows` rows they are external files, of which two blocks at a
time are in memory. What is kept for each string are its place and its symbol."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np

BLOCK_ROWS = 1 << 22
#: Symbol of a string that has ended. UTF-8 has no such byte.
START = 255
COLUMNS = {"symbol": np.uint8, "common": np.uint64, "suffix": np.int64}
FAR = 1 << 62  # over every common prefix


class Columns:
    """The columns of the sorted suffixes: arrays, or sequential files where they have more than block_rows rows. longest: the largest
    common prefix there may be, which decides its column's width."""

    def __init__(self, folder: str, block_rows: int, longest: int, **first: np.ndarray):
        self.folder, self.block_rows, self.turn = Path(folder), block_rows, 0
        self.kinds = COLUMNS | {"common": np.min_scalar_type(longest)}
        self.put([{name: first[name].astype(kind) for name, kind in self.kinds.items()}], len(first["symbol"]))

    def put(self, blocks: Iterator[dict[str, np.ndarray]], rows: int) -> None:
        """Replace the columns by blocks that may be made from the old ones as they are read."""
        if rows <= self.block_rows:
            parts = list(blocks)
            self.held = parts[0] if len(parts) == 1 else {name: np.concatenate([p[name] for p in parts]) for name in COLUMNS}
        else:
            files = {name: (self.folder / f"{name}-{self.turn + 1}").open("wb") for name in COLUMNS}
            for block in blocks:
                for name, file in files.items():
                    block[name].tofile(file)
            for file in files.values():
                file.close()
            self.held = None
        for name in COLUMNS:
            (self.folder / f"{name}-{self.turn}").unlink(missing_ok=True)
        self.turn, self.rows = self.turn + 1, rows

    def blocks(self) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        """First row and columns of each block, front to back."""
        if self.held is not None:
            yield 0, self.held
            return
        files = {name: (self.folder / f"{name}-{self.turn}").open("rb") for name in COLUMNS}
        for start in range(0, self.rows, self.block_rows):
            yield start, {name: np.fromfile(file, self.kinds[name], self.block_rows) for name, file in files.items()}
        for file in files.values():
            file.close()


def range_minima(values: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """min(values[after + 1 : upto + 1]) for each pair, after < upto."""
    order = np.argsort(-after, kind="stable")  # falling, so that what lies between two ranges is not read
    bounds = np.empty(2 * len(after), np.int64)
    bounds[0::2], bounds[1::2] = after[order] + 1, upto[order] + 1
    out = np.empty(len(after), np.int64)
    out[order] = np.minimum.reduceat(np.append(values, values.dtype.type(0)), bounds)[::2] if len(after) else 0
    return out


def symbol_ranks(order: np.ndarray, bounds: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where the places `at` with symbols `own` lie in `order`, which lists each symbol's places (from bounds[symbol] on)."""
    out = np.empty(len(at), np.int64)
    grouped = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[grouped], np.arange(257))
    for c in np.flatnonzero(np.diff(cuts)).tolist():
        mine = grouped[cuts[c] : cuts[c + 1]]
        out[mine] = bounds[c] + np.searchsorted(order[bounds[c] : bounds[c + 1]], at[mine])
    return out


def counted(columns: Columns, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One pass over transform and common prefixes: how often each symbol stands before the places `at` (rising, with symbols
    `own`), common prefixes of what will stand there with what comes before and behind it, and each symbol's total."""
    rank, before, behind = (np.zeros(len(at), np.int64) for _ in range(3))
    total = np.zeros(256, np.int64)
    low = np.full(256, FAR, np.int64)  # least common prefix since a symbol's last occurrence
    last = np.full(256, -1, np.int64)  # which of `at` that occurrence is
    for start, block in columns.blocks():
        symbol, common = block["symbol"], block["common"]
        a, b = np.searchsorted(at, [start, start + len(symbol)])
        place, mine = at[a:b] - start, own[a:b].astype(np.int64)
        order = np.argsort(symbol, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(symbol, minlength=256))])
        k = symbol_ranks(order, bounds, place, own[a:b])
        rank[a:b] = total[mine] + k - bounds[mine]
        inner = np.flatnonzero(k > bounds[mine])
        before[a + inner] = 1 + range_minima(common, order[k[inner] - 1], place[inner])
        inner = np.flatnonzero(k + 1 < bounds[mine + 1])
        behind[a + inner] = 1 + range_minima(common, place[inner], order[k[inner] + 1])
        if len(symbol) < columns.rows:
            there = np.flatnonzero(np.diff(bounds))
            head, tail = order[bounds[there]], order[bounds[there + 1] - 1]
            least = np.minimum.accumulate(common)
            linked = total[there] > 0
            value = 1 + np.minimum(low[there], least[head])
            some = linked & (last[there] >= 0)
            behind[last[there[some]]] = value[some]
            at_head = np.searchsorted(place, head)
            some = linked & (at_head < len(place)) & (place[np.minimum(at_head, len(place) - 1)] == head) if len(place) else np.zeros(len(there), bool)
            before[a + at_head[some]] = value[some]
            low = np.minimum(low, int(least[-1]))
            ahead = np.append(np.minimum.accumulate(common[::-1])[::-1].astype(np.int64), FAR)
            low[there] = ahead[tail + 1]
            at_tail = np.searchsorted(place, tail)
            is_at = (at_tail < len(place)) & (place[np.minimum(at_tail, len(place) - 1)] == tail) if len(place) else np.zeros(len(there), bool)
            last[there] = np.where(is_at, a + at_tail, -1)
        total += np.diff(bounds)
    return rank, before, behind, total


def merged(columns: Columns, at: np.ndarray, fresh: dict[str, np.ndarray], behind: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """The columns' blocks with rows put in at places `at` (rising) of the new list; behind: the common prefix of what follows each."""
    old_place = at - np.arange(len(at))
    done = 0
    for start, block in columns.blocks():
        end = start + len(block["symbol"])
        upto = len(at) if end == columns.rows else int(np.searchsorted(old_place, end, "left"))
        own = np.arange(done, upto)
        inside = old_place[own] - start + np.arange(len(own))
        kept = np.ones(end - start + len(own), bool)
        kept[inside] = False
        out = {}
        for name, values in block.items():
            out[name] = np.empty(len(kept), values.dtype)
            out[name][kept] = values
            out[name][inside] = fresh[name][own]
        first = start + done  # new place of the block's first row
        low, high = np.searchsorted(at + 1, [first, first + len(kept)])
        out["common"][at[low:high] + 1 - first] = behind[low:high]
        yield out
        done = upto


def sorted_suffixes(symbol_before: Callable[[np.ndarray, int], np.ndarray], length: np.ndarray, marker_common: np.ndarray, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All blocks of `suffix_blocks` at once."""
    return tuple(np.concatenate(x) for x in zip(*suffix_blocks(symbol_before, length, marker_common, block_rows), strict=True))


def suffix_blocks(symbol_before: Callable[[np.ndarray, int], np.ndarray], length: np.ndarray, marker_common: np.ndarray, block_rows: int = BLOCK_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """String, symbols before the end marker, and common prefix with the one before, of all suffixes in sorted order, block by block.

    Strings are numbered in the order of their end markers, which come before all symbols; length: of each string;
    marker_common: common prefixes of the markers with the one before. symbol_before(strings, j) gives the symbol that
    stands before the last j of each string. A string whose suffix shares less than its own symbols with
    both neighbours cannot share more later, and ends there."""
    count = len(length)
    width = int(length.max(initial=0)) + 1
    with tempfile.TemporaryDirectory() as folder:
        active = np.flatnonzero(length > 0)
        symbol = np.full(count, START, np.uint8)
        symbol[active] = symbol_before(active, 0)
        columns = Columns(folder, block_rows, int(marker_common.max(initial=0)) + width + 1, symbol=symbol, common=marker_common, suffix=np.arange(count) * width)
        at, own = active.copy(), symbol[active]
        for j in range(1, width):
            rank, before, behind, total = counted(columns, at, own)
            at = count + (np.cumsum(total) - total)[own] + rank
            order = np.argsort(at, kind="stable")
            active, at, before, behind = active[order], at[order], before[order], behind[order]
            grows = (length[active] > j) & (np.maximum(before, behind) >= j)
            own = np.full(len(active), START, np.uint8)
            own[grows] = symbol_before(active[grows], j)
            fresh = {"symbol": own, "common": before, "suffix": active * width + j}
            columns.put(merged(columns, at, fresh, behind), columns.rows + len(at))
            active, at, own = active[grows], at[grows], own[grows]
            if not len(active):
                break
        for _, block in columns.blocks():
            yield block["suffix"] // width, block["suffix"] % width, block["common"].astype(np.int64)
