"""Vectorised text helpers for Arrow batches inside tasks: slicing, words, rolling hashes, sorted runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 19
BATCH_BYTES = 8 << 20
BLANK = 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(71)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def batch_conf(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a run of very long texts does not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all their bits are usable."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_R, pow(_R, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Of the bytes' random values times powers of the hash base: what hashes of spans are differences of."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power_tables(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def hash_spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    return mix((sums[end] - sums[start]) * _power_tables(len(sums))[1][start])


class Texts:
    """A column of texts as one byte array; nulls are empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column, "").cast(pa.large_string()) if not pa.types.is_large_string(column.type) else pc.fill_null(column, "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.n = len(column)
        self.offsets = offsets - offsets[0]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.raw = self.data
        if lower:
            self.data = _LOWER[self.data]
        self._sums: np.ndarray | None = None

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte spans [start, end): to find what may be equal, never to decide it."""
        if self._sums is None:
            self._sums = prefix_sums(self.data)
        return hash_spans(self._sums, start, end)

    def strong_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """XXH3 hashes of byte spans that do not overlap, computed once for each distinct one."""
        codes, known = distinct_spans(self.data, start, end)
        return np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[codes]

    def blank_joined(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words, each followed by a blank, and where each begins in that (and the last one ends)."""
        offsets = np.concatenate([[0], np.cumsum(end - start + 1)])
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[start] += 1
        inside[end] -= 1
        letter = np.ones(offsets[-1], bool)
        letter[offsets[1:] - 1] = False
        data = np.full(offsets[-1], BLANK, np.uint8)
        data[letter] = self.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        return data, offsets

    def words(self, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end of each word and the first word of each text (n + 1 numbers). gaps: for each byte, whether it parts words."""
        space = gaps[self.data]
        first, last = ~space, ~space
        if len(space):
            bounds = np.zeros(len(space) + 1, bool)
            bounds[self.offsets] = True
            first[1:] &= space[:-1] | bounds[1:-1]
            last[:-1] &= space[1:] | bounds[1:-1]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1, np.searchsorted(start, self.offsets)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def distinct_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes]]:
    """The number of each byte span among the distinct ones, and these. Spans are compared byte by byte. Without
    `end`, each span ends where the next one begins."""
    if not len(begin):
        return np.zeros(0, np.int64), []
    if end is None:
        offsets = np.append(begin, len(data))
    else:
        offsets = np.concatenate([[0], np.cumsum(end - begin)])
        inside = np.zeros(len(data) + 1, np.int8)
        inside[begin] += 1  # spans do not overlap
        inside[end] -= 1
        data = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    spans = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = spans.dictionary_encode()
    known = coded.dictionary
    cuts = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1].tolist()
    raw = known.buffers()[2].to_pybytes()
    return coded.indices.to_numpy(), [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs of numbers; -1 where the first is -1."""
    out = np.full(len(a), -1, np.int64)
    some = np.flatnonzero(a >= 0)
    if len(some):
        out[some] = pd.factorize(a[some] * (int(b[some].max()) + 1) + b[some])[0]
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of texts data[offsets[i]:offsets[i + 1]] with one blank between words (and maybe behind), equal for
    equal words only, and the first word of each text (n + 1 numbers)."""
    bound = np.zeros(len(data) + 1, bool)
    bound[offsets] = True
    blank = data == BLANK
    edge = np.concatenate([[True], blank])
    start = np.flatnonzero(~blank & (edge[:-1] | bound[:-1]))
    end = np.flatnonzero(~blank & (np.append(blank[1:], True) | bound[1:])) + 1
    return distinct_spans(data, start, end)[0].astype(np.int64), np.searchsorted(start, offsets)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive hashes; the caller leaves out windows that cross texts."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(_R) + hashes[j : j + n])
    return out


def minimizers(keys: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each w consecutive keys, the place of one of the smallest, and whether equal ones are near. Which
    key is chosen depends on the keys alone; of equal ones a choice is kept while it is inside, so that
    repetitive text has few."""
    n = len(keys)
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    bits = np.uint64(max(24, int(n).bit_length()))
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = (keys >> bits << bits) | np.arange(n, dtype=np.uint64)
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    value = keys[place]
    other = value[1:] != value[:-1]
    moved = np.flatnonzero(~other & (place[1:] != place[:-1]))
    tied = np.zeros(len(place), bool)
    if len(moved):
        begins = np.concatenate([[0], np.flatnonzero(other) + 1, [len(place)]])
        for run in np.unique(np.searchsorted(begins, moved, "right") - 1).tolist():
            at, stop = int(begins[run]), int(begins[run + 1])
            equal = np.unique(place[at:stop])
            tied[at:stop] = True
            while at < stop:
                chosen = int(equal[np.searchsorted(equal, at + w) - 1])
                place[at : min(chosen + 1, stop)] = chosen
                at = chosen + 1
    return place, tied


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most about limit bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 100_000]), limit)))
        yield batch.slice(at, end - at)
        at = end


def map_texts(frame: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, column: str = "text") -> DataFrame:
    """Apply work to slices of the frame's batches."""
    batch_conf(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return frame.mapInArrow(run, schema)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """From batches sorted by key, tables of about `rows` rows that never cut a run of one key."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).combine_chunks()
            keys = (keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            count = table.num_rows - cut
            if not cut:
                rows *= 2
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def numbers(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    column = table.column(name)
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)
