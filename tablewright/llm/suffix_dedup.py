"""Suffix-array dedup of byte strings, built column-wise for many documents.

A whole text would need as many rounds as its longest text has bytes, so the collection is
first cut by content: every `length`-byte string belongs to the segment of its winnowed
32-byte anchor, and equal strings always meet at one anchor. Anchors that occur once are dropped. The
distinct segments are the collection. Each is cut before its anchor: what is left of that are the
string's symbols, what follows is its end marker, and the markers are ordered by their bytes. Round by
round one symbol of each string enters the collection's Burrows-Wheeler transform and common
prefixes. Runs of suffixes that share `length` bytes are equal strings; all but the earliest
(smaller doc_id, or an earlier start in one document) are matches, and the bytes that they cover are
removed.

Null and empty texts have no bytes; rows with a null doc_id have no place in the order, so
they lose nothing and take nothing. Rows with one doc_id count as one document for the
order; of rows equal in id and text none removes the other. Texts of any length are cut whole, in one
task each. Extra columns, of whatever name, come back in the struct `rest`. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm._arrow import Texts, map_texts
from tablewright.llm._seeds import HOT, LOCALLY_HOT, Group, Units, base_rows, matched, removed_units, segments, shared_anchors, with_ranges, with_rest
from tablewright.llm.bcr import suffix_blocks

ANCHOR_BYTES = 32


def seeds_of(g: Group, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Class and place of all occurrences of each class's anchor in its segment."""
    own = g.offsets[:-1] + g.at
    of = np.repeat(np.arange(len(own)), np.diff(g.offsets) - k + 1)
    at = np.arange(len(of)) + (k - 1) * of
    for j in range(k):
        same = g.data[at + j] == g.data[own[of] + j]
        of, at = of[same], at[same]
    return of, at


def following(data: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the byte strings data[at : at + size], each of at most `width` bytes, and how much each shares with the one before."""
    reach = np.arange(width)
    whole = np.where(reach < size[:, None], data[np.minimum(at[:, None] + reach, len(data) - 1)], 0).astype(np.uint8)
    padded = np.zeros((len(at), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = whole
    order = np.lexsort((size, *padded.view(">u8").T[::-1]))
    whole, size = whole[order], size[order]
    differs = np.concatenate([whole[1:] != whole[:-1], np.ones((max(0, len(at) - 1), 1), bool)], axis=1)
    common = np.minimum(differs.argmax(axis=1), np.minimum(size[1:], size[:-1]))
    return order, np.concatenate([[0], common])[: len(at)]


def later_spans(g: Group, how: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each class, rows that come later than their class's first one, and spans of classes that occur earlier in another."""
    length, counts = how.span, np.diff(g.offsets) - how.span + 1
    place = np.concatenate([[0], np.cumsum(counts)])
    doc, begin = g.doc[g.head], g.begin[g.head]
    hit = np.zeros(place[-1], bool)
    of, at = seeds_of(g, how.k)
    size = np.minimum(g.offsets[of + 1] - at, length)
    order, common = following(g.data, at, size, length)
    of, at, size = of[order], at[order], size[order]
    left = np.minimum(at - g.offsets[of], length - how.k)
    kept = []
    for string, reach, shared in suffix_blocks(lambda strings, j: g.data[at[strings] - j - 1], left, common):
        some = np.flatnonzero(reach + size[string] >= length)
        # nothing shorter than length sorts between two suffixes that share length bytes
        kept.append((string[some], reach[some], shared[some] < length))
    string, reach, opens = (np.concatenate(x) for x in zip(*kept, strict=True))
    opens[:1] = True
    run = np.cumsum(opens) - 1
    start = at[string] - reach - g.offsets[of[string]]
    d, b = doc[of[string]], begin[of[string]] + start
    order = np.lexsort((b, d, run))
    first = np.concatenate([[True], np.diff(run[order]) != 0]) if len(order) else np.zeros(0, bool)
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    later = (d > d[leader]) | (b > b[leader])
    hit[place[of[string]][later] + start[later]] = True
    return counts, (g.doc > doc[g.of]) | (g.begin > begin[g.of]), hit


def remove_repeats(docs: DataFrame, length: int = 100, as_text: bool = False, hot: int = HOT, locally_hot: int = LOCALLY_HOT) -> DataFrame:
    """doc_id, kept (binary; as_text: string, without characters that were cut in two), n_bytes, n_removed, n_spans, rest (the other columns)."""
    how = Units("bytes", ANCHOR_BYTES, length, hot, locally_hot)
    base = base_rows(docs)

    found = segments(base, shared_anchors(docs, how, across=False), how, itself=True)
    ranges = matched(found, how, lambda g: later_spans(g, how))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column(2))
        gone = removed_units(batch, 4, texts.offsets, batch.column(1).to_numpy(zero_copy_only=False))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = texts.offsets[1:-1]
        inner = inner[inner < len(gone)]
        opens[inner] = gone[inner]
        kept = ~gone
        sizes = np.concatenate([[0], np.cumsum(texts.per_text(kept))])
        data = texts.data[kept].tobytes()
        cut = [data[a:b] for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]
        out = pa.array([x.decode("utf-8", "ignore") for x in cut]) if as_text else pa.array(cut, pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), out, pa.array(np.diff(texts.offsets)), pa.array(texts.per_text(gone)), pa.array(texts.per_text(opens)), batch.column(3)], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "rest"])

    wide = with_ranges(base, ranges)
    return map_texts(wide, keep, with_rest(f"doc_id long, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long", base))


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
