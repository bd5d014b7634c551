"""Keys that many holders share, found without a task that gets all rows of a frequent key.

Rows (key, holder) are dealt by the key and each run of a key is looked at. A key that many holders of
one slice have is hot: these holders know it already, so their rows are dealt by holder, and the task
says once, by a mark dealt by the key, that it is hot. Other slices' rows of that key learn it from the
mark. A run longer than a given number of rows is hot as well, and flows through unheld."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a row says: one holder of its key; one that has it twice; the key is hot; a holder of a hot key.
MEMBER, TWICE, MARK, KNOWN = range(4)
DEALT = "key long, holder long, state byte"
#: Rows that a hot key is said to have.
HOT_COUNT = 1 << 62


def opens(keys: np.ndarray) -> np.ndarray:
    """Whether each of some sorted keys is the first of its run."""
    return np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)


class Dealer:
    """Makes one task's rows of DEALT out of the keys and holders of its slices."""

    def __init__(self, hot_holders: int):
        self.hot_holders, self.said = hot_holders, np.zeros(0, np.int64)

    def rows(self, key: np.ndarray, holder: np.ndarray, tied: np.ndarray | None = None) -> pa.RecordBatch | None:
        """A holder that has a key twice, or has it tied, is a row of state TWICE."""
        if not len(key):
            return None
        order = np.lexsort((holder, key))
        k, h = key[order], holder[order]
        pair = np.flatnonzero(opens(k) | opens(h))
        twice = np.diff(np.append(pair, len(k))) > 1
        if tied is not None:
            twice |= np.maximum.reduceat(tied[order], pair)
        k, h = k[pair], h[pair]
        new = np.flatnonzero(opens(k))
        size = np.diff(np.append(new, len(k)))
        many = size >= self.hot_holders
        hot = np.repeat(many, size)
        marks = np.setdiff1d(k[new[many]], self.said)
        self.said = np.union1d(self.said, marks)
        none = np.zeros(len(marks), np.int64)
        state = np.concatenate([np.where(hot, KNOWN, np.where(twice, TWICE, MEMBER)), none + MARK]).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k, marks])), pa.array(np.concatenate([h, none])), pa.array(state)], ["key", "holder", "state"])


def repeated(batches: Iterator[pa.RecordBatch], across: bool, most: int) -> Iterator[pa.RecordBatch]:
    """key, holder, n (rows, HOT_COUNT of a hot key) from key, holder, state in order of (key, state falling): those of keys
    that several holders have, or (not across) one has twice."""
    held: list[np.ndarray] | None = None
    flowing: int | None = None  # the key of a run that is too long to hold

    def judged(k: np.ndarray, h: np.ndarray, state: np.ndarray, all_hot: bool) -> Iterator[pa.RecordBatch]:
        if not len(k):
            return
        first = np.flatnonzero(opens(k))
        size = np.diff(np.append(first, len(k)))
        hot = (np.maximum.reduceat(state, first) > TWICE) | (size > most) | all_hot
        hot[0] |= flowing is not None and k[0] == flowing
        member = state <= TWICE
        low = np.minimum.reduceat(np.where(member, h, np.iinfo(np.int64).max), first)
        high = np.maximum.reduceat(np.where(member, h, np.iinfo(np.int64).min), first)
        count = np.add.reduceat(member, first, dtype=np.int64)
        shared = hot | (low < high)
        if not across:
            shared |= np.maximum.reduceat(state, first) == TWICE
            shared |= count > 1
        keep = np.repeat(shared, size) & member | (state == KNOWN)
        if keep.any():
            n = np.repeat(np.where(hot, HOT_COUNT, count), size)
            yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(h[keep]), pa.array(n[keep])], ["key", "holder", "n"])

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
        if not len(columns[0]):
            continue
        if held:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))
        yield from judged(*[c[:cut] for c in columns], False)
        if flowing is not None and columns[0][cut] != flowing:
            flowing = None
        held = [c[cut:] for c in columns]
        if len(held[0]) > most or flowing is not None:
            flowing = int(held[0][0])
            yield from judged(*held, True)
            held = None
    if held:
        yield from judged(*held, False)


def repeated_keys(dealt: DataFrame, across: bool, most: int) -> DataFrame:
    """key, holder, n out of rows of DEALT."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.when(F.col("state") == KNOWN, F.xxhash64("holder")).otherwise(F.col("key"))
    ordered = dealt.repartition(parts, by).sortWithinPartitions("key", F.desc("state"))
    return ordered.mapInArrow(lambda batches: repeated(batches, across, most), "key long, holder long, n long")
