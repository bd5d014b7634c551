"""Substring dedup by seed and extend.

Documents are joined on winnowed anchors (5-grams of words, one for each 13 words): these are the
seeds. From each seed the match with other documents is extended word by word to the right
and to the left over the words around it; occurrences that agree so far share a number, and one
that is alone goes no further. Where both extensions together reach `span` words and a document of a
smaller id agrees, there is a match; matches that overlap make up the maximal repeats, whose
words are removed. Words are compared as such, not by hashes.

Null and empty texts have no words; rows with a null doc_id have no place in the order, so
they lose nothing and take nothing. Rows with one doc_id never match each other: neither is
smaller. Texts of any length are handled whole, in one task each. An empty table gives an empty
result. Extra columns, of whatever name, come back in the struct `rest`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm._arrow import Texts, map_texts, paired, words_of
from tablewright.llm._seeds import HOT, LOCALLY_HOT, Group, Units, base_rows, matched, removed_units, segments, shared_anchors, with_ranges, with_rest

ANCHOR_WORDS = 5


def together(label: np.ndarray) -> np.ndarray:
    """-1 where a number occurs once."""
    some = np.flatnonzero(label >= 0)
    alone = np.bincount(label[some])[label[some]] == 1
    label[some[alone]] = -1
    return label


def seeds_of(g: Group, words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and place of all occurrences of each class's anchor in its segment, and numbers of the anchors."""
    own = first[:-1] + g.at
    label = words[own]
    for j in range(1, k):
        label = paired(label, words[own + j])
    of = np.repeat(np.arange(len(own)), np.diff(first) - k + 1)
    at = np.arange(len(of)) + (k - 1) * of
    for j in range(k):
        same = words[at + j] == words[own[of] + j]
        of, at = of[same], at[same]
    return of, at, pd.factorize(label[of])[0].astype(np.int64)


def extended(g: Group, how: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each class, rows that lie in a class of a smaller document, and spans of classes that a smaller document has too."""
    words, first = words_of(g.data, g.offsets)
    counts = np.diff(first) - how.span + 1
    place = np.concatenate([[0], np.cumsum(counts)])
    doc = g.doc[g.head]
    hit = np.zeros(place[-1], bool)

    of, at, label = seeds_of(g, words, first, how.k)
    reach = how.span - how.k
    right, left = [together(label)], [together(label)]
    for j in range(reach):
        behind, before = at + how.k + j, at - j - 1
        for side, word, inside in ((right, behind, behind < first[of + 1]), (left, before, before >= first[of])):
            side.append(together(paired(np.where(inside, side[-1], -1), words[np.clip(word, 0, len(words) - 1)])))
    for j in range(reach + 1):
        both = paired(np.where(right[reach - j] >= 0, left[j], -1), right[reach - j])
        some = np.flatnonzero(both >= 0)
        owner = np.full(len(some) + 1, np.iinfo(np.int64).max)
        np.minimum.at(owner, both[some], doc[of[some]])
        some = some[owner[both[some]] < doc[of[some]]]
        hit[place[of[some]] + at[some] - j - first[of[some]]] = True
    return counts, g.doc > doc[g.of], hit


def remove_substrings(docs: DataFrame, span: int = 13, hot: int = HOT, locally_hot: int = LOCALLY_HOT) -> DataFrame:
    """doc_id, text (kept words, joined by one space), n_words, n_removed, rest (the other columns)."""
    how = Units("words", ANCHOR_WORDS, span, hot, locally_hot)
    base = base_rows(docs)

    found = segments(base, shared_anchors(docs, how, across=True), how, itself=False)
    ranges = matched(found, how, lambda g: extended(g, how))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        start, _, first = Texts(batch.column(2)).words()
        gone = removed_units(batch, 4, first, batch.column(1).to_numpy(zero_copy_only=False))
        sums = np.concatenate([[0], np.cumsum(gone)])
        kept = []
        for i, text in enumerate(batch.column(2).to_pylist()):
            words = (text or "").encode().split()
            part = gone[first[i] : first[i + 1]]
            kept.append(b" ".join([w for w, g in zip(words, part.tolist(), strict=True) if not g] if part.any() else words).decode())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept), pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]]), batch.column(3)], ["doc_id", "text", "n_words", "n_removed", "rest"])

    wide = with_ranges(base, ranges)
    return map_texts(wide, keep, with_rest("doc_id long, text string, n_words long, n_removed long", base))


def substring_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove_substrings(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
