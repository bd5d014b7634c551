"""Quality rules: repetition measured on a suffix array of each text's words.

Longest-common-prefix intervals of at least `min_repeat` words are the maximal repeated
substrings; the union of their spans gives the covered words, the deepest interval the
longest repeat. A text is kept when the base rules pass, its covered share of characters is
at most `max_covered` and its longest repeat is at most `max_longest` words or
`max_longest_share` of its words.

Words and lines are compared by their bytes. Null, empty and blank texts have no words and fail
the base rules. Texts of any length are judged whole, each in one task. Repeated rows, equal and null
ids are judged row by row, so there are no ties. An empty table gives an empty result. Extra columns
pass through `quality_filter`; `quality_rules` returns only the id and its measures, so their
names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm._arrow import Texts, distinct_spans, map_texts

MIN_WORDS = 20
BASE_REPEAT_PERCENT = 30
WINDOW = 8

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_chars long, longest_repeat long, base_failed boolean, kept boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_ranks(words: np.ndarray, text_end: np.ndarray) -> list[np.ndarray]:
    """Prefix doubling: ranks of all suffixes by their first 1, 2, 4, ... words; the last ranks are
    the suffix array's inverse. words: equal numbers for equal words of one text, and texts apart;
    text_end: for each word, where its text ends."""
    order = np.argsort(words, kind="stable")
    opens = np.concatenate([[True], np.diff(words[order]) != 0]) if len(words) else np.zeros(0, bool)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(len(words)), 0))
    levels, reach = [rank], 1
    tied = np.sort(order[~(opens & np.append(opens[1:], True))]) if len(words) else order
    while len(tied):
        after = tied + reach
        second = np.where(after < text_end[tied], rank[np.minimum(after, len(rank) - 1)] + 1, 0)
        key = rank[tied] * np.int64(len(rank) + 1) + second
        order = np.argsort(key, kind="stable")
        tied, key, old = tied[order], key[order], rank[tied[order]]
        place = np.arange(len(tied))
        outer = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(old) != 0]), place, 0))
        opens = np.concatenate([[True], np.diff(key) != 0])
        inner = np.maximum.accumulate(np.where(opens, place, 0))
        rank = rank.copy()
        rank[tied] = old + inner - outer
        levels.append(rank)
        tied = np.sort(tied[~(opens & np.append(opens[1:], True))])
        reach *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], text_end: np.ndarray, least: int) -> np.ndarray:
    """For each suffix, the words it shares with the nearer of its neighbours in the suffix array; 0 below `least`."""
    n = len(levels[0])
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    step = int(least).bit_length() - 1
    if step >= len(levels):
        return np.zeros(n, np.int64)
    left, right = order[:-1], order[1:]
    some = levels[step][left] == levels[step][right]
    left, right = left[some], right[some]
    i, j, length = left.copy(), right.copy(), np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (i < text_end[left]) & (j < text_end[right])
        ranks = levels[level]
        equal = inside & (ranks[np.minimum(i, n - 1)] == ranks[np.minimum(j, n - 1)])
        i[equal] += 1 << level
        j[equal] += 1 << level
        length[equal] += 1 << level
    length[length < least] = 0
    out = np.zeros(n, np.int64)
    np.maximum.at(out, left, length)
    np.maximum.at(out, right, length)
    return out


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which words lie in a span [i, i + lengths[i])."""
    marks = np.zeros(len(lengths) + 1, np.int64)
    at = np.flatnonzero(lengths)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + lengths[at], -1)
    return np.cumsum(marks[:-1]) > 0


def measure(column: pa.Array, min_repeat: int, max_covered: float, max_longest: int, max_longest_share: float) -> dict[str, np.ndarray]:
    texts = Texts(column)
    start, end, first = texts.words()
    n_words = np.diff(first)
    owner = np.repeat(np.arange(texts.n), n_words)
    code_points = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=code_points[1:])
    chars = code_points[end] - code_points[start]

    text_end = np.repeat(first[1:], n_words)
    ids = distinct_spans(texts.data, start, end)[0].astype(np.int64)
    levels = suffix_ranks(owner * np.int64(len(ids) + 1) + ids, text_end)
    shared = common_prefixes(levels, text_end, min(min_repeat, WINDOW))
    per_text = lambda x: np.bincount(owner, x, texts.n).astype(np.int64)
    window_words = covered(np.where(shared >= WINDOW, shared, 0))
    spans = np.where(shared >= min_repeat, shared, 0)
    longest = np.zeros(texts.n, np.int64)
    np.maximum.at(longest, owner, spans)

    breaks = np.flatnonzero(texts.data == 10)
    line_start = np.unique(np.concatenate([texts.offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(texts.data)]
    line_end = np.minimum(np.append(line_start[1:], len(texts.data)), len(texts.data))
    line_end = line_end - (texts.data[line_end - 1] == 10) if len(line_end) else line_end
    with_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[with_word], line_end[with_word]
    line_owner = np.searchsorted(texts.offsets, line_start, "right") - 1
    line = distinct_spans(texts.data, line_start, line_end)[0]
    order = np.lexsort((line, line_owner))
    equal = (np.diff(line_owner[order]) == 0) & (np.diff(line[order]) == 0)

    out = {"n_words": n_words, "word_chars": per_text(chars), "n_symbols": texts.per_text(_SYMBOL[texts.data]), "n_dup_lines": np.bincount(line_owner[order][1:][equal], minlength=texts.n), "n_repeat_words": per_text(window_words), "covered_chars": per_text(chars * covered(spans)), "longest_repeat": longest}
    out = {k: v.astype(np.int64) for k, v in out.items()}
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["covered_chars"] <= max_covered * out["word_chars"]) & (longest <= np.maximum(max_longest, max_longest_share * out["n_words"]))
    return out


def quality_rules(docs: DataFrame, min_repeat: int = 8, max_covered: float = 0.30, max_longest: int = 200, max_longest_share: float = 0.25) -> DataFrame:
    """doc_id with n_words, the base measures, covered_chars, longest_repeat, base_failed and kept of every whole text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = measure(batch.column(1), min_repeat, max_covered, max_longest, max_longest_share)
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.values())], ["doc_id", *out])

    return map_texts(docs.select("doc_id", "text"), work, f"doc_id {dict(docs.dtypes)['doc_id']}, {MEASURES}")


def quality_filter(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that the rules keep, all columns unchanged."""
    limits = {"min_repeat": 8, "max_covered": 0.30, "max_longest": 200, "max_longest_share": 0.25} | limits

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = measure(batch.column(batch.schema.get_field_index("text")), **limits)["kept"]
        return batch.filter(pa.array(kept))

    return map_texts(docs, work, docs.schema)
