"""Repeats whatever their length, the rows' order and the columns' names."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.llm import _seeds, bcr, substring, suffix_dedup


def earlier_bytes(texts, length):
    """Bytes that a string of `length` bytes covers which also starts earlier."""
    seen, out = set(), []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            piece = t[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(piece)
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("length", [100, 255, 256, 300, 1000])
def test_repeats_of_any_length(spark, length):
    rng = random.Random(length)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, other = text(length + 100), text(length)
    texts = [text(50) + shared + text(30), text(20) + shared + text(40), shared[:-101] + "#" + other, other + other + shared[3 : length + 2], text(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs, length).collect()}
    assert got == dict(enumerate(earlier_bytes([t.encode() for t in texts], length))) and sum(map(len, got.values())) < sum(map(len, texts))


@pytest.mark.parametrize("rows", [50, bcr.BLOCK_ROWS])
def test_wide_common_prefixes_in_files(spark, rows, monkeypatch):
    monkeypatch.setattr(bcr, "BLOCK_ROWS", rows)
    monkeypatch.setattr(suffix_dedup, "suffix_blocks", lambda *a: bcr.suffix_blocks(*a, block_rows=rows))
    test_repeats_of_any_length(spark, 300)


@pytest.mark.parametrize("order", ["rising", "falling", "shuffled"])
def test_a_hot_span_is_sent_once_in_any_order(spark, order):
    passage = " ".join(f"p{i}" for i in range(13))
    rows = [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(2000)]
    rows = rows[::-1] if order == "falling" else random.Random(1).sample(rows, len(rows)) if order == "shuffled" else rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    how = _seeds.Units("words", 5, 13, hot=20)
    base = _seeds.base_rows(docs)
    found = _seeds.segments(base, _seeds.shared_anchors(docs, how, across=True), how, itself=False)
    sizes = [r["count"] for r in found.where("segment IS NOT NULL").groupBy("key").count().collect()]
    assert max(sizes) <= 40
    out = substring.remove_substrings(docs, hot=20) if "hot" in substring.remove_substrings.__code__.co_varnames else substring.remove_substrings(docs)
    left = {r.doc_id: r.n_removed for r in out.collect()}
    assert left[0] == 0 and all(left[i] == 13 for i in range(1, 2000))


def test_names_with_backticks(spark):
    odd = spark.createDataFrame([(1, "x " * 90, 5), (2, "x " * 90, 6)], "doc_id long, text string, `a``b` int").withColumn("c.d", F.lit(1))
    for out in (substring.remove_substrings(odd), suffix_dedup.remove_repeats(odd)):
        assert sorted(r.rest["a`b"] for r in out.collect()) == [5, 6]
