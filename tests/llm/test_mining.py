"""Toxicity, hard negatives and ranked search, against brute force and held-out labels."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.llm import hard_negatives as hn
from tablewright.llm import lexical_search as ls
from tablewright.llm import toxicity as tx

INF, NAN = float("inf"), float("nan")
BAD = ["grubby", "vilest", "scoundrel", "dimwit"]


def brute_negatives(rows, every, positives=5, negatives=10):
    sound = {}
    for i, label, v in sorted((r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[1], [math.floor(256 * x) for x in r[2]])):
        sound.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = set()
    for a, (label, v) in sound.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), b, other) for b, (other, w) in sound.items() if b != a)
        for p, b, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p]
            out |= {(a, b, k, c, -p, -s) for k, (s, c, _) in enumerate(fit[:negatives], 1)}
    return out


@pytest.mark.parametrize("kind", ["plain", "ties", "large"])
def test_hard_negatives_against_brute_force(spark, kind, monkeypatch):
    rng = random.Random(kind)
    size = {"plain": 1.0, "ties": 0.01, "large": 3e6}[kind]
    monkeypatch.setattr(hn, "ANCHORS", 3)
    rows = [(i, rng.randrange(3), [rng.uniform(-size, size) for _ in range(6)]) for i in range(240)]
    rows += [(i, 1, rows[10][2]) for i in range(300, 340)]  # many of one score
    rows += [(20, rows[20][1], rows[20][2]), (20, 0, [0.5] * 6), (None, 1, [1.0] * 6), (400, None, [1.0] * 6), (410, 1, None), (420, 1, [1.0, None, 1.0]), (430, 1, [INF] * 6), (440, 1, [NAN] * 6), (450, 2, []), (460, 2, [size, size])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    rows = [tuple(r) for r in frame.collect()]
    found = hn.hard_negatives(frame.withColumn("rank", F.lit(1)).withColumn("a`b", F.lit(1)), F.col("vec_id") % 10 == 0)
    got = [tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows, 10)
    assert hn.hard_negatives(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(frame, F.col("vec_id") == 7_777).count() == 0


def test_hard_negatives_shuffled_pairs(spark, monkeypatch):
    from tablewright.llm import _pairs

    monkeypatch.setattr(_pairs, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(hn, "ANCHORS", 4)
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), [rng.gauss(0, 1) for _ in range(4)]) for i in range(150)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert {tuple(r) for r in hn.hard_negatives(frame, F.col("vec_id") % 10 == 0).collect()} == brute_negatives(rows, 10)


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_search(docs, items, k=20):
    cut = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(cut), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, []).extend(terms(t))
    out = []
    for item, asked in queries.items():
        scored = []
        for i, c in cut:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shuffled", [False, True])
def test_search_against_brute_force(spark, shuffled, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["Straße", "ñandú", "中文", "x_y", "it's", "É"]
    text = lambda n: " ".join(rng.choice(words[: rng.randrange(2, len(words))]).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(400)] + [(i, "w1 w1 w2") for i in range(500, 560)] + [(7, "w3 w3"), (7, "w3 w3"), (None, "w4"), (600, None), (601, ""), (602, " ,; "), (603, "w5 " * 20_000), (604, "\u0000w6\u0001")]
    items = [(i, text(rng.randrange(1, 12))) for i in range(9)] + [(100, "w1 " * 9 + "w2"), (101, None), (102, ""), (103, "nowhere"), (104, "w3"), (104, "w3 w1"), (None, "w2"), (105, "Straße É x_y's 中文")]
    monkeypatch.setattr(ls, "BLOCK", 64)
    monkeypatch.setattr(ls, "ITEMS", 5)
    if shuffled:
        monkeypatch.setattr(ls, "small", lambda frame, size: frame)
        from tablewright.llm import _pairs

        monkeypatch.setattr(_pairs, "BROADCAST_BYTES", -1)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("n", F.lit("x")).withColumn("a`b", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x"))
    assert sorted((tuple(r) for r in ls.ranked_search(d, i).collect()), key=repr) == brute_search(docs, items)
    assert ls.ranked_search(d.limit(0), i).count() == 0 and ls.ranked_search(d, i.limit(0)).count() == 0


def test_bit_slices_add_and_select():
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 20, (5, 3, 128)) * (rng.random((5, 3, 128)) < 0.5)
    values[:, 1] = values[0, 0, 0] or 7  # all tie
    total = []
    for v in values:
        slices = np.stack([np.packbits((v >> b) & 1 > 0, axis=1, bitorder="little").view(np.uint64) for b in range(20)])
        ls.add(total, slices, 1)
    read = lambda x: np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
    sums = 2 * values.sum(0)
    assert (sum(read(t).astype(np.int64) << b for b, t in enumerate(total)) == sums).all()
    sure, tied = map(read, ls.top_of(total, 20))
    for q in range(3):
        least = np.sort(sums[q])[-20]
        assert set(np.flatnonzero(sure[q])) | set(np.flatnonzero(tied[q])) >= set(np.flatnonzero(sums[q] > least))
        assert set(np.flatnonzero(sure[q] | tied[q])) <= set(np.flatnonzero(sums[q] >= least)) and sure[q].sum() <= 20


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    parts = ["the", "an", "er", "on", "re", "ti", "es", "st", "en", "at", "to", "nt", "ha", "nd", "ou"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(30, 200))]
        bad = rng.random() < 0.2
        for _ in range(rng.randrange(3, 8) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(BAD).upper() + rng.choice(["", ",", "!!"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_corpus(900, 3)
    more = [(2000, None), (2001, ""), (None, " ".join(BAD)), (2002, "ordinary " * 20_000), (2003, docs[0][1]), (2003, docs[0][1])]
    d = spark.createDataFrame(docs + more, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("a`b", F.lit(1))
    lab = spark.createDataFrame([*labels, (0, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    out = tx.toxicity(d, lab).collect()
    assert len(out) == len(docs) + len(more) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    toxic = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in toxic]
    assert len(held) > 200 and all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    caught = [r.predicted for r in held if toxic[r.doc_id]]
    assert sum(caught) >= 0.95 * len(caught) and sum(r.predicted for r in held if not toxic[r.doc_id]) == 0
    one = {r.doc_id: r for r in out}
    assert one[2000].score == one[2001].score < 0.5 and not one[2000].n_windows and not one[2002].predicted
    text = dict(docs)
    for r in held[:50]:
        assert all(any(b in text[r.doc_id].encode()[s.begin : s.end].decode().lower() for b in BAD) for s in r.spans if s.saved > 6)


def test_toxicity_without_labels(spark):
    docs, labels = toxic_corpus(20, 4)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tx.toxicity(d, none).collect()} == {0.5}
    clean = spark.createDataFrame([(i, 0) for i, _ in docs], "doc_id long, toxic int")
    assert not sum(r.predicted for r in tx.toxicity(d, clean).collect())
    assert tx.toxicity(d.limit(0), none).count() == 0
    assert tx.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 20  # too little to train on
