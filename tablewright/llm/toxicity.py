"""Toxicity by compression distance: windows of a text are compressed with a zstandard dictionary of ordinary text and with
one of toxic text; what the second saves over the first is evidence, and thresholds are calibrated on labelled rows.

Dictionaries: the ordinary one is trained on windows of ordinary texts, the toxic one on what is characteristic of toxic texts, put
behind the same background, so that ordinary text costs the same with either. Characteristic are words that more toxic texts hold
than ordinary ones explain: a text counts for a word by how independent its contexts are (copies share theirs) and the
less, the longer it is; the surprise (a Chernoff bound of the Poisson tail, in nats) must be over `surprise`. Compression is
without Huffman coding of literals, so that lengths are sums of matches.

Calibration: savings of windows over the level that one window in a thousand of ordinary text reaches, the three largest savings and the number of
windows go into a logistic regression, weighted to the shares of all labelled rows.

Fitting reads a bounded sample: `sample_docs` labelled documents of each class, whole, and `SAMPLE_WINDOWS` of their windows;
scoring reads every text whole. Null and empty texts have no windows and get the score of that. Rows of one doc_id are scored each by
its own text; where labels of one id differ the larger holds. Rows with a null doc_id are scored and never fitted. Without labels of both
classes every score is the share of toxic rows (0.5 without any). Extra columns are not read. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm._arrow import BLANK, Texts, batch_conf, slices
from tablewright.llm._shared import stored

WORDS = 8  # of a window
DICTIONARY_BYTES = 16_384
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_TERMS = 4000, 20_000, 256
TEXT_WORDS = 200  # of which a text's words count in full
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_GAPS = np.zeros(256, bool)
_GAPS[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
FEATURES = ["one", "first", "second", "third", "over", "windows"]


def surprise(n_toxic: int) -> float:
    """What a word must have: 0.1 nats for each toxic text up to 30 (10 at least), 0.02 where there are many, as differences that
    have other reasons (languages, sources) grow with the texts."""
    return max(10.0, min(30.0, 0.1 * n_toxic), 0.02 * n_toxic)


def windows_of(texts: Texts, words: int = WORDS) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The windows (words in lower case, a blank before and behind each), the text of each, where it begins and ends in the text's bytes."""
    start, end, first = texts.words(_GAPS)
    data, offsets = texts.blank_joined(start, end)
    raw = bytes([BLANK]) + data.tobytes()
    n = np.diff(first)
    per = -(-n // words)
    of = np.repeat(np.arange(texts.n), per)
    a = first[:-1][of] + (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)) * words
    b = np.minimum(a + words, first[1:][of])
    out = [raw[x : y + 1] for x, y in zip(offsets[a].tolist(), offsets[b].tolist(), strict=True)]
    return out, of, start[a] - texts.offsets[:-1][of], end[b - 1] - texts.offsets[:-1][of]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    level: float = 0.0
    mean: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    spread: list[float] = field(default_factory=lambda: [1.0] * len(FEATURES))
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))

    def sizes(self, content: bytes):
        """A function that gives the compressed length of a window. An empty dictionary is none."""
        p = zstandard.ZstdCompressionParameters.from_level(1, source_size=64, dict_size=len(content), strategy=zstandard.STRATEGY_FAST, target_length=1, hash_log=16, min_match=5, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        if not content:
            return zstandard.ZstdCompressor(compression_params=p).compress
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=p).compress

    def saver(self):
        """A function that gives the bytes that the toxic dictionary saves over the ordinary one in each window."""
        if self.toxic == self.ordinary:
            return lambda windows: np.zeros(len(windows))
        plain, toxic = self.sizes(self.ordinary), self.sizes(self.toxic)
        return lambda windows: np.fromiter((len(plain(w)) - len(toxic(w)) for w in windows), float, len(windows))

    def features(self, saved: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """One row for each of n texts."""
        order = np.lexsort((-saved, of))
        ranked, owner = saved[order], of[order]
        first = np.searchsorted(owner, np.arange(n + 1))
        out = np.zeros((n, len(FEATURES)))
        out[:, 0] = 1
        for j in range(3):
            some = np.flatnonzero(np.diff(first) > j)
            out[some, 1 + j] = np.maximum(ranked[first[some] + j], 0)
        out[:, 4] = np.sqrt(np.bincount(of, np.maximum(saved - self.level, 0), n))
        out[:, 5] = np.log1p(np.diff(first))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        z = ((features - np.array(self.mean)) / np.array(self.spread)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fitted(features: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights of a logistic regression with a small ridge, by Newton's steps."""
    mean, spread = features.mean(0), features.std(0) + 1e-9
    mean[0], spread[0] = 0, 1
    z, w = (features - mean) / spread, np.zeros(features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -700, 700)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (weight * (p - label)) + w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return mean, spread, w


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary's content of `size` bytes at most; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def characteristic(sample: DataFrame, n_toxic: int, n_ordinary: int) -> list[tuple[bytes, int]]:
    """Words that toxic texts of the sample (doc_id, toxic, text) hold more often than ordinary ones explain, and in how many: SAMPLE_TERMS at most."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = sample.select("doc_id", "toxic", F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("w")).where(F.size("w") > 0)
    at = lambda i: F.get("w", i)
    context = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(at(i - 1).alias("before"), at(i).alias("word"), at(i + 1).alias("after")))
    each = cut.select("doc_id", "toxic", F.least(F.lit(1.0), F.lit(float(TEXT_WORDS)) / F.size("w")).alias("share"), F.explode(F.array_distinct(context)).alias("c")).select("doc_id", "toxic", "share", "c.*")
    copies = F.count(F.lit(1)).over(Window.partitionBy("toxic", "before", "word", "after"))
    by_doc = each.withColumn("copies", copies).groupBy("doc_id", "toxic", "word").agg((F.avg(1 / F.col("copies")) * F.max("share")).alias("e"))
    seen = by_doc.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("e")).otherwise(0.0)).alias("k"), F.sum(F.when(F.col("toxic") == 0, F.col("e")).otherwise(0.0)).alias("o"), F.count(F.when(F.col("toxic") == 1, 1)).alias("n"))
    expected = F.lit(float(n_toxic)) * (F.col("o") + 3) / F.lit(float(max(1, n_ordinary)))
    k, many = F.col("k"), F.col("k") > F.col("expected")
    judged = seen.withColumn("expected", expected).withColumn("surprise", F.when(many, k * F.log(k / F.col("expected")) - k + F.col("expected")).otherwise(0.0))
    best = judged.where(F.col("surprise") > surprise(n_toxic)).orderBy(F.desc("surprise"), "word").limit(SAMPLE_TERMS)
    return [(r.word.encode(), r.n) for r in best.select("word", "n").collect()]


def sample_windows(texts: DataFrame, count: int) -> list[bytes]:
    """`count` windows at most, by the order of their hashes."""
    batch_conf(texts.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(windows_of(Texts(part.column("text"), lower=True))[0], pa.binary())], ["piece"])

    made = texts.select("text").mapInArrow(work, "piece binary").where(F.length("piece") <= 1024)
    return [bytes(r.piece) for r in made.orderBy(F.xxhash64("piece"), "piece").limit(count).collect()]


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1), only those that may be learnt from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    first = lambda toxic: known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    picked = first(0).unionByName(first(1))  # 2 * sample_docs ids
    share = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = stored(texts.join(F.broadcast(picked), "doc_id"), "toxicity-sample")
    there = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(there) < 2:
        rate = share.get(1, 0) / max(1, sum(share.values())) if share else 0.5
        bias = float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
        return Model(b"", b"", weights=[bias, *[0.0] * (len(FEATURES) - 1)])
    background = trained(sample_windows(sample.where("toxic = 0"), SAMPLE_WINDOWS), DICTIONARY_BYTES, 16)
    words = characteristic(sample, there[1], there[0])
    samples = [(b" " + w + b" ").ljust(40) for w, n in words for _ in range(n)]
    samples *= max(1, SAMPLE_WINDOWS // max(1, len(samples)))
    model = Model(background, background + (trained(samples, DICTIONARY_BYTES // 8, 40) if samples else b""))
    windows = sample_windows(sample.where("toxic = 0"), SAMPLE_WINDOWS)
    model.level = float(np.quantile(model.saver()(windows), 0.999)) if windows else 0.0
    rows = scored(sample, model, keep="toxic").select("toxic", *FEATURES).collect()  # rows of the sample
    x, y = np.array([[r[f] for f in FEATURES] for r in rows]), np.array([r.toxic for r in rows], float)
    each = {c: share[c] / there[c] for c in there}
    weight = np.where(y == 1, each[1], each[0])
    mean, spread, w = fitted(x, y, weight * len(y) / weight.sum())
    model.mean, model.spread, model.weights = mean.tolist(), spread.tolist(), w.tolist()
    return model


def scored(docs: DataFrame, model: Model, keep: str | None = None) -> DataFrame:
    """doc_id, score, n_windows, spans (begin, end in the text's bytes, and bytes saved, of windows over the model's level) of every row;
    keep: one more integer column to pass on, with the features."""
    batch_conf(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        saved_in = model.saver()
        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column("text"), lower=True)
                windows, of, begin, end = windows_of(texts)
                saved = saved_in(windows)
                x = model.features(saved, of, texts.n)
                over = np.flatnonzero(saved > model.level)
                cuts = np.searchsorted(of[over], np.arange(texts.n + 1)).astype(np.int32)
                inner = pa.StructArray.from_arrays([pa.array(begin[over]), pa.array(end[over]), pa.array(saved[over].astype(np.int64))], ["begin", "end", "saved"])
                columns = [part.column("doc_id"), pa.array(model.score(x)), pa.array(np.bincount(of, minlength=texts.n)), pa.ListArray.from_arrays(pa.array(cuts), inner)]
                names = ["doc_id", "score", "n_windows", "spans"]
                if keep:
                    columns, names = [*columns, part.column(keep), *map(pa.array, x.T)], [*names, keep, *FEATURES]
                yield pa.RecordBatch.from_arrays(columns, names)

    more = f", {keep} int, " + ", ".join(f"{f} double" for f in FEATURES) if keep else ""
    kept = [F.col(keep).cast("int").alias(keep)] if keep else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *kept).mapInArrow(work, f"doc_id long, score double, n_windows long, spans array<struct<begin: long, end: long, saved: long>>{more}")


def held_out(doc_id: Column) -> Column:
    """The third of all ids that no label is learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows, spans of every row of docs (doc_id, text), learnt from labels that are not held out."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), sample_docs)
    rows = scored(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_windows", "spans")
