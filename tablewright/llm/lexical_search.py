"""Ranked lexical search over a bit-sliced impact index.

Documents are cut into terms once; a document's row holds its length and the frequencies of the terms that are asked (a
bitmap of their CRCs, of fixed size, keeps most others out; an exact join does the rest). A term's impact on a document is an
integer. The index holds, for each block of documents, every term's documents and the bits of its impacts as one bitmap for
each bit (slice), over the term's own documents. A search spreads a term's slices over the block, adds the slices of a query's
terms to its score's slices by carry arithmetic on whole bitmaps, and finds the top k from the most significant slice down: what
has the bit comes before what has not, until k are certain. The blocks' best are ranked once more.

score = sum over the query's terms, repeats included, of w * ((1000000000 * tf) div (1000 * tf + 12 * m)), with
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 100 - 25 + (25 * n * N) div L: N documents with terms, L their terms,
n the document's terms, df documents of the term.

Null texts and texts without terms are not ranked and not counted; rows of one doc_id are documents of their own, and rows
with a null doc_id rank behind others of their score. Rows of one item_id are one query, with all their terms; null ids are one too. Equal scores are ordered
by doc_id. Texts of any length are cut whole. Extra columns are not read. Empty tables give an empty result."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm._arrow import Texts, batch_conf, distinct_spans, numbers, slices
from tablewright.llm._pairs import block_pairs
from tablewright.llm._shared import small, stored

BLOCK = 8192  # documents
ITEMS = 64  # queries of a block
FILTER_BITS = 1 << 23
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAPS = np.zeros(256, bool)
_GAPS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True  # capitals are lower-cased before
NO_ID = -(1 << 63)


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times of each query."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def asked_bitmap(terms: DataFrame) -> bytes:
    """Of FILTER_BITS bits, those that the CRCs of the terms name."""
    bit = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(FILTER_BITS)) + 1  # bitmap functions count from 1
    parts = terms.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()  # FILTER_BITS bits at most
    out = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for p in parts:
        out[p.bucket - 1] = np.frombuffer(p.bits, np.uint8)
    return out.tobytes()


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """row, doc_id, n (terms of the document), terms and tfs (of those that may be asked), stored; of documents with terms."""
    batch_conf(docs.sparkSession)
    bitmap = asked_bitmap(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = np.frombuffer(bitmap, np.uint8), {}
        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column("text"), lower=True)
                start, end, first = texts.words(_GAPS)
                codes, spans = distinct_spans(texts.data, start, end)
                crc = np.fromiter(map(zlib.crc32, spans), np.int64, len(spans)) % FILTER_BITS
                asked = (bits[crc >> 3] >> (crc & 7)) & 1 > 0
                n = np.diff(first)
                row = np.repeat(np.arange(texts.n), n)
                kept = asked[codes] if len(codes) else np.zeros(0, bool)
                key, count = np.unique(row[kept] * max(1, len(spans)) + codes[kept], return_counts=True)
                of, code = key // max(1, len(spans)), key % max(1, len(spans))
                some = np.flatnonzero(n)
                cuts = np.searchsorted(of, np.append(some, texts.n)).astype(np.int32)
                cuts[-1] = len(of)
                words = pa.array(spans, pa.binary()).cast(pa.string()).take(pa.array(code)) if len(spans) else pa.array([], pa.string())
                lists = [pa.ListArray.from_arrays(pa.array(cuts), x) for x in (words, pa.array(count.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), pa.array(n[some].astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n long, terms array<string>, tfs array<long>")
    return stored(cut.withColumn("row", F.monotonically_increasing_id()), "frequencies")


def weights(found: DataFrame, terms: DataFrame) -> tuple[DataFrame, int, int]:
    """term, term_no, w of the terms that occur and are asked, stored; N and L."""
    total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(float(total[0])) + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    out = df.join(terms.select("term").distinct(), "term").select("term", F.xxhash64("term").alias("code"), w.alias("w"))
    by = Window.partitionBy("code").orderBy("term")  # terms of one code are told apart by their place
    out = stored(out.select("term", "w", "code", F.row_number().over(by).alias("place")), "weights")
    return out, total[0], total[1]


def impacts(found: DataFrame, weight: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """row, doc_id, code, place, impact (over 0) of every asked term in every document, a document's rows together."""
    posted = found.select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("row", "doc_id", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    near = small(weight, F.length("term") + 40)
    joined = posted.join(near, "term")
    m = F.expr(f"100 - 25 + (25 * n * {n_docs}L) div {max(1, n_terms)}L")
    impact = F.expr("w * ((1000000000 * tf) div (1000 * tf + 12 * m))")
    out = joined.withColumn("m", m).select("row", "doc_id", "code", "place", impact.alias("impact")).where("impact > 0")
    if near is weight:  # the join has shuffled: documents are brought together again
        out = out.repartition("row").sortWithinPartitions("row")
    return out


INDEX = "docs binary, codes binary, places binary, counts binary, ordinals binary, slices binary, bits int"


def build_index(rows: DataFrame) -> DataFrame:
    """The bit-sliced index of `impacts`, one row for each block of documents of a task: the documents' ids, the terms (codes,
    places, counts of documents), each term's documents (ordinals) and its impacts' slices, bit after bit."""
    batch_conf(rows.sparkSession)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        row, code, place, impact = (numbers(table, c) for c in ("row", "code", "place", "impact"))
        opens = np.concatenate([[True], row[1:] != row[:-1]])
        ordinal = np.cumsum(opens) - 1
        ids = table.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)[opens]
        order = np.lexsort((ordinal, place, code))
        code, place, impact, ordinal = code[order], place[order], impact[order], ordinal[order]
        head = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (place[1:] != place[:-1])]))
        counts = np.diff(np.append(head, len(code)))
        bits = int(impact.max()).bit_length()
        parts = [np.packbits((impact[a : a + n] >> np.arange(bits)[:, None]) & 1 > 0, axis=1, bitorder="little").tobytes() for a, n in zip(head.tolist(), counts.tolist(), strict=True)]
        values = [ids.astype("i8").tobytes(), code[head].astype("i8").tobytes(), place[head].astype("i4").tobytes(), counts.astype("i4").tobytes(), ordinal.astype("u2").tobytes(), b"".join(parts)]
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.binary()) for v in values), pa.array([bits], pa.int32())], [c.split()[0] for c in INDEX.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, last = 0, None
        for batch in batches:
            while batch.num_rows:
                row = numbers(batch, "row")
                opens = np.concatenate([[row[0] != last], row[1:] != row[:-1]])
                upto = count + np.cumsum(opens)
                cut = int(np.searchsorted(upto, BLOCK, "right"))
                if cut:
                    held.append(batch.slice(0, cut))
                    count, last = int(upto[cut - 1]), row[cut - 1]
                batch = batch.slice(cut)
                if batch.num_rows:
                    yield block(held)
                    held, count, last = [], 0, None
        if held:
            yield block(held)

    made = rows.mapInArrow(work, INDEX)
    return stored(made.select(F.monotonically_increasing_id().alias("row_block"), "*"), "index")


def spread(slices_: np.ndarray, ordinals: np.ndarray, width: int) -> np.ndarray:
    """Slices over a term's documents (bits x bytes) as slices over the block, in 64-bit words."""
    own = np.unpackbits(slices_, axis=1, count=len(ordinals), bitorder="little")
    if len(ordinals) * 16 > width * 8:
        whole = np.zeros((len(own), width * 8), np.uint8)
        whole[:, ordinals] = own
        return np.packbits(whole, axis=1, bitorder="little").view(np.uint64)
    out = np.zeros((len(own), width), np.uint8)
    bit, k = np.nonzero(own)
    np.bitwise_or.at(out, (bit, ordinals[k] >> 3), (1 << (ordinals[k] & 7)).astype(np.uint8))
    return out.view(np.uint64)


def add(total: list[np.ndarray], term: np.ndarray, shift: int) -> None:
    """Add a term's slices (bits x queries x words), shifted, to the sums' slices by carries from slice to slice."""
    carry, at = None, shift
    for bit in range(len(term)):
        while len(total) <= at:
            total.append(np.zeros_like(term[0]))
        a, b = total[at], term[bit]
        half = a ^ b
        both = a & b
        if carry is None:
            total[at], carry = half, both
        else:
            total[at] = half ^ carry
            carry = both | (half & carry)
        at += 1
    while carry is not None and carry.any():
        if len(total) <= at:
            total.append(np.zeros_like(carry))
        total[at], carry = total[at] ^ carry, total[at] & carry
        at += 1


def top_of(total: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query (rows of the slices), bitmaps of the documents that are among the first k for certain, and of those of one
    score that tie for what is left; found from the most significant slice down."""
    tied = np.bitwise_or.reduce(total)
    sure = np.zeros_like(tied)
    size = lambda x: np.bitwise_count(x).sum(axis=1)
    for bit in reversed(total):
        more = sure | (tied & bit)
        n = size(more)[:, None]
        sure, tied = np.where(n <= k, more, sure), np.where(n > k, tied & bit, np.where(n < k, tied & ~bit, np.uint64(0)))
    return sure, tied


def best_of_block(block: dict, items: list[dict], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Item, doc_ids and scores of the block's first k documents (a few more where the last ones tie)."""
    ids = np.frombuffer(block["docs"], "i8")
    counts, bits = np.frombuffer(block["counts"], "i4").astype(np.int64), block["bits"]
    first = np.concatenate([[0], np.cumsum(counts)])
    bytes_ = np.concatenate([[0], np.cumsum(bits * -(-counts // 8))])
    ordinals, raw = np.frombuffer(block["ordinals"], "u2").astype(np.int64), np.frombuffer(block["slices"], np.uint8)
    place = {key: i for i, key in enumerate(zip(np.frombuffer(block["codes"], "i8").tolist(), np.frombuffer(block["places"], "i4").tolist(), strict=True))}
    width = -(-len(ids) // 64) * 8
    known: dict[int, np.ndarray] = {}
    steps = []  # of each query: (term, shift), a term that is asked n times once for each bit of n
    for item in items:
        own = [(place[(t["code"], t["place"])], t["times"]) for t in item["terms"] if (t["code"], t["place"]) in place]
        steps.append([(t, s) for t, n in own for s in range(n.bit_length()) if n >> s & 1])
    total: list[np.ndarray] = []
    none = np.zeros((bits, width // 8), np.uint64)
    for turn in range(max(map(len, steps), default=0)):
        for shift in sorted({own[turn][1] for own in steps if turn < len(own)}):
            asked = [own[turn][0] if turn < len(own) and own[turn][1] == shift else None for own in steps]
            for t in {t for t in asked if t is not None and t not in known}:
                known[t] = spread(raw[bytes_[t] : bytes_[t + 1]].reshape(bits, -1), ordinals[first[t] : first[t + 1]], width)
            add(total, np.stack([none if t is None else known[t] for t in asked], axis=1), shift)
    if not total:
        return
    sure, tied = top_of(total, k)
    order = np.where(ids == NO_ID, np.iinfo(np.int64).max, ids)
    for q, item in enumerate(items):
        a, b = (np.flatnonzero(np.unpackbits(x[q].view(np.uint8), bitorder="little")) for x in (sure, tied))
        left = k - len(a)
        b = b[np.argsort(order[b], kind="stable")][:left] if left > 0 else b[:0]
        docs = np.concatenate([a, b])
        if len(docs):
            score = np.zeros(len(docs), np.int64)
            for at, bit in enumerate(total):
                score |= ((bit[q][docs >> 6] >> (docs & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << at
            yield item["item_id"], ids[docs], score


def search(index: DataFrame, weight: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the first k documents of each query (item_id, term, times)."""
    kind = dict(queries.dtypes)["item_id"]
    batch_conf(index.sparkSession)
    coded = queries.join(weight.drop("w"), "term").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("code", "place", F.col("times").cast("int").alias("times")))).alias("terms"))
    coded = stored(coded, "queries")
    parts = max(1, -(-coded.count() // ITEMS))
    packed = coded.withColumn("query_block", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")).groupBy("query_block").agg(F.collect_list(F.struct("item_id", "terms")).alias("items"))
    size = F.aggregate("items", F.lit(0), lambda s, x: s + 40 + F.size(x["terms"]) * 16)
    columns = [c.split()[0] for c in INDEX.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = batch.slice(i, 1).to_pylist()[0]
                found = list(best_of_block({c: pair[c] for c in columns}, pair["items"], k))
                if found:
                    item = [x for x, ids, _ in found for _ in range(len(ids))]
                    ids, score = (np.concatenate([f[j] for f in found]) for j in (1, 2))
                    yield pa.RecordBatch.from_arrays([pa.array(item, batch.schema.field("items").type.value_type.field("item_id").type), pa.array(ids, mask=ids == NO_ID), pa.array(score)], ["item_id", "doc_id", "score"])

    best = block_pairs(index, packed, parts, size).mapInArrow(work, f"item_id {kind}, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the first k of all documents (doc_id, text) for each item (item_id, text)."""
    queries = stored(query_terms(items), "query-terms")
    found = frequencies(docs, queries)
    weight, n_docs, n_terms = weights(found, queries)
    return search(build_index(impacts(found, weight, n_docs, n_terms)), weight, queries, k)
