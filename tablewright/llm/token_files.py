"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A token set is a folder of two Parquet data sets. `dictionary` has one row: the zstandard
dictionary, trained on serialised id arrays, and its SHA-256. Its sample are the documents of any
length whose hash of id and text is below a bound, about `sample_docs` of them; a document gives up
to `PIECES` pieces of `PIECE_IDS` ids, spread evenly over all its ids, so the sample is bounded
whatever the input. Where there is too little to train on, the pieces themselves are the
dictionary. `blocks` has rows of about `block_bytes`: concatenated frames, one for each
document, with the dictionary's hash, the ids of the documents, the byte offset of each frame and
its number of tokens. Blocks lie in ascending doc_id order by (part, block), so one short
document is read by a doc_id filter on `first_doc`/`last_doc`, one offset lookup and one
decompression.

Null and empty texts hold only the end id. Texts of any length are one frame. Repeated rows and
equal ids are all kept, ordered by their frames; a null doc_id comes first. Extra columns are not
read. An empty table makes a token set without blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tablewright.llm._arrow import map_texts
from tablewright.llm._pretokens import IdCache
from tablewright.llm.bpe import Vocabulary

LEVEL = 3
SEGMENT = 64  # bytes of a dictionary's pieces
BROADCAST_BLOCKS = 1_000_000
PIECES, PIECE_IDS = 8, 2048
#: Pre-tokens without white space but a blank in front, and none of the lead bytes that other white space has.
PLAIN = re.compile(rb" ?[^\x00-\x20\xc2\xe0-\xff]+")


class LibraryEncoder:
    """Encodes with the tokenizers library, which sees each distinct pre-token once."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        v = Vocabulary(path)
        self.line_break = self.each(["\n"])[0][0]
        self.cache = IdCache(v.pretokens, v.special, v.cut, self.learn)

    def each(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, raw: list[bytes]) -> list[list[int]]:
        """The library's ids of distinct pre-tokens. Those without white space inside are lines of one text, as a line
        break is a pre-token and a token of its own; this spares the library's work for each text."""
        words = [w.decode() for w in raw]
        lines = [k for k, w in enumerate(raw) if PLAIN.fullmatch(w)]
        out: list = [None] * len(words)
        if lines:
            ids = np.array(self.each(["\n".join([words[k] for k in lines])])[0])
            cuts = np.flatnonzero(ids == self.line_break)
            if len(cuts) + 1 == len(lines):
                flat, bounds = ids.tolist(), [-1, *cuts.tolist(), len(ids)]
                for k, a, b in zip(lines, bounds[:-1], bounds[1:], strict=True):
                    out[k] = flat[a + 1 : b]
        rest = [k for k, found in enumerate(out) if found is None]
        for k, found in zip(rest, self.each([words[k] for k in rest]), strict=True):
            out[k] = found
        return out

    def encode(self, column: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        flat, first = self.cache.encode(column)
        flat = np.insert(flat, first[1:], end_id)
        first = first + np.arange(len(first))
        return [flat[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def trained(pieces: list[bytes], size: int) -> bytes:
    """A dictionary of at most `size` bytes: trained on the pieces, or, where these are too few, made up of them."""
    total = sum(map(len, pieces))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 16)), pieces, level=LEVEL, k=SEGMENT, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:] if total >= 8 else b""


def train_dictionary(docs: DataFrame, rows: int, tokenizer_path: str, end_id: int, sample_docs: int, size: int) -> DataFrame:
    """One row: dictionary, sha256, sampled pieces. rows: of docs."""
    bound = F.lit(int(2**63 * min(1.0, sample_docs / max(rows, 1))) - 1)
    low = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**63 - 1))
    sample = docs.select("doc_id", "text").where(low <= bound).dropDuplicates()  # rows equal in both are all in or all out

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x in encoder(tokenizer_path).encode(batch.column(1), end_id):
            starts = np.unique(np.linspace(0, max(0, len(x) - PIECE_IDS), min(PIECES, -(-len(x) // PIECE_IDS))).astype(np.int64))
            out += [x[a : a + PIECE_IDS].tobytes() for a in starts.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["piece"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sorted(x for b in batches for x in b.column(0).to_pylist())
        made = trained(pieces, size)
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([made], pa.binary()), "sha256": [hashlib.sha256(made).hexdigest()], "samples": pa.array([len(pieces)], pa.int64())})

    return map_texts(sample, cut, "piece binary").repartition(1).mapInArrow(train, "dictionary binary, sha256 string, samples long")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, sample_docs: int = 2000, dictionary_bytes: int = 1 << 16, block_bytes: int = 1 << 20) -> None:
    """Write the token set of all documents to path."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, cuts = docs.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", [i / max(2, parts) for i in range(1, max(2, parts))], 10_000)).first()  # reads no text
    cuts = cuts if parts > 1 else []
    train_dictionary(docs, rows, tokenizer_path, end_id, sample_docs, dictionary_bytes).write.parquet(f"{path}/dictionary")
    dictionary, sha = read_dictionary(spark, path)
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(tokenizer_path).encode(batch.column(1), end_id)
        pack = compressor(dictionary)
        frames = [pack.compress(x.tobytes()) for x in ids]
        known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        where = np.searchsorted(cuts, batch.column(0).fill_null(0).to_numpy(), "left") * known
        return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(frames, pa.binary())], ["part", "doc_id", "n_tokens", "frame"])

    frames = map_texts(docs.select(F.col("doc_id").cast("long"), "text"), encode, "part int, doc_id long, n_tokens long, frame binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, held = 0, 0, []

        def out() -> pa.RecordBatch:
            ids, counts, data = zip(*held, strict=True)
            known = [i for i in ids if i is not None]
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "dictionary_sha256": [sha],
                "first_doc": pa.array([min(known, default=None)], pa.int64()), "last_doc": pa.array([max(known, default=None)], pa.int64()), "tokens": pa.array([sum(counts)], pa.int64()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())), "offsets": pa.array([np.cumsum([0, *map(len, data)])], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())), "data": pa.array([b"".join(data)], pa.binary()),
            })

        for batch in batches:
            for part, doc, n, frame in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                held.append((doc, n, frame))
                size += len(frame)
                if size >= block_bytes:
                    yield out()
                    block, size, held = block + 1, 0, []
        if held:
            yield out()

    ordered = frames.repartitionById(parts, "part").sortWithinPartitions("doc_id", "frame")
    schema = "part int, block int, dictionary_sha256 string, first_doc long, last_doc long, tokens long, doc_ids array<long>, offsets array<long>, counts array<long>, data binary"
    ordered.mapInArrow(pack, schema).write.parquet(f"{path}/blocks")


def read_dictionary(spark: SparkSession, path: str) -> tuple[bytes, str]:
    """The dictionary, of a size that write_tokens bounds, and its hash."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    if row is None:  # there was no document to sample
        return b"", hashlib.sha256(b"").hexdigest()
    if hashlib.sha256(row.dictionary).hexdigest() != row.sha256:
        raise ValueError(f"the dictionary in {path} does not fit its hash")
    return bytes(row.dictionary), row.sha256


def read_tokens(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids (binary, little-endian unsigned
    32-bit) of all documents, or of one, in which case only its blocks are read."""
    dictionary, sha = read_dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    index = blocks.select("part", "block", "tokens")
    totals = index.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))  # one row a part: few, whatever the input
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("part_tokens").over(before(Window.orderBy("part"))), F.lit(0)).alias("part_start"))
    within = F.coalesce(F.sum("tokens").over(before(Window.partitionBy("part").orderBy("block"))), F.lit(0))
    starts = index.withColumn("within", within).join(totals, "part").select("part", "block", (F.col("part_start") + F.col("within")).alias("block_start"))
    if doc_id is not None:
        blocks = blocks.where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    if blocks.select("part").count() <= BROADCAST_BLOCKS:  # 16 bytes a row
        starts = F.broadcast(starts)
    blocks = blocks.join(starts, ["part", "block"]).select("dictionary_sha256", "block_start", "doc_ids", "offsets", "counts", "data")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo = decompressor(dictionary)
        for batch in batches:
            for k in range(batch.num_rows):
                made_with, at, docs, offsets, counts, data = (batch.column(c)[k].as_py() for c in range(6))
                if made_with != sha:
                    raise ValueError("a block was compressed with another dictionary")
                starts = at + np.cumsum([0, *counts[:-1]])
                some = [i for i, d in enumerate(docs) if doc_id is None or d == doc_id]
                ids = [undo.decompress(data[offsets[i] : offsets[i + 1]]) for i in some]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([docs[i] for i in some], pa.int64()), "start": pa.array([int(starts[i]) for i in some], pa.int64()), "n_tokens": pa.array([counts[i] for i in some], pa.int64()), "ids": pa.array(ids, pa.binary())})

    return blocks.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens returns."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
