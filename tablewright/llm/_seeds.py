"""Seeds for exact repeats: every span of `span` units has one winnowed anchor, a k-gram chosen by its
content, so equal spans share their anchor. Documents meet on anchors; what lies around a shared
anchor (a segment: all spans that chose it) is then compared unit by unit, never by a hash alone.

No group of a common anchor meets in one task. An anchor that is frequent in a slice of one task,
or has more than `HOT` rows in all, is hot: its rows go about by their whole span in place of
the anchor, and a task, which reads its documents by rising doc_id, sends on only the first of the equal spans that it has, as the
others are repeats of that one for certain. Rows of anchors that a task knows to be shared and hot take no
part in counting."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.functions.columns import quoted
from tablewright.llm._arrow import Texts, batch_conf, minimizers, mix, numbers, slices, whole_runs, windows
from tablewright.llm._hot import DEALT, HOT_COUNT, Dealer, repeated_keys

HOT = 20_000  # rows of an anchor that may meet in one task
LOCALLY_HOT = 16  # documents of a slice
REMEMBERED = 200_000  # spans that a task keeps to know repeats of


@dataclass(frozen=True)
class Units:
    """What texts are cut into, and the anchors' k and span."""

    kind: str  # words or bytes
    k: int
    span: int
    hot: int = HOT
    locally_hot: int = LOCALLY_HOT

    def cut(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, the first byte of each unit (and where the last one ends), the first unit of each text (n + 1
        numbers), hashes of k-grams. Words are followed by one blank each."""
        if self.kind == "bytes":
            at = np.arange(max(0, len(texts.data) - self.k + 1))
            return texts.data, np.arange(len(texts.data) + 1), texts.offsets, texts.hash_spans(at, at + self.k)
        start, end, first = texts.words()
        data, offsets = texts.blank_joined(start, end)
        return data, offsets, first, windows(texts.strong_hashes(start, end), self.k)


@dataclass
class Anchors:
    data: np.ndarray
    offsets: np.ndarray  # of units in data
    first: np.ndarray  # unit of each text
    hash: np.ndarray
    row: np.ndarray
    at: np.ndarray  # unit of the anchor
    begin: np.ndarray  # of the segment, in the slice's units
    end: np.ndarray
    tied: np.ndarray  # whether equal k-grams are near, so that its spans may equal each other


def anchors(texts: Texts, how: Units) -> Anchors:
    data, offsets, first, grams = how.cut(texts)
    place, tied = minimizers(grams, how.span - how.k + 1)
    row = np.repeat(np.arange(texts.n), np.diff(first))
    spans = np.flatnonzero(np.arange(len(place)) + how.span <= first[1:][row[: len(place)]]) if len(place) else np.zeros(0, np.int64)
    chosen = place[spans]
    opens = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (np.diff(spans) != 1) | (np.diff(row[spans]) != 0)]) if len(spans) else np.zeros(0, bool)
    begin, at = spans[opens], chosen[opens]
    last = np.append(spans[np.flatnonzero(opens)[1:] - 1], spans[-1:])
    return Anchors(data, offsets, first, grams[at].view(np.int64), row[begin], at, begin, last + how.span, tied[begin])


def ordered_by(frame: DataFrame, *columns: str) -> DataFrame:
    """Dealt by the first column, each part in order of all."""
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(parts, columns[0]).sortWithinPartitions(*columns)


def shared_anchors(docs: DataFrame, how: Units, across: bool) -> DataFrame:
    """doc_id, hashes, hot: each document's anchors that occur again (across: in another document), and which of them are hot."""
    batch_conf(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(how.locally_hot)
        for batch in batches:
            for part in slices(batch):
                found = anchors(Texts(part.column(1)), how)
                rows = dealer.rows(found.hash, numbers(part, "doc_id")[found.row], found.tied)
                if rows is not None:
                    yield rows

    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").mapInArrow(work, DEALT)
    found = repeated_keys(each, across, how.hot)
    hot = F.when(F.col("n") == HOT_COUNT, F.col("key"))
    return found.groupBy(F.col("holder").alias("doc_id")).agg(F.collect_set("key").alias("hashes"), F.collect_set(hot).alias("hot"))


#: at: of the anchor in the segment, or, where there is none, how many units are matched. more: where else the segment
#: begins in its text, as 64-bit numbers (a list column that is mostly null costs Spark a pass over the batch for each row).
SEGMENT = "key long, segment binary, at int, doc_id long, text_hash long, begin long, more binary"


def segments(base: DataFrame, shared: DataFrame, how: Units, itself: bool) -> DataFrame:
    """Occurrences of shared anchors with what surrounds them (segment, and at: the anchor's place in it). Of hot anchors
    each span stands for itself; one that its task saw before in a smaller document (itself: or earlier
    in the same one) is a match, whose row has no segment."""
    batch_conf(base.sparkSession)

    def chosen(hashes: pa.Array, row: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which anchors are in their text's list of hashes."""
        sizes = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False)
        listed, of = hashes.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(hashes)), sizes)
        if not len(listed):
            return np.zeros(len(own), bool)
        both = pd.factorize(np.concatenate([own, listed]))[0].astype(np.int64)
        return np.isin(row * len(both) + both[: len(own)], of * len(both) + both[len(own) :])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(3)), 0))
            for part in slices(batch):
                found = anchors(Texts(part.column(2)), how)
                wanted = np.flatnonzero(chosen(part.column(3), found.row, found.hash))
                hot = chosen(part.column(4), found.row[wanted], found.hash[wanted])
                ids, texts = (numbers(part, c)[found.row] for c in ("doc_id", "text_hash"))
                base_unit = found.first[:-1][found.row]
                cold = wanted[~hot]
                raw, blank = found.data.tobytes(), int(how.kind == "words")
                bytes_of = lambda b, e: [raw[x:y] for x, y in zip(found.offsets[b].tolist(), (found.offsets[e] - blank).tolist(), strict=True)]
                begin, end = found.begin[cold], found.end[cold]
                columns = [found.hash[cold], bytes_of(begin, end), found.at[cold] - begin, ids[cold], texts[cold], begin - base_unit[cold]]
                if hot.any():
                    several = wanted[hot]
                    count = found.end[several] - found.begin[several] - how.span + 1
                    of = np.repeat(several, count)
                    start = found.begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                    order = np.argsort(start, kind="stable")
                    of, start = of[order], start[order]
                    text = bytes_of(start, start + how.span)
                    known = np.zeros(len(of), bool)
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    more: dict[int, list[int]] = {}  # other places of a span in its own text, by the span's row
                    sent_by: dict[bytes, int] = {}
                    rows = found.row[of].tolist()
                    for i, (span, doc, place) in enumerate(zip(text, ids[of].tolist(), (start - base_unit[of]).tolist(), strict=True)):
                        before = seen.get(span)
                        if before is not None and (before[0] < doc or itself and before < (doc, place)):
                            known[i] = True
                            continue
                        seen[span] = min(before, (doc, place)) if before else (doc, place)
                        if rows[(k := sent_by.setdefault(span, i))] == rows[i] and k != i:
                            more.setdefault(k, []).append(place)
                        else:
                            sent_by[span] = i
                    inner = np.zeros(len(of), bool)
                    inner[[i for i, span in enumerate(text) if not known[i] and sent_by.get(span) != i and rows[sent_by[span]] == rows[i]]] = True
                    sent = ~known & ~inner
                    # matches that meet or overlap are one row
                    k = np.flatnonzero(known)
                    opens = np.concatenate([[True], (np.diff(start[k]) > how.span) | (np.diff(found.row[of[k]]) != 0)]) if len(k) else np.zeros(0, bool)
                    head, last = k[opens], k[np.append(np.flatnonzero(opens)[1:] - 1, len(k) - 1)] if len(k) else k
                    places = [more.get(i) for i in np.flatnonzero(sent).tolist()]
                    text = [text[i] for i in np.flatnonzero(sent).tolist()]
                    own = np.fromiter(map(xxhash.xxh3_64_intdigest, text), np.uint64, len(text)).view(np.int64)
                    key = np.concatenate([columns[0], own, mix(ids[of[head]].astype(np.uint64)).view(np.int64)])
                    local = start - base_unit[of]
                    columns = [key, [*columns[1], *text, *[None] * len(head)]] + [
                        np.concatenate([c, mine[sent], theirs])
                        for c, mine, theirs in zip(columns[2:], (found.at[of] - start, ids[of], texts[of], local), (local[last] + how.span - local[head], ids[of[head]], texts[of[head]], local[head]), strict=True)
                    ]
                else:
                    places, head = [], []
                if len(columns[0]):
                    others = pa.array([*[b""] * len(cold), *(np.array(x, np.int64).tobytes() if x else b"" for x in places), *[b""] * len(head)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.binary()), pa.array(columns[2].astype(np.int32)), *map(pa.array, columns[3:]), others], ["key", "segment", "at", "doc_id", "text_hash", "begin", "more"])

    joined = base.join(shared.withColumnRenamed("doc_id", "shared_id"), F.col("doc_id") == F.col("shared_id"), "left")
    none = F.array().cast("array<long>")
    joined = joined.sortWithinPartitions("doc_id")  # rising ids, so that a task sends a hot span once, whatever order the rows came in
    return joined.select("doc_id", "text_hash", "text", F.coalesce("hashes", none).alias("hashes"), F.coalesce("hot", none).alias("hot")).mapInArrow(work, SEGMENT)


@dataclass
class Group:
    """Segments sorted by (key, segment, doc_id, begin); equal segments form a class."""

    doc: np.ndarray
    begin: np.ndarray
    text_hash: np.ndarray
    of: np.ndarray  # class of each row
    head: np.ndarray  # first row of each class
    at: np.ndarray  # unit of each class's anchor
    data: np.ndarray  # bytes of the classes' segments
    offsets: np.ndarray
    several: np.ndarray  # whether a row has more places
    more: pa.ChunkedArray

    @staticmethod
    def read(table: pa.Table) -> Group:
        segment = table.column("segment").combine_chunks()
        segment = (segment.chunk(0) if isinstance(segment, pa.ChunkedArray) else segment).cast(pa.large_binary())
        key = numbers(table, "key")
        differs = pc.not_equal(segment[1:], segment[:-1]).to_numpy(zero_copy_only=False)
        opens = np.concatenate([[True], differs | (key[1:] != key[:-1])])
        head = np.flatnonzero(opens)
        distinct = segment.take(pa.array(head))
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[: len(head) + 1]
        data = np.frombuffer(distinct.buffers()[2], np.uint8)
        return Group(numbers(table, "doc_id"), numbers(table, "begin"), numbers(table, "text_hash"), np.cumsum(opens) - 1, head, numbers(table, "at").astype(np.int64)[head], data[offsets[0] : offsets[-1]], offsets - offsets[0], pc.binary_length(table.column("more")).to_numpy() > 0, table.column("more"))


Judge = Callable[[Group], tuple[np.ndarray, np.ndarray, np.ndarray]]


def matched(found: DataFrame, how: Units, judge: Judge) -> DataFrame:
    """doc_id, ranges (text_hash, begin, end): the spans that occur earlier elsewhere. judge gets a group and says how
    many spans each class has, which rows are matched whole, and which spans of the classes are matched in the
    rows that are not."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "key"):
            sure = pc.is_null(table.column("segment"))
            for known in table.filter(sure).to_batches():
                end = pc.add(known.column("begin"), pc.cast(known.column("at"), pa.int64()))
                yield pa.RecordBatch.from_arrays([known.column("doc_id"), known.column("text_hash"), known.column("begin"), end], ["doc_id", "text_hash", "begin", "end"])
            table = table.filter(pc.invert(sure)).combine_chunks()
            if not table.num_rows:
                continue
            g = Group.read(table)
            counts, whole, hit = judge(g)
            first = np.concatenate([[0], np.cumsum(counts)])
            of = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(first[-1]) - first[:-1][of]
            rows = np.flatnonzero(whole)
            begin, end = g.begin[rows], g.begin[rows] + counts[g.of[rows]] + how.span - 1
            edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            cuts = first[1:-1]
            inner = cuts[hit[np.maximum(cuts - 1, 0)] & hit[np.minimum(cuts, len(hit) - 1)]] if len(hit) else cuts
            opens, closes = np.sort(np.concatenate([np.flatnonzero(edges == 1), inner])), np.sort(np.concatenate([np.flatnonzero(edges == -1), inner]))
            by_class = of[opens] if len(opens) else np.zeros(0, np.int64)
            rest = np.flatnonzero(~whole)
            lo, hi = np.searchsorted(by_class, g.of[rest], "left"), np.searchsorted(by_class, g.of[rest], "right")
            again = np.repeat(rest, hi - lo)
            run = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(len(again)) if len(again) else np.zeros(0, np.int64)
            rows = np.concatenate([rows, again])
            begin = np.concatenate([begin, g.begin[again] + place[opens[run]]])
            end = np.concatenate([end, g.begin[again] + place[closes[run] - 1] + how.span])
            several = np.flatnonzero(g.several[rows])
            if len(several):
                places = [np.frombuffer(g.more[int(r)].as_py(), np.int64) for r in rows[several].tolist()]
                each = np.repeat(several, list(map(len, places)))
                rows, size = np.concatenate([rows, rows[each]]), end[each] - begin[each]
                begin = np.concatenate([begin, np.concatenate(places)])
                end = np.concatenate([end, begin[-len(each) :] + size])
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(g.doc[rows]), pa.array(g.text_hash[rows]), pa.array(begin), pa.array(end)], ["doc_id", "text_hash", "begin", "end"])

    spans = ordered_by(found, "key", "segment", "doc_id", "begin").mapInArrow(work, "doc_id long, text_hash long, begin long, end long")
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("text_hash", "begin", "end")).alias("ranges"))


def base_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text, rest (all other columns)."""
    others = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.lit(None).cast("struct<none:int>")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text", rest.alias("rest"))


def with_rest(columns: str, base: DataFrame) -> StructType:
    """A schema of these columns and the base rows' other ones, of whatever name."""
    return StructType.fromDDL(columns).add(base.schema["rest"])


def with_ranges(base: DataFrame, ranges: DataFrame) -> DataFrame:
    """The base rows with the ranges of their ids, none where there are none."""
    joined = base.join(ranges.withColumnRenamed("doc_id", "range_id"), F.col("doc_id") == F.col("range_id"), "left").drop("range_id")
    return joined.withColumn("ranges", F.coalesce("ranges", F.array().cast(dict(ranges.dtypes)["ranges"])))


def removed_units(batch: pa.RecordBatch, column: int, first: np.ndarray, text_hash: np.ndarray) -> np.ndarray:
    """Which units of a slice lie in ranges of their own text."""
    ranges = batch.column(column)
    owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(ranges), 0).to_numpy(zero_copy_only=False))
    flat = ranges.flatten()
    mine = flat.field("text_hash").to_numpy(zero_copy_only=False) == text_hash[owner]
    owner = owner[mine]
    begin, end = (flat.field(x).to_numpy(zero_copy_only=False)[mine] + first[owner] for x in ("begin", "end"))
    marks = np.zeros(first[-1] + 1, np.int64)
    np.add.at(marks, begin, 1)
    np.add.at(marks, end, -1)
    return np.cumsum(marks[:-1]) > 0
