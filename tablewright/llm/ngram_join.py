"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document's set holds its distinct 5-word shingles. Equal sets (by 128 bits of digest) form a
class, of which the smallest doc_id stands for all. Candidate classes come from an exact prefix
filter in two steps: the smallest hashes of each set (a share that must meet the partner's in
many places) are counted over the whole corpus, then only the rarest of them are looked up,
so passages that many documents share bring no candidates unless they make up most of a
document. Candidates joined by lookups form families, and families are cut into tiles: size
bands (sizes a fifth apart cannot link) and blocks of bounded size. A tile has the words of its
texts and numbers their shingles, equal numbers for equal words only; bit counts of hashed bitmaps
bound each pair's overlap from above, and pairs that may still reach the threshold are decided by
intersecting the sorted arrays. `jaccard_join` decides every pair and counts the links of each class;
`jaccard_components`, which only groups, skips pairs that are already joined.

Null and blank texts have an empty set and link with nothing. Rows with a null doc_id are not
linked and have no component. Repeated rows and equal texts are one class; rows that share a doc_id but
not a text are told apart, each in its own class. Of classes with one smallest doc_id (ties) the one
of the smaller digest stands first. Texts of any length have one set, made in one task. An empty
table gives an empty result. Extra columns, of whatever name, pass through `one_of_each_group`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.columns import quoted
from tablewright.llm._arrow import Texts, batch_conf, map_texts, mix, numbers, paired, slices, whole_runs, windows, words_of
from tablewright.llm._graph import components
from tablewright.llm._hot import DEALT, Dealer, opens, repeated_keys
from tablewright.llm._shared import small, stored

WORDS = 5
#: Link when 100 * intersection >= 80 * union: overlap >= 4/9 of the sizes' sum, sizes within 4:5.
SHARE = 0.2  # of a set, that prefixes must meet in
TILE_SHINGLES = 1_000_000
HOT = 20_000  # rows of a token that may meet in one task
LOCALLY_HOT = 16  # sets of a slice, or rows of a batch
MAX_BITS = 1 << 14


def shingle_sets(texts: Texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    start, end, first = texts.words()
    units = texts.strong_hashes(start, end)
    grams = windows(units, WORDS)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        else:
            out.append(mix(windows(units[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit digests of each set."""
    both = [(s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else (0, 0) for s in sets]
    return np.array(both, np.uint64).reshape(-1, 2).view(np.int64)


def need(n: np.ndarray | int) -> np.ndarray | int:
    """The least overlap of a set of n with any partner: ceil(0.8 n)."""
    return -(-4 * n // 5)


def meets(n: np.ndarray | int) -> np.ndarray | int:
    """Prefixes of two linked sets, the smaller of n, meet at least so often."""
    return -(-n // round(1 / SHARE))


def prefix(n: int) -> int:
    return int(n - need(n) + meets(n))


def set_summaries(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, d1, d2 (digest of the set)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(Texts(batch.column(2), lower=True))
        d = digests(sets)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], ["doc_id", "text_hash", "n_shingles", "d1", "d2"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), work, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long")


def prefix_tokens(docs: DataFrame) -> DataFrame:
    """token, d1, n (in how many sets, as far as it is not hot): of the first tokens in hash order of every set, those of several sets."""
    batch_conf(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(LOCALLY_HOT)
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(Texts(part.column(0), lower=True))
                cut = [s[: prefix(len(s))] for s in sets]
                rows = dealer.rows(np.concatenate(cut).view(np.int64), np.repeat(digests(sets)[:, 0], [len(c) for c in cut]))
                if rows is not None:
                    yield rows

    dealt = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(work, DEALT)
    return repeated_keys(dealt, True, HOT).select(F.col("key").alias("token"), F.col("holder").alias("d1"), "n")


def size_runs(rows: DataFrame) -> DataFrame:
    """a, b (d1 of two sets): rows (token, size, d1) with one token and sizes that fit, each with the first of its run. Where
    one batch has many rows of a token, those of about one size are joined there, and one of them goes on."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, size, d1 = (numbers(batch, c) for c in ("token", "size", "d1"))
            if not len(token):
                continue
            band = np.floor(np.log(size) / np.log(1.05)).astype(np.int64)
            order = np.lexsort((band, token))
            first = np.flatnonzero(opens(token[order]))
            many = np.repeat(np.diff(np.append(first, len(order))) >= LOCALLY_HOT, np.diff(np.append(first, len(order))))
            alone = opens(token[order]) | opens(band[order]) | ~many
            head = order[np.maximum.accumulate(np.where(alone, np.arange(len(order)), 0))]
            other = np.where(alone, d1[order], d1[head])
            deal = np.where(alone, token[order], mix(d1[order].view(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(token[order]), pa.array(size[order]), pa.array(d1[order]), pa.array(other, mask=alone)], ["deal", "token", "size", "d1", "b"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None
        for batch in batches:
            joined = batch.column(3).is_valid()
            ready = batch.filter(joined)
            if ready.num_rows:
                yield pa.RecordBatch.from_arrays([ready.column(2), ready.column(3)], ["a", "b"])
            batch = batch.filter(pc.invert(joined))
            token, size, d1 = (numbers(batch, c) for c in ("token", "size", "d1"))
            if not len(token):
                continue
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (5 * size[1:] > 7 * size[:-1])])  # 1.25 and twice 1.05
            goes_on = last is not None and last[0] == token[0] and 5 * size[0] <= 7 * last[1]
            head = d1[np.maximum.accumulate(np.where(new, np.arange(len(d1)), 0))]
            if goes_on:
                head[: np.append(np.flatnonzero(new)[1:], len(d1))[0]] = last[2]
            last = (int(token[-1]), int(size[-1]), int(head[-1]))
            some = np.flatnonzero(head != d1)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(d1[some]), pa.array(head[some])], ["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(near, "deal long, token long, size long, d1 long, b long").repartition(parts, "deal")
    return dealt.sortWithinPartitions("token", "size", "d1").select("token", "size", "d1", "b").mapInArrow(chained, "a long, b long").distinct()


def candidate_edges(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b (d1 of two sets): sets that share a rare prefix token, each with the first of its run of fitting sizes."""
    shared = prefix_tokens(docs).groupBy("d1").agg(F.array_sort(F.collect_set(F.struct("n", "token"))).alias("tokens"))
    sizes = classes.groupBy("d1").agg(F.max("n_shingles").alias("size"))
    n = F.col("size")
    needed = F.ceil(n * 4 / 5)
    meet = lambda x: F.ceil(x / round(1 / SHARE))
    whole = n - needed + meet(n)
    # tokens of one set only come first in the order, then the rarest
    take = whole - meet(needed) + 1 - (whole - F.size("tokens"))
    rare = shared.join(sizes, "d1").select("d1", "size", F.explode(F.slice("tokens", F.lit(1), F.greatest(take, F.lit(0)).cast("int"))).alias("t")).select(F.col("t.token").alias("token"), "size", "d1")
    return size_runs(rare)


def tiles(families: DataFrame) -> DataFrame:
    """doc_id, no, d1, d2, tiles (array of tile, side) from doc_id, no, d1, d2, size, component: within a size band every two
    blocks meet once, and every block meets those of the next band."""
    band = F.floor(F.log("size") / F.log(F.lit(1.25))).cast("int")
    banded = families.withColumn("band", band)
    blocks = banded.groupBy("component", "band").agg(F.ceil(F.sum("size") / TILE_SHINGLES).cast("int").alias("n"))
    shifted = lambda by, name: blocks.select("component", (F.col("band") + by).alias("band"), F.col("n").alias(name))
    around = blocks.join(shifted(-1, "above"), ["component", "band"], "left").join(shifted(1, "below"), ["component", "band"], "left").fillna(0, ["above", "below"])
    placed = banded.join(small(around, F.lit(48)), ["component", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int"))
    tile = lambda low, step, i, j, side: F.struct(F.xxhash64("component", low, F.lit(step), i, j).alias("tile"), F.lit(side).alias("side"))
    upto = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), f)).otherwise(F.array())
    block = F.col("block")
    own = upto("n", lambda j: F.struct(F.xxhash64("component", "band", F.lit(0), F.least(block, j), F.greatest(block, j)).alias("tile"), F.when(j < block, 1).when(j > block, 0).otherwise(2).alias("side")))
    over = upto("above", lambda j: tile(F.col("band"), 1, block, j, 0))
    under = upto("below", lambda j: tile(F.col("band") - 1, 1, j, block, 1))
    return placed.select("doc_id", "no", "d1", "d2", F.concat(own, over, under).alias("tiles"))


def tile_rows(sides: np.ndarray, sets: list[np.ndarray], every: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of sets in order of size: a place, places behind it with linked sets of other sides (2: of all), and those of them
    that join what was apart. Not every: pairs that are already joined are left out."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    bits = min(MAX_BITS, max(64, 1 << int(2 * sizes.max() - 1).bit_length()))
    maps = np.zeros((n, bits), bool)
    for i, s in enumerate(sets):
        maps[i, (mix(s.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)] = True
    maps = np.packbits(maps, axis=1).view(np.uint64)
    if every:
        first = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(flat.max() + 1, bool)
    group = np.arange(n)
    for i in range(n - 1):
        stop = int(np.searchsorted(sizes, sizes[i] * 5 // 4, "right"))
        if stop <= i + 1:
            continue
        js = np.arange(i + 1, stop)
        js = js[(sides[js] != sides[i]) | (sides[i] == 2)]
        if not every:
            js = js[group[js] != group[i]]
        if not len(js):
            continue
        total = sizes[i] + sizes[js]
        mine, others = maps[i], maps[js]
        bound = np.minimum(sizes[i] - np.bitwise_count(mine & ~others).sum(1, dtype=np.int64), sizes[js] - np.bitwise_count(others & ~mine).sum(1, dtype=np.int64))
        near = js[9 * bound >= 4 * total]
        linked, joins = [], []
        if every and 4 * len(near) > stop - i - 1:  # all sets at once
            mark[flat[first[i] : first[i + 1]]] = True
            both = np.add.reduceat(mark[flat[first[i + 1] : first[stop]]], first[i + 1 : stop] - first[i + 1], dtype=np.int64)[near - i - 1]
            mark[flat[first[i] : first[i + 1]]] = False
            linked = near[9 * both >= 4 * (sizes[i] + sizes[near])]
            apart = linked[group[linked] != group[i]]
            if len(apart):
                groups, at = np.unique(group[apart], return_index=True)
                joins = apart[at]
                group[np.isin(group, groups)] = group[i]
        else:
            for j in near.tolist():
                if not every and group[j] == group[i]:
                    continue
                at = np.searchsorted(sets[j], sets[i])
                at[at == len(sets[j])] = 0
                both = int(np.count_nonzero(sets[j][at] == sets[i]))
                if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                    linked.append(j)
                    if group[j] != group[i]:
                        joins.append(j)
                        group[group == group[j]] = group[i]
        if len(linked):
            yield i, np.asarray(linked), np.asarray(joins, np.int64)


def tile_links(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], every: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Of a tile: links that are enough to join what is linked, and the number of links of each set (every) or zeros."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    counts, out = np.zeros(len(ids), np.int64), []
    for i, linked, joins in tile_rows(sides[order], [sets[k] for k in order], every):
        out += [(int(ids[order[i]]), int(ids[order[j]])) for j in joins.tolist()]
        if every:
            counts[order[i]] += len(linked)
            counts[order[linked]] += 1
    return out, counts


def tile_sets(words: pa.Array) -> list[np.ndarray]:
    """The sorted shingle numbers of texts of blank-joined words, equal numbers for equal shingles of all these texts only. A text of fewer
    words has none: its one shingle equals no other text's, or the two are one class."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    units, first = words_of(np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])
    grams = units
    for j in range(1, WORDS):
        grams = paired(grams[: max(0, len(units) - j)], units[j:])
    owner = np.repeat(np.arange(len(words)), np.diff(first))[: len(grams)]
    inside = np.arange(len(grams)) + WORDS <= first[1:][owner]
    owner, grams = owner[inside], grams[inside]
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = opens(owner) | opens(grams)
    owner, grams = owner[new], grams[new]
    return np.split(grams, np.searchsorted(owner, np.arange(1, len(words))))


def verified_links(docs: DataFrame, tiled: DataFrame, every: bool) -> DataFrame:
    """Out of the tiles: a, b (no) of links that are enough to join what is linked; every: also a, n of the number of
    links of a class in a tile. No pair of classes is in two tiles."""
    wanted = small(tiled.select(F.col("doc_id").alias("member"), "no", "d1", "d2", "tiles"), F.size("tiles") * 16 + 64)
    members = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id") == F.col("member"))

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = Texts(batch.column(0), lower=True)
        start, end, first = texts.words()
        data, offsets = texts.blank_joined(start, end)
        raw, cuts = data.tobytes(), offsets[first].tolist()
        mine = (digests(shingle_sets(texts)) == np.stack([batch.column(c).to_numpy() for c in (3, 4)], axis=1)).all(axis=1)
        rows = [(t["tile"], t["side"], h, raw[a:b]) for h, ok, a, b, ts in zip(batch.column(1).to_pylist(), mine, cuts[:-1], cuts[1:], batch.column(2).to_pylist(), strict=True) if ok for t in ts]
        if not rows:
            return None
        tile, side, no, words = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(tile, pa.int64()), pa.array(side, pa.int32()), pa.array(no, pa.int64()), pa.array(words, pa.binary())], ["tile", "side", "no", "words"])

    each = map_texts(members.select("text", "no", "tiles", "d1", "d2"), emit, "tile long, side int, no long, words binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "tile", 256):
            tile, side, no = (numbers(table, c) for c in ("tile", "side", "no"))
            place = np.flatnonzero(opens(tile) | opens(no))  # repeated rows are one
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(tile[place])) + 1, [len(place)]])
            words = table.column("words").combine_chunks()
            words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                at = place[a:b]
                found, counts = tile_links(no[at], side[at], tile_sets(words.take(pa.array(at))), every)
                some = at[counts > 0]
                first, second = zip(*found, strict=True) if found else ((), ())
                none = lambda n: pa.nulls(n, pa.int64())
                columns = [pa.array([*first, *no[some].tolist()], pa.int64()), pa.concat_arrays([pa.array(second, pa.int64()), none(len(some))]), pa.concat_arrays([none(len(found)), pa.array(counts[counts > 0])])]
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(parts, "tile").sortWithinPartitions("tile", "side", "no").mapInArrow(compare, "a long, b long, n long")


def class_links(docs: DataFrame, summaries: DataFrame, every: bool) -> tuple[DataFrame, DataFrame]:
    """The classes (`set_classes` with no, their number, which alone tells them apart) and `verified_links` between them."""
    classes = stored(set_classes(summaries).withColumn("no", F.monotonically_increasing_id()), "classes")
    families = components(candidate_edges(docs, classes)).withColumnRenamed("node", "d1")
    members = classes.join(families, "d1").select(F.col("class_id").alias("doc_id"), "no", "d1", "d2", F.col("n_shingles").alias("size"), "component")
    return classes, stored(verified_links(docs, stored(tiles(stored(members, "members")), "tiles"), every), "links")


def set_classes(sets: DataFrame) -> DataFrame:
    """d1, d2, class_id (smallest doc_id), n_shingles of the distinct sets."""
    return sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.max("n_shingles").alias("n_shingles"))


def grouped(sets: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of sets with class_id, component_id, n_links (if links are counted) and stays: whether the row's doc_id and class are the first
    of its component."""
    counts = links.where("n IS NOT NULL").groupBy(F.col("a").alias("no")).agg(F.sum("n").alias("n_links"))
    groups = components(links.where("b IS NOT NULL")).withColumnRenamed("node", "no")
    heads = classes.drop("n_shingles").join(groups, "no", "left").join(counts, "no", "left")
    least = heads.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("class_id", "d1", "d2")).alias("least"))
    own = F.struct("class_id", "d1", "d2")
    heads = heads.join(least, "component", "left").select("d1", "d2", "class_id", "n_links", F.coalesce("least", own).alias("least"))
    named = sets.join(heads, ["d1", "d2"], "left")
    known = F.col("doc_id").isNotNull()
    linked = known & F.col("class_id").isNotNull()
    stays = ~linked | ((F.col("doc_id") == F.col("class_id")) & (F.col("least") == own))
    return named.select("doc_id", "text_hash", "n_shingles", F.when(known, F.coalesce("least.class_id", "doc_id")).alias("component_id"), F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(known, F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links"), stays.alias("stays"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with an equal set) and n_links (other classes that its
    class is linked with) of every document. Every pair that may link is decided."""
    sets = stored(set_summaries(docs), "sets")
    return grouped(sets, *class_links(docs, sets, every=True)).drop("text_hash", "stays")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every document, out of enough links to tell, and text_hash, stays."""
    sets = stored(set_summaries(docs), "sets")
    return grouped(sets, *class_links(docs, sets, every=False)).drop("n_links")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of docs of each group: of its smallest doc_id, and of rows with one id and text the one whose hash is least; rows without an id, words or
    links stay. All columns unchanged."""
    judged = stored(jaccard_components(docs), "judged")
    gone = judged.where(~F.col("stays")).select("doc_id", "text_hash").distinct()
    often = judged.where("doc_id IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_hash")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    kept = rows.join(gone, ["doc_id", "text_hash"], "left_anti")
    if often.limit(1).count():
        one = kept.join(often, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = kept.join(often, ["doc_id", "text_hash"], "left_anti").select("row").unionByName(one.select("row"))
    return kept.select("row.*")
