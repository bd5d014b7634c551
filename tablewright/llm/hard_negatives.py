"""Hard-negative mining by distributed radix selection.

All vectors are packed into blocks, and so are the anchors (the stated queries); blocks meet in pairs and a
pair's scores are one matrix product. What is looked for is the k-th highest score of each window: a range of scores of one
anchor, among rows of its own label (positives) or of others (negatives, one window for each positive). Each round
cuts a window's range into 256 buckets and counts them. A pair sends only buckets down to the one that holds its own k-th score,
as nothing below can hold the k-th of all. The bucket with the k-th score is the next round's range, until
it is one score. Then only rows from that score up are gathered; of equal ones a pair sends k at most, by smaller
id, as the others are not among the first k of the pair's rows.

Rows with a null id or label, a null vector, or a null or not finite component take no part. Of rows with one
id the smallest (label, then components) stays. Shorter vectors count as if zeros followed. Scores beyond 2 ** 61 are cut
to that. Equal scores are ordered by id. Extra columns are not read. An empty table, or no anchor, gives an empty result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm._arrow import batch_conf, numbers
from tablewright.llm._pairs import block_pairs
from tablewright.llm._shared import stored

ANCHORS = 1024  # of a block
BUCKETS = 256
MOST = 1 << 61
PACKED = "n int, dims int, ids binary, labels binary, vectors binary, kind string"
WINDOW = ["anchor_id", "window_id", "low", "high", "step", "still"]


def packed_columns(ids: np.ndarray, labels: np.ndarray, vectors: pa.Array) -> tuple[int, int, bytes, bytes, bytes, str]:
    sizes = np.diff(vectors.offsets.to_numpy())
    dims = int(sizes.max(initial=0))
    grid = np.zeros((len(ids), dims), np.int64)
    grid[np.arange(dims) < sizes[:, None]] = vectors.flatten().to_numpy()
    kind = "i2" if np.abs(grid).max(initial=0) < 1 << 15 else "i8"  # of the most negative number abs is negative
    kind = "i8" if grid.min(initial=0) < -(1 << 15) else kind
    return len(ids), dims, ids.astype("i8").tobytes(), labels.astype("i8").tobytes(), grid.astype(kind).tobytes(), kind


def packed_rows(rows: DataFrame, before: str, first: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """One row for each batch of rows (vec_id, label, vector), with columns `before` made by first(batch)."""
    batch_conf(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = packed_columns(numbers(batch, "vec_id"), numbers(batch, "label"), batch.column("vector"))
                yield pa.RecordBatch.from_arrays([*first(batch), *(pa.array([v], t) for v, t in zip(values, [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string()], strict=True))], [*(c.split()[0] for c in before.split(", ") if c), "n", "dims", "ids", "labels", "vectors", "kind"])

    return rows.mapInArrow(work, f"{before}, {PACKED}" if before else PACKED)


def scores(a: dict, b: dict) -> np.ndarray:
    """All inner products, exact: in doubles where they cannot pass 53 bits, in 64-bit integers, or in Python's."""
    dims = min(a["dims"], b["dims"])
    left, right = (np.frombuffer(x["vectors"], x["kind"]).reshape(x["n"], x["dims"])[:, :dims] for x in (a, b))
    bound = dims * max(map(abs, (int(left.min(initial=0)), int(left.max(initial=0))))) * max(map(abs, (int(right.min(initial=0)), int(right.max(initial=0)))))
    if bound < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if bound < MOST:
        return left.astype(np.int64) @ right.astype(np.int64).T
    return np.clip(left.astype(object) @ right.astype(object).T, -MOST, MOST).astype(np.int64)


def eligible(pair: dict, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, dict]]:
    """For each anchor of a pair that has windows: scores and ids of the rows of its own label (or of others) but itself, and its windows."""
    rows = {k[4:]: v for k, v in pair.items() if k.startswith("row_") and k != "row_block"}
    anchors = {k[7:]: v for k, v in pair.items() if k.startswith("anchor_") and k != "anchor_id"}
    ids, labels = (np.frombuffer(rows[k], "i8") for k in ("ids", "labels"))
    place = {i: k for k, i in enumerate(np.frombuffer(anchors["ids"], "i8").tolist())}
    own = np.frombuffer(anchors["labels"], "i8")
    by_anchor: dict[int, list[dict]] = {}
    for w in pair["windows"]:
        by_anchor.setdefault(w["anchor_id"], []).append(w)
    all_scores = scores(anchors, rows)
    for anchor, windows in by_anchor.items():
        k = place[anchor]
        some = np.flatnonzero(((labels == own[k]) == same) & (ids != anchor))
        yield all_scores[k][some], ids[some], windows


def pair_rows(pairs: DataFrame, same: bool, of_window: Callable[[dict, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """of_window's columns (equal lengths) for every window of every pair, after anchor_id and window_id."""
    names = ["anchor_id", "window_id", *(c.split()[0] for c in schema.split(", "))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                parts = [[] for _ in names]
                for score, ids, windows in eligible(pair, same):
                    for w in windows:
                        inside = (score >= w["low"]) & (score <= w["high"])
                        found = of_window(w, score[inside], ids[inside])
                        size = len(next(iter(found.values())))
                        for part, values in zip(parts, [np.full(size, w["anchor_id"]), np.full(size, w["window_id"]), *found.values()], strict=True):
                            part.append(values)
                if parts[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).astype(np.int64)) for p in parts], names)

    return pairs.mapInArrow(work, f"anchor_id long, window_id long, {schema}")


def counted_buckets(w: dict, score: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """How many scores are in each bucket from the top, down to the one with the window's k-th score here."""
    n = np.bincount(((w["high"] - score) // w["step"]).astype(np.int64), minlength=1)
    upto = int(np.searchsorted(np.cumsum(n), w["still"])) + 1
    bucket = np.flatnonzero(n[:upto])
    return {"bucket": bucket, "n": n[bucket]}


def first_rows(w: dict, score: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """The pair's first rows of a window, `still` at most."""
    best = np.lexsort((ids, -score))[: w["still"]]
    return {"vec_id": ids[best], "score": score[best]}


class Selection:
    """The blocks of rows and of anchors, and what is selected from their pairs."""

    def __init__(self, rows: DataFrame, anchors: Column):
        """rows: vec_id, label, vector (array of long), one row for each id."""
        spark = rows.sparkSession
        self.blocks = stored(packed_rows(rows, "", lambda batch: []).select(F.monotonically_increasing_id().alias("row_block"), *[F.col(c.split()[0]).alias(f"row_{c.split()[0]}") for c in PACKED.split(", ")]), "vectors")
        asked = rows.where(anchors)
        self.parts = max(1, -(-asked.count() // ANCHORS))
        block = F.pmod(F.xxhash64("vec_id"), F.lit(self.parts)).cast("int")
        dealt = asked.withColumn("query_block", block).groupBy("query_block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "label", "vector"))).alias("rows"))  # about ANCHORS rows each

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    inner = batch.column("rows").slice(i, 1).flatten()
                    values = [batch.column("query_block")[i].as_py(), *packed_columns(*(inner.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label")), inner.field("vector"))]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string()], strict=True)], ["query_block", "n", "dims", "ids", "labels", "vectors", "kind"])

        names = [c.split()[0] for c in PACKED.split(", ")]
        self.anchors = stored(dealt.mapInArrow(pack, f"query_block int, {PACKED}").select("query_block", *[F.col(c).alias(f"anchor_{c}") for c in names]), "anchors")
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        longest = rows.agg(F.max(norm)).first()[0] or 0.0
        bound = F.least(norm * longest * 1.000001 + 1, F.lit(float(MOST))).cast("long")
        self.reach = asked.select(F.col("vec_id").alias("anchor_id"), bound.alias("reach"))
        self.spark, self.block_of = spark, lambda id_: F.pmod(F.xxhash64(id_), F.lit(self.parts)).cast("int")

    def pairs(self, windows: DataFrame) -> DataFrame:
        """All pairs of blocks with the anchors' windows (WINDOW)."""
        held = windows.withColumn("query_block", self.block_of("anchor_id")).groupBy("query_block").agg(F.collect_list(F.struct(*WINDOW)).alias("windows"))
        queries = self.anchors.join(held, "query_block")
        size = F.length("anchor_vectors") + F.size("windows") * 48
        return block_pairs(self.blocks, queries, self.parts, size)

    def least_scores(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """anchor_id, window_id, low (the k-th score of the window's range, or its lowest where there are fewer), high, step, still = k."""
        step = lambda low, high: F.greatest(F.lit(1).cast("long"), F.ceil((high - low + 1) / BUCKETS).cast("long"))
        top = windows.select("anchor_id", "window_id", F.col("high").alias("top"))
        open_ = stored(windows.select("anchor_id", "window_id", "low", "high", step(F.col("low"), F.col("high")).alias("step"), F.lit(k).cast("long").alias("still")), "windows")
        done = []
        while open_.limit(1).count():
            counts = pair_rows(self.pairs(open_), same, counted_buckets, "bucket long, n long").groupBy("anchor_id", "window_id", "bucket").agg(F.sum("n").alias("n"))
            by = Window.partitionBy("anchor_id", "window_id")
            upto = F.sum("n").over(by.orderBy("bucket"))
            placed = counts.withColumn("upto", upto).join(open_.select("anchor_id", "window_id", "still"), ["anchor_id", "window_id"])
            hit = placed.where((F.col("upto") >= F.col("still")) & (F.col("upto") - F.col("n") < F.col("still"))).select("anchor_id", "window_id", "bucket", (F.col("still") - F.col("upto") + F.col("n")).alias("left"))
            narrowed = open_.join(hit, ["anchor_id", "window_id"], "left")
            high = F.col("high") - F.col("bucket") * F.col("step")
            low = F.greatest(F.col("low"), high - F.col("step") + 1)
            few = F.col("bucket").isNull()
            after = stored(narrowed.select("anchor_id", "window_id", F.when(few, F.col("low")).otherwise(low).alias("low"), F.when(few, F.col("high")).otherwise(high).alias("high"), few.alias("few"), F.coalesce("left", "still").alias("still")), "windows")
            ended = F.col("few") | (F.col("low") == F.col("high"))
            done.append(after.where(ended).select("anchor_id", "window_id", "low"))
            open_ = after.where(~ended).select("anchor_id", "window_id", "low", "high", step(F.col("low"), F.col("high")).alias("step"), "still")
        found = done[0] if done else windows.select("anchor_id", "window_id", "low")
        for more in done[1:]:
            found = found.unionByName(more)
        return found.join(top, ["anchor_id", "window_id"]).select("anchor_id", "window_id", "low", F.col("top").alias("high"), F.lit(1).cast("long").alias("step"), F.lit(k).cast("long").alias("still"))

    def first(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """anchor_id, window_id, vec_id, score, rank: the first k rows of each window (anchor_id, window_id, low, high)."""
        gathered = pair_rows(self.pairs(self.least_scores(windows, k, same)), same, first_rows, "vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("anchor_id", "window_id").orderBy(F.desc("score"), "vec_id"))
        return gathered.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first rows of the same label,
    the first rows of other labels that score between low and high hundredths of the positive. rows: vec_id, label, embedding."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    sound = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~odd)
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    typed = sound.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    one = stored(typed.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector"), "rows")
    found = Selection(one, anchors)
    every = found.reach.select("anchor_id", F.lit(-1).cast("long").alias("window_id"), (-F.col("reach")).alias("low"), F.col("reach").alias("high"))
    best = stored(found.first(every, positives, same=True).select("anchor_id", F.col("vec_id").alias("window_id"), F.col("score").alias("positive_score")), "positives")
    share = lambda percent, up: F.expr(f"positive_score div 100 * {percent} + (positive_score % 100 * {percent} + {99 if up else 0}) div 100")
    windows = best.where("positive_score >= 0").select("anchor_id", "window_id", share(low, True).alias("low"), share(high, False).alias("high")).where("low <= high")
    chosen = found.first(windows, negatives, same=False).join(best, ["anchor_id", "window_id"])
    return chosen.select("anchor_id", F.col("window_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
