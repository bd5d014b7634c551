"""Groups of changes that one statement may carry: runs of one type in id order, cut at `size` rows, and, where updates are grouped, before
an update whose key the group has updated already.

Such cuts are greedy: where a group begins decides where the next one does. Where a group ends is decided within `size` rows, so the
log is cut into ranges of rows, each with the next `size` rows beside it, and a range says for each of the `size`
places where a group may enter it where the first group behind it begins. These maps are joined by pointer jumping (each step joins
maps of twice as many ranges); then each range knows its own first group and lists the others."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import columns
from tablewright.operators.capture import CHANGE_ID, DML_TYPE, UPDATE
from tablewright.operators.chunks import numbered
from tablewright.sources.shared import computed

RANGE_ROWS = 100_000


def next_starts(kind: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """For each row, where the group that begins there ends (the next group's first row)."""
    n = len(kind)
    at = np.arange(n)
    changes = np.append(np.flatnonzero(kind[1:] != kind[:-1]) + 1, n)
    stop = np.minimum(at + size, changes[np.searchsorted(changes, at, "right")])
    repeat = np.full(n + 1, n)  # the first row from here on, of an update, whose key was updated since
    before = pd.Series(at).groupby(key).shift(1).to_numpy()
    again = np.flatnonzero((kind == UPDATE) & ~np.isnan(before))
    # a group from s is cut at the first i with s <= before[i]: the least such i for every s
    np.minimum.at(repeat, before[again].astype(np.int64), again)
    return np.minimum(stop, np.minimum.accumulate(repeat[::-1])[::-1][:n])


def starts_from(first: int, step: np.ndarray, end: int) -> list[int]:
    out = []
    while first < end:
        out.append(first)
        first = int(step[first])
    return [*out, first]


def change_groups(changes: DataFrame, size: int, keys: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """group_no, dml_type, first_id, last_id, n: groups of one type and at most `size` rows, with no key updated twice in one. Null keys are equal
    to each other here, as nothing is lost by a cut too many."""
    rows = max(range_rows, size)
    text = F.concat(*[F.coalesce(F.concat(F.lit("="), F.hex(c.cast("string").cast("binary"))), F.lit("-")) for c in columns(keys)]) if keys else F.lit("")
    placed = numbered(changes.select(CHANGE_ID, DML_TYPE, text.alias("key")), [CHANGE_ID], "no").select((F.col("no") - 1).cast("long").alias("no"), CHANGE_ID, DML_TYPE, "key")
    place = F.col("no") % rows
    own = F.floor(F.col("no") / rows).cast("long")
    dealt = computed(placed.withColumn("range", F.explode(F.when((place < size) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own)))))
    ranges = dealt.agg(F.coalesce(F.max("range"), F.lit(-1))).first()[0] + 1

    def read(piece: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        piece = piece.sort_values("no", ignore_index=True)
        step = next_starts(piece[DML_TYPE].to_numpy(), pd.factorize(piece["key"])[0], size)
        return piece, step, int((piece["no"] < (piece["range"].iloc[0] + 1) * rows).sum())

    def enters(piece: pd.DataFrame) -> pd.DataFrame:
        piece, step, n = read(piece)
        reach = step.copy()  # where the first group behind the range begins, from each row
        for i in range(n - 1, -1, -1):
            reach[i] = reach[step[i]] if step[i] < n else step[i]
        first = np.arange(min(size, n))
        return pd.DataFrame({"range": piece["range"].iloc[0], "entry": first, "leaves": reach[first] - n})

    maps = computed(dealt.groupBy("range").applyInPandas(enters, "range long, entry long, leaves long"))
    hop = 1
    while hop < ranges:  # maps of all ranges up to this one
        before = maps.select((F.col("range") + hop).alias("range"), F.col("entry").alias("from"), F.col("leaves").alias("entry"))
        longer = before.join(maps, ["range", "entry"]).select("range", F.col("from").alias("entry"), "leaves")
        maps = computed(longer.unionByName(maps.where(F.col("range") < hop)))
        hop *= 2
    entered = maps.where("entry = 0").select((F.col("range") + 1).alias("range"), F.col("leaves").alias("enters"))

    def listed(piece: pd.DataFrame) -> pd.DataFrame:
        enters_at = int(piece["enters"].iloc[0])
        piece, step, n = read(piece)
        starts = np.array(starts_from(enters_at, step, n))
        first, last = starts[:-1], starts[1:] - 1
        return pd.DataFrame({DML_TYPE: piece[DML_TYPE].to_numpy()[first], "first_id": piece[CHANGE_ID].to_numpy()[first], "last_id": piece[CHANGE_ID].to_numpy()[last], "n": last - first + 1})

    # the first range is entered at its first row
    whole = dealt.join(entered, "range", "left").withColumn("enters", F.coalesce("enters", F.lit(0)))
    groups = whole.groupBy("range").applyInPandas(listed, f"{DML_TYPE} long, first_id long, last_id long, n long")
    return numbered(computed(groups), ["first_id"], "group_no").select(F.col("group_no").cast("long").alias("group_no"), DML_TYPE, "first_id", "last_id", "n")
