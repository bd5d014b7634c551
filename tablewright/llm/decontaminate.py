"""Benchmark decontamination with a distributed positional inverted index.

Each benchmark item is cut into windows of `window` consecutive words (a shorter item is one
window). Term frequencies over the whole corpus name the rarest terms of each window;
postings (term, document, position) of these terms are stored and dealt by document, and their lists
are intersected from there: shifted by the term's offset on (document, start), which gives
phrases, and by overlapping stretches of the document, which gives places where all rarest terms of a
window stand near each other in any order. Both are then compared word by word with the
document. Only DataFrame functions run.

Null texts have no words, items without words have no windows, equal items and rows are all
counted, a null doc_id or item_id is an id of its own (items' ids are told apart as strings,
null left out of the list; rows of one doc_id share their postings and are compared one by one). Of
terms that are equally rare (ties) the one that stands first in the window is taken. Texts of any length
are cut whole. Very common terms are never looked up unless a window has no rarer ones. An empty
table of documents gives an empty result, an empty benchmark no matches. Extra columns, of whatever
name, pass through `decontaminate`.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.columns import quoted
from tablewright.llm._shared import small, stored

WINDOW = 10
RAREST = 3
SLOP = 12  # words within which the rarest terms of a window are near each other
PHRASE, NEAR = 0, 1


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words: digits, a-z and everything beyond ASCII."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """window_id, words, items (ids as strings): the distinct windows of all items. They are numbered, so they are to be stored before use."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    cut = F.when(n >= window, F.transform(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))), lambda i: F.slice("w", i, window))).otherwise(F.array("w"))
    each = items.select("item", F.explode(cut).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.monotonically_increasing_id().alias("window_id"), "words", "items")


def bytes_of(texts: str) -> Column:
    """Of a column of strings, or of arrays of them, about."""
    return F.octet_length(F.concat_ws(" ", texts)) + 32


def term_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences in all documents of the given terms."""
    each = docs.select(F.explode(words(F.col("text"))).alias("term"))
    near = small(terms, bytes_of("term"))
    counted = lambda frame: frame.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counted(each).join(terms, "term") if near is terms else counted(each.join(near, "term"))  # a join that shuffles gets counts, not words


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, position of every occurrence of the given terms."""
    each = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("position", "term"))
    return each.join(small(terms, bytes_of("term")), "term").select("term", "doc_id", "position")


def rarest_terms(windows: DataFrame, frequencies: DataFrame, rarest: int = RAREST) -> DataFrame:
    """term, window_id, offset, bit, whole (all bits of the window): the rarest terms of each window; windows with a word that the
    corpus lacks are left out."""
    each = windows.select("window_id", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term")).join(frequencies, "term")
    by = Window.partitionBy("window_id")
    ranked = each.withColumns({"place": F.row_number().over(by.orderBy("n", "offset")), "there": F.count(F.lit(1)).over(by)})
    power = lambda n: F.call_function("shiftleft", F.lit(1), n)
    kept = ranked.where((F.col("place") <= rarest) & (F.col("there") >= F.col("size")))
    return kept.select("term", "window_id", "offset", power(F.col("place") - 1).alias("bit"), (power(F.least("size", F.lit(rarest))) - 1).alias("whole"))


def intersected(index: DataFrame, rare: DataFrame, slop: int | None = SLOP) -> DataFrame:
    """doc_id, window_id, kind, at: where all rarest terms of a window stand at their offsets (PHRASE, at the window's start), and stretches
    of 2 * slop words from slop * at on that hold all of them (NEAR). Postings are dealt by document, so both are
    grouped where they are."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = index.repartition(parts, "doc_id").join(small(rare, F.octet_length("term") + 48), "term")
    place = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"))
    places = [place(PHRASE, F.col("position") - F.col("offset"))]
    if slop:
        cell = F.floor(F.col("position") / slop)
        places += [place(NEAR, cell), place(NEAR, cell - 1)]
    each = joined.select("doc_id", "window_id", "bit", "whole", F.inline(F.array(*places))).where("at >= 0 OR kind = 1")
    met = each.groupBy("doc_id", "window_id", "kind", "at").agg(F.bit_or("bit").alias("bits"), F.max("whole").alias("whole"))
    return met.where("bits = whole").select("doc_id", "window_id", "kind", "at")


def benchmark_index(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored windows, stored rarest terms, stored postings of these terms."""
    windows = stored(item_windows(benchmark, window), "windows")
    terms = windows.select(F.explode("words").alias("term")).distinct()
    frequencies = stored(term_frequencies(docs, terms), "frequencies")
    rare = stored(rarest_terms(windows, frequencies, rarest), "rarest")
    return windows, rare, stored(postings(docs, rare.select("term").distinct()), "postings")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST, slop: int | None = SLOP) -> DataFrame:
    """docs with n_words, hits (array of start, length, items: exact phrase matches) and near (ids of the windows whose rarest terms all
    stand within slop words of each other)."""
    windows, rare, index = benchmark_index(docs, benchmark, window, rarest)
    terms = rare.groupBy("window_id").agg(F.collect_set("term").alias("terms"))
    known = windows.join(terms, "window_id").select("window_id", "words", "items", "terms")
    of_kind = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    found = intersected(index, rare, slop).join(small(known, bytes_of("words") + bytes_of("items") + bytes_of("terms")), "window_id")
    found = found.groupBy("doc_id").agg(F.collect_set(F.struct("window_id", "at", of_kind(PHRASE, "words").alias("words"), of_kind(PHRASE, "items").alias("items"), of_kind(NEAR, "terms").alias("terms"))).alias("found")).withColumnRenamed("doc_id", "found_in")
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("found_in")), "left").drop("found_in").withColumn("doc_words", words(F.col("text")))
    same = lambda c: c["words"].isNotNull() & (F.slice("doc_words", c["at"] + 1, F.size(c["words"])) == c["words"])
    every = F.coalesce("found", F.array())
    hits = F.transform(F.filter(every, same), lambda c: F.struct(c["at"].alias("start"), F.size(c["words"]).alias("length"), c["items"].alias("items")))
    out = {"n_words": F.size("doc_words").cast("long"), "hits": hits}
    if slop:
        stretch = lambda c, i: F.slice("doc_words", F.greatest(c["at"] * slop + i, F.lit(0)) + 1, slop + 1)
        together = lambda c: F.exists(F.sequence(F.lit(0), F.lit(slop - 1)), lambda i: F.size(F.array_intersect(c["terms"], stretch(c, i))) == F.size(c["terms"]))
        near = F.filter(every, lambda c: c["terms"].isNotNull() & (c["at"] >= 0) & together(c))
        out["near"] = F.array_distinct(F.transform(near, lambda c: c["window_id"]))
    return joined.withColumns(out).drop("doc_words", "found")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (windows with a proximity match)."""
    hit = benchmark_hits(docs.select("doc_id", "text"), benchmark, window)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    out = hit.select("doc_id", "n_words", F.size(covered).cast("long").alias("n_hit"), items.alias("items"), F.size("near").cast("long").alias("n_near"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any benchmark window, all columns unchanged."""
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")
    hit = benchmark_hits(docs.select(row, "doc_id", "text"), benchmark, window, slop=None)
    return hit.where(F.size("hits") == 0).select("row.*")
