"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.bpe import bpe_round_trip
from tablewright.llm.chat import chat_examples, conversation_digests
from tablewright.llm.decontaminate import contamination
from tablewright.llm.hard_negatives import hard_negatives
from tablewright.llm.lexical_search import ranked_search
from tablewright.llm.licenses import license_scan
from tablewright.llm.ngram_join import jaccard_join
from tablewright.llm.quality import quality_rules
from tablewright.llm.sharding import shard_documents
from tablewright.llm.substring import substring_digests
from tablewright.llm.suffix_dedup import repeat_digests
from tablewright.llm._shared import shared_path
from tablewright.llm.token_files import read_tokens, token_digests, write_tokens
from tablewright.llm.toxicity import toxicity

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir)).drop("n_links")


def op2_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with the number of links of each document's class."""
    return jaccard_join(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path(VOCABULARY), END_ID)
    return token_digests(read_tokens(spark, path))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(documents(spark, sf_dir).select("doc_id", "text"), SHARDS, shared_path(spark, "shard-map"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = F.lit(r"\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return conversation_digests(chat_examples(turns))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(documents(spark, sf_dir))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = toxicity(documents(spark, sf_dir), labels, threshold=0.7)
    return found.select("doc_id", "held_out", "score", "predicted", "n_windows", F.size("spans").alias("n_toxic_windows"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives(rows, anchors=F.col("vec_id") % 100 == 0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_ngram_join, op2_ngram_links, op3_token_files, op4_bpe, op5_substring_dedup, op6_sharding, op7_chat_format, op8_license_scan, op9_decontamination, op10_suffix_dedup, op11_toxicity, op12_hard_negatives, op13_lexical_search)
}

_WORDS5 = r"""list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"""



def _quality_sql(levels: int = 16) -> str:
    """The quality rules for texts of under 2 ** levels words. h<k> stands for the 2 ** k words from a place; the longest
    repeat of a text is found bit by bit, as what repeats has prefixes that repeat."""
    doubled = "".join(f"h{k + 1} AS (SELECT *, CASE WHEN lead(h{k}, {1 << k}) OVER w IS NOT NULL THEN hash(h{k}, lead(h{k}, {1 << k}) OVER w) END AS h{k + 1} FROM h{k} WINDOW w AS (PARTITION BY doc_id ORDER BY i)),\n" for k in range(levels - 1))
    longest, before = "", f"(SELECT *, 0 AS n, 0::UBIGINT AS g FROM h{levels - 1})"
    for k in range(levels - 1, -1, -1):
        tried = f"SELECT *, CASE WHEN g IS NOT NULL AND lead(h{k}, n) OVER (PARTITION BY doc_id ORDER BY i) IS NOT NULL THEN hash(g, lead(h{k}, n) OVER (PARTITION BY doc_id ORDER BY i)) END AS c FROM {before}"
        longest += f"a{k} AS ({tried}),\nb{k} AS (SELECT a{k}.*, twice FROM a{k} LEFT JOIN (SELECT doc_id, count(c) > count(DISTINCT c) AS twice FROM a{k} GROUP BY doc_id) USING (doc_id)),\n"
        longest += f"g{k} AS (SELECT * EXCLUDE (c, twice) REPLACE (CASE WHEN twice THEN n + {1 << k} ELSE n END AS n, CASE WHEN twice THEN c ELSE g END AS g) FROM b{k}),\n"
        before = f"g{k}"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS5.format(t="coalesce(text, '')")} AS w FROM documents),
h0 AS (SELECT doc_id, i, w[i] AS word, hash(w[i]) AS h0 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
{doubled}{longest}r AS (SELECT doc_id, i, word, h3 IS NOT NULL AND count(h3) OVER (PARTITION BY doc_id, h3) > 1 AS again FROM h{levels - 1}),
c AS (SELECT doc_id, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM r),
s AS (SELECT doc_id, count(*) FILTER (hit) AS n_repeat_words, sum(length(word)) FILTER (hit) AS covered_chars FROM c GROUP BY doc_id),
m AS (SELECT doc_id, CASE WHEN max(n) >= 8 THEN max(n) ELSE 0 END AS longest_repeat FROM g0 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY doc_id),
a AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ 	-
]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(covered_chars, 0)::BIGINT AS covered_chars, coalesce(longest_repeat, 0)::BIGINT AS longest_repeat
  FROM d LEFT JOIN s USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND covered_chars <= 0.3::DOUBLE * word_chars AND longest_repeat <= greatest(200, 0.25::DOUBLE * n_words) AS kept FROM f"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": _quality_sql(),
    "op2_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS5.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT *, min(doc_id) OVER (PARTITION BY shingles) AS class_id FROM (SELECT doc_id, count(*) AS n, md5(string_agg(k, chr(10) ORDER BY k)) AS shingles FROM s GROUP BY doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (k) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, coalesce(any_value(class_id), d.doc_id) AS class_id FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
    "op10_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
x AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM m)),
c AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM x GROUP BY doc_id, span),
t AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM c),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head, max(b) AS last FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op5_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS5.format(t="coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM s),
o AS (SELECT k, min(doc_id) AS owner FROM g GROUP BY k),
h AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT g.doc_id, g.i FROM g JOIN o USING (k) WHERE o.owner < g.doc_id), range(0, 13) AS r(j)),
x AS (SELECT doc_id, list(p) AS gone FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda v, p: NOT list_contains(coalesce(gone, []), p)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)""",
    "op7_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + length('<turn ></turn>') AS size,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS total FROM c),
f AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR k = total)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id""",
    "op12_hard_negatives": """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
e AS (SELECT vec_id, label, list_transform(x, lambda v: floor(256 * v::DOUBLE)) AS x FROM r WHERE len(list_filter(x, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10""",
    "op13_lexical_search": r"""
WITH c AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT r, doc_id, unnest(list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM c),
f AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM d GROUP BY r, term),
l AS (SELECT r, sum(tf)::BIGINT AS n FROM f GROUP BY r),
z AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM l),
g AS (SELECT term, count(*) AS df FROM f GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM g, z),
i AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))) AS impact FROM f JOIN l USING (r) JOIN w USING (term), z WHERE term IN (SELECT term FROM q)),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY item_id, r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""",
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM i),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n)),
m AS (SELECT g.doc_id, g.i, g.n, i.item_id FROM g JOIN i USING (n, k)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id),
o AS (SELECT doc_id, w[i] AS term, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
q AS (SELECT DISTINCT w AS k, unnest(range(1, len(w) + 1)) AS o, w[unnest(range(1, len(w) + 1))] AS term FROM (SELECT DISTINCT w[i:i + 9] AS w FROM (SELECT w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
c AS (SELECT q.*, n, row_number() OVER (PARTITION BY k ORDER BY n, o) AS place, count(*) OVER (PARTITION BY k) AS there FROM q JOIN (SELECT term, count(*) AS n FROM o GROUP BY term) USING (term)),
r AS (SELECT doc_id, k, i, place FROM c JOIN o USING (term) WHERE place <= 3 AND there = len(k)),
v AS (SELECT doc_id, count(DISTINCT k) AS n_near FROM (SELECT r.doc_id, r.k FROM r JOIN r x ON x.doc_id = r.doc_id AND x.k = r.k AND x.i BETWEEN r.i AND r.i + 12 GROUP BY r.doc_id, r.k, r.i HAVING count(DISTINCT x.place) = least(3, len(any_value(r.k)))) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN v USING (doc_id)""",
}

_joined, _columns = ORACLE_SQL["op2_ngram_join"].split("\nSELECT d.doc_id, ")
ORACLE_SQL["op2_ngram_links"] = rf"""{_joined},
h AS (SELECT doc_id FROM n WHERE doc_id = class_id),
c AS (SELECT a AS class_id, count(*) AS n_links FROM e WHERE a IN (SELECT doc_id FROM h) AND b IN (SELECT doc_id FROM h) GROUP BY a),
j AS (SELECT d.doc_id, {_columns})
SELECT j.*, coalesce(n_links, 0)::BIGINT AS n_links FROM j LEFT JOIN c USING (class_id)"""
