"""Queries of the migration engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import after, collated, md5_prefix
from tablewright.migrate import PREFIXES, Migration, copied, first_of_duplicates
from tablewright.operators import capture, chunks, gaps, replay, tree, uniques, verify
from tablewright.operators.partitioned import PartitionedCopy
from tablewright.plans.diff import SchemaDiff
from tablewright.plans.partitions import parse_partitions, sync_actions
from tablewright.plans.schema import parse_table
from tablewright.sources.shared import checkpoint_folder
from tablewright.sources.tables import foreign_keys, scan
from tablewright.streaming.replay_stream import ReplayTarget, replay_ranges
from tablewright.streaming.verified import VerifiedChanges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CHUNK = 999

OLD_ORDERS = "CREATE TABLE orders (o_orderkey BIGINT NOT NULL, o_custkey BIGINT, o_orderstatus VARCHAR(1), o_totalprice DOUBLE, o_orderdate DATETIME, o_orderpriority VARCHAR(15), PRIMARY KEY (o_orderkey))"
NEW_ORDERS = "CREATE TABLE orders (o_orderkey BIGINT NOT NULL, o_custkey BIGINT, o_orderstatus VARCHAR(1), o_orderdate DATETIME, o_orderpriority VARCHAR(30), o_note VARCHAR(10) NOT NULL DEFAULT '', PRIMARY KEY (o_orderkey), KEY ix_cust (o_custkey))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a change log of customers: hot keys, and changes that often fit no row."""
    kind = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 2).otherwise(3).cast("long")
    return read(spark, d, "events").select((F.col("event_id") + 1).alias("change_id"), kind.alias("dml_type"), F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment"))


LOG = "(SELECT event_id + 1 AS change_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 ELSE 3 END::BIGINT AS dml_type, user_id AS c_custkey, event_type AS c_mktsegment FROM events)"


def customers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o, digit = orders(spark, d), F.col("o_orderkey") % 10
    return o.where(digit < 8), o.where(digit >= 2).withColumn("o_orderstatus", F.when(digit.isin(2, 3), "X").otherwise(F.col("o_orderstatus")))


SNAP = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders), a AS (SELECT * FROM o WHERE o_orderkey % 10 < 8),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 IN (2, 3) THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM o WHERE o_orderkey % 10 >= 2) """
HASH = "('0x' || substr(md5({c}::VARCHAR), 1, 15))::BIGINT"
XOR = lambda c: f"coalesce(bit_xor({HASH.format(c=c)}), 0)::BIGINT AS {c.split('.')[-1]}"
CHECKED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
#: CRC-32 of a value's text, out of a table t of the 256 remainders.
CRC = "CASE WHEN {c} IS NOT NULL THEN xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(range(length({c}::VARCHAR)), lambda k: ascii(substr({c}::VARCHAR, k + 1, 1))::UBIGINT), lambda r, x: xor(r // 256, t[xor(r % 256, x)::BIGINT + 1])))::BIGINT END AS {c}"
SUMS = "count(*) AS cnt, " + ", ".join(map(XOR, CHECKED))
NUMBERED = f"(SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // {CHUNK} AS chunk_id FROM orders)"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def scan_full_projection(spark, d):
    return scan(read(spark, d, "orders"), CHECKED)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey > 100 AND o_orderstatus = 'F'")
def scan_where_filter(spark, d):
    return scan(read(spark, d, "orders"), ["o_orderkey", "o_orderpriority"], "o_custkey > 100 AND o_orderstatus = 'F'")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id > 10 OR (conv_id = 10 AND turn > 2)")
def scan_range_after_key(spark, d):
    return read(spark, d, "conversations").where(after(["conv_id", "turn"], [10, 2])).select("conv_id", "turn", "role")


@query(f"SELECT chunk_id, count(*) AS cnt FROM {NUMBERED} GROUP BY chunk_id")
def chunk_assign_counts(spark, d):
    return chunks.chunk_counts(orders(spark, d), ["o_orderkey"], CHUNK)


@query(f"SELECT chunk_id, min(o_orderkey) AS first_o_orderkey, max(o_orderkey) AS last_o_orderkey FROM {NUMBERED} GROUP BY chunk_id")
def chunk_boundaries(spark, d):
    return chunks.boundaries(orders(spark, d), ["o_orderkey"], CHUNK)


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id > 10 OR (conv_id = 10 AND turn > 2) ORDER BY conv_id, turn LIMIT 101")
def chunk_next_page(spark, d):
    return chunks.next_page(read(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], after(["conv_id", "turn"], [10, 2]), 101)


@query(f"SELECT change_id, dml_type, c_custkey FROM {LOG} WHERE change_id > 100 AND change_id <= 600")
def delta_range_scan(spark, d):
    return capture.in_range(log(spark, d), 100, 600).select("change_id", "dml_type", "c_custkey")


@query(f"SELECT change_id, dml_type, c_custkey FROM {LOG} WHERE change_id IN (1, 98, 195)")
def delta_point_lookup(spark, d):
    wanted = spark.createDataFrame([(1,), (98,), (195,)], "change_id long")
    return capture.by_ids(log(spark, d), wanted).select("change_id", "dml_type", "c_custkey")


@query(f"SELECT least(coalesce(max(change_id), 0), 5000)::BIGINT AS max_id FROM {LOG}")
def delta_max_id(spark, d):
    return capture.last_id(log(spark, d), 5000)


@query(f"SELECT coalesce(max(change_id), 0)::BIGINT AS max_id FROM {LOG}")
def delta_max_id_whole(spark, d):
    return capture.last_id(log(spark, d))


@query("SELECT 0::BIGINT AS change_id, 0::BIGINT AS dml_type, c_custkey, c_name, c_mktsegment FROM customer LIMIT 0")
def delta_schema_clone(spark, d):
    return capture.empty_log(customers(spark, d))


@query("""SELECT column_index::INTEGER AS place, column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END AS type
FROM (SELECT 1 AS column_index, 'change_id' AS column_name, 'BIGINT' AS data_type UNION ALL SELECT 2, 'dml_type', 'BIGINT'
UNION ALL SELECT 2 + row_number() OVER (ORDER BY column_index), column_name, data_type FROM duckdb_columns() WHERE table_name = 'customer' AND column_name IN ('c_custkey', 'c_name', 'c_mktsegment'))""")
def delta_schema_columns(spark, d):
    """Columns of the change log of customers, described."""
    return capture.describe(capture.empty_log(customers(spark, d)))


def _captured(spark, d, kind):
    old, new = snapshots(spark, d)
    return capture.snapshot_changes(old, new, ["o_orderkey"]).where(F.col("dml_type") == kind)


@query(SNAP + "SELECT 1::BIGINT AS dml_type, b.* FROM b ANTI JOIN a USING (o_orderkey)")
def capture_inserts(spark, d):
    return _captured(spark, d, 1)


@query(SNAP + "SELECT 2::BIGINT AS dml_type, a.* FROM a ANTI JOIN b USING (o_orderkey)")
def capture_deletes(spark, d):
    return _captured(spark, d, 2)


@query(SNAP + "SELECT 3::BIGINT AS dml_type, b.* FROM a JOIN b USING (o_orderkey) WHERE (a.o_custkey, a.o_orderstatus, a.o_orderpriority) IS DISTINCT FROM (b.o_custkey, b.o_orderstatus, b.o_orderpriority)")
def capture_updates(spark, d):
    return _captured(spark, d, 3)


@query("""SELECT o_orderkey AS change_id, 0 AS part, 3::BIGINT AS dml_type, o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, 0, 2, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, 1, 1, -1 - o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 7 = 0""")
def capture_key_moves(spark, d):
    moved = F.when(F.col("o_orderkey") % 7 == 0, -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    images = orders(spark, d).select(F.col("o_orderkey").alias("change_id"), F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v")).alias("before"), F.struct(moved.alias("k"), F.col("o_orderpriority").alias("v")).alias("after"))
    return capture.image_changes(images, ["k"])


@query(f"SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {LOG} WHERE dml_type = 2)")
def replay_delete(spark, d):
    return replay.delete_matching(customers(spark, d), log(spark, d), ["c_custkey"])


@query(f"SELECT c.c_custkey, c_name, CASE WHEN l.c_custkey IS NULL THEN c.c_mktsegment ELSE l.v END AS c_mktsegment FROM customer c LEFT JOIN (SELECT c_custkey, arg_max(c_mktsegment, change_id) AS v FROM {LOG} WHERE dml_type = 3 GROUP BY c_custkey) l USING (c_custkey)")
def replay_update(spark, d):
    return replay.update_matching(customers(spark, d), log(spark, d), ["c_custkey"])


@query(f"SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM {LOG} WHERE dml_type = 1")
def replay_insert(spark, d):
    return replay.insert_rows(customers(spark, d).drop("c_name"), log(spark, d), ["c_custkey"])


@query(f"WITH b AS (SELECT c_custkey, c_mktsegment FROM customer) SELECT * FROM b UNION ALL SELECT c_custkey, arg_min(c_mktsegment, change_id) FROM {LOG} WHERE dml_type = 1 AND c_custkey NOT IN (SELECT c_custkey FROM b) GROUP BY c_custkey")
def replay_insert_ignore(spark, d):
    base = customers(spark, d).drop("c_name")
    return replay.insert_rows(base, log(spark, d), ["c_custkey"], ignore=True)


@query(f"SELECT c_custkey, c_name, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM {LOG} l WHERE l.dml_type = 2 AND l.c_custkey = c.c_custkey)")
def replay_delete_whole(spark, d):
    return replay.delete_matching(customers(spark, d), log(spark, d), ["c_custkey"])


@query(f"SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM {LOG} WHERE dml_type = 1")
def replay_insert_whole(spark, d):
    return replay.insert_rows(customers(spark, d).drop("c_name"), log(spark, d), ["c_custkey"])


@query(f"SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey, arg_min(c_mktsegment, change_id) FROM {LOG} WHERE dml_type = 1 AND c_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY c_custkey")
def replay_insert_ignore_whole(spark, d):
    return replay.insert_rows(customers(spark, d).drop("c_name"), log(spark, d), ["c_custkey"], ignore=True)


FOLD = f"""WITH l AS (SELECT * FROM {LOG}), s AS (SELECT c_custkey, max(change_id) FILTER (dml_type = 2) AS del FROM l GROUP BY c_custkey),
b AS (SELECT s.c_custkey, del, min(l.change_id) FILTER (l.dml_type = 1 AND (del IS NULL OR l.change_id > del)) AS ins FROM s JOIN l USING (c_custkey) GROUP BY ALL),
f AS (SELECT b.*, CASE WHEN del IS NULL AND c.c_custkey IS NOT NULL THEN 0 ELSE ins END AS birth FROM b LEFT JOIN customer c USING (c_custkey)),
u AS (SELECT f.c_custkey, arg_max(l.c_mktsegment, l.change_id) AS v FROM f JOIN l USING (c_custkey) WHERE l.dml_type = 3 AND l.change_id > f.birth GROUP BY ALL)
SELECT c.c_custkey, c.c_name, coalesce(u.v, c.c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN f USING (c_custkey) LEFT JOIN u USING (c_custkey) WHERE f.c_custkey IS NULL OR f.birth = 0
UNION ALL SELECT f.c_custkey, NULL, coalesce(u.v, l.c_mktsegment) FROM f JOIN l ON l.change_id = f.ins LEFT JOIN u ON u.c_custkey = f.c_custkey WHERE f.birth > 0"""


@query(FOLD)
def replay_fold_ignore(spark, d):
    return replay.folded(customers(spark, d), log(spark, d), ["c_custkey"])


@query(f"SELECT c_custkey, max(change_id) AS change_id, arg_max(dml_type, change_id) AS dml_type, arg_max(c_mktsegment, change_id) AS c_mktsegment FROM {LOG} GROUP BY c_custkey")
def replay_last_writer_wins(spark, d):
    return replay.last_writer(log(spark, d), ["c_custkey"])


@query(f"""WITH l AS (SELECT l.*, c.c_custkey IS NOT NULL AS there FROM {LOG} l LEFT JOIN customer c USING (c_custkey)),
s AS (SELECT *, coalesce(last_value(CASE dml_type WHEN 1 THEN true WHEN 2 THEN false END IGNORE NULLS) OVER (PARTITION BY c_custkey ORDER BY change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), there) AS st FROM l)
SELECT change_id, dml_type, c_custkey, c_mktsegment FROM s WHERE (dml_type = 2 AND NOT st) OR (dml_type = 1 AND st)""")
def replay_affected_violations(spark, d):
    return replay.violations(customers(spark, d), log(spark, d), ["c_custkey"])


@query(f"""WITH l AS (SELECT change_id, dml_type, sum(CASE WHEN dml_type = 3 THEN 1 WHEN dml_type IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (ORDER BY change_id) AS run FROM (SELECT *, lag(dml_type) OVER (ORDER BY change_id) AS p FROM {LOG})),
g AS (SELECT *, (row_number() OVER (PARTITION BY run ORDER BY change_id) - 1) // 200 AS part FROM l)
SELECT row_number() OVER (ORDER BY min(change_id)) AS group_no, min(dml_type) AS dml_type, min(change_id) AS first_id, max(change_id) AS last_id, count(*) AS n FROM g GROUP BY run, part""")
def replay_groups_islands(spark, d):
    return replay.change_groups(log(spark, d), 200)


@query(f"""WITH RECURSIVE l AS (SELECT row_number() OVER (ORDER BY change_id) AS i, * FROM {LOG}),
p AS (SELECT i, change_id, dml_type, dml_type IS DISTINCT FROM lag(dml_type) OVER (ORDER BY i) AS opens, CASE WHEN dml_type = 3 THEN lag(i) OVER (PARTITION BY dml_type, c_custkey ORDER BY i) END AS before FROM l),
f AS (SELECT p.i, least(p.i + 200, coalesce(min(CASE WHEN p.opens THEN p.i END) OVER (ORDER BY p.i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), count(*) OVER () + 1), coalesce(min(q.i) OVER (ORDER BY p.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), p.i + 200)) AS next FROM p LEFT JOIN p q ON q.before = p.i),
g AS (SELECT i FROM p WHERE opens UNION SELECT f.next FROM g JOIN f USING (i)),
s AS (SELECT i, lead(i) OVER (ORDER BY i) - 1 AS last FROM g)
SELECT row_number() OVER (ORDER BY s.i) AS group_no, a.dml_type, a.change_id AS first_id, b.change_id AS last_id, b.i - a.i + 1 AS n FROM s JOIN p a ON a.i = s.i JOIN p b ON b.i = coalesce(s.last, (SELECT max(i) FROM p)) WHERE s.i <= (SELECT max(i) FROM p)""")
def replay_groups_distinct_keys(spark, d):
    """Updates grouped too, none of which has a key that its group has updated before."""
    return replay.change_groups(log(spark, d), 200, grouped_updates=True, keys=["c_custkey"])


@query(f"SELECT dml_type, count(*) AS n FROM {LOG} GROUP BY dml_type")
def replay_counts_by_type(spark, d):
    return replay.counts_by_type(log(spark, d))


def _holes(spark, d):
    return log(spark, d).where("(change_id - 1) % 97 <> 0")


@query(f"WITH l AS (SELECT change_id FROM {LOG} WHERE (change_id - 1) % 97 <> 0) SELECT i AS missing_id FROM range(1, (SELECT max(change_id) FROM l)) t(i) WHERE i NOT IN (SELECT change_id FROM l)")
def gap_ids(spark, d):
    return gaps.gap_ids(_holes(spark, d))


@query(FOLD.replace(LOG, f"(SELECT CASE WHEN (change_id - 1) % 97 = 0 THEN change_id - 1000000000 ELSE change_id END + 1000000000 AS change_id, dml_type, c_custkey, c_mktsegment FROM {LOG})"))
def gap_filled_replay(spark, d):
    """Late ids first, then the range: as a round does that finds its gaps filled."""
    late = (F.col("change_id") - 1) % 97 == 0
    return replay.folded(customers(spark, d), log(spark, d).withColumn("place", F.when(late, F.col("change_id")).otherwise(F.col("change_id") + 1_000_000_000)), ["c_custkey"], "place")


@query(FOLD)
def replay_in_versions(spark, d):
    """The log replayed in ranges, each one a committed version of the table, and the last version read."""
    target = ReplayTarget(spark, f"{checkpoint_folder(spark).rstrip('/')}/versions-{uuid.uuid4().hex}", ["c_custkey"], buckets=8)
    target.start(customers(spark, d))
    changes = log(spark, d)
    replay_ranges(changes, target, max(1, -(-capture.last_id(changes).first()[0] // 3)))
    return target.table()


CASELESS = FOLD.replace(LOG, "l0").replace("WITH l AS (SELECT * FROM l0)", f"WITH l AS (SELECT change_id, dml_type, lower('CUSTOMER ' || c_custkey) AS c_custkey, c_mktsegment FROM {LOG})").replace("FROM customer c", "FROM c0 c").replace("JOIN customer c", "JOIN c0 c").replace("WITH l AS", "WITH c0 AS (SELECT lower('Customer ' || c_custkey) AS c_custkey, c_name, c_mktsegment FROM customer), l AS")


@query(f"SELECT c_custkey AS name, c_name, c_mktsegment FROM ({CASELESS})")
def replay_caseless_keys(spark, d):
    """Text keys that differ in case only are one key: of the table and of the log, by the columns' collation."""
    named = lambda frame, how: collated(frame.withColumn("c_custkey", how), {"c_custkey": "UTF8_LCASE"})
    number = F.col("c_custkey").cast("string")
    table = named(customers(spark, d), F.concat(F.lit("Customer "), number))
    changes = named(log(spark, d), F.concat(F.when(F.col("change_id") % 2 == 0, "CUSTOMER ").otherwise("customer "), number))
    return replay.folded(table, changes, ["c_custkey"]).select(F.lower(F.col("c_custkey").cast("string")).cast("string").alias("name"), "c_name", "c_mktsegment")


@query(f"SELECT c_custkey, min(change_id) AS change_id FROM {LOG}, (SELECT max(change_id) // 2 AS half FROM {LOG}) WHERE change_id > half GROUP BY c_custkey UNION ALL SELECT c_custkey, min(change_id) FROM {LOG}, (SELECT max(change_id) // 2 AS half FROM {LOG}) WHERE change_id <= half GROUP BY c_custkey")
def delta_checksum_rounds(spark, d):
    """The keys that two rounds of verification look at, each round only at those of its own changes, between the fold and the versions of a replay."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/verified-{uuid.uuid4().hex}"
    store = VerifiedChanges(spark, path, ["c_custkey"], ["c_custkey", "c_mktsegment"])
    store.start()
    changes, base = log(spark, d), customers(spark, d).drop("c_name")
    target = ReplayTarget(spark, f"{path}-versions", ["c_custkey"], buckets=8)
    target.start(base)
    half = capture.last_id(changes).first()[0] // 2
    for high in (half, None):
        upto = capture.in_range(changes, 0, high)
        replay_ranges(upto, target)
        store.round(changes, target.table(), replay.folded(base, upto, ["c_custkey"]), high)
    return store.touched()


@query(f"SELECT * FROM {LOG} l WHERE NOT EXISTS (SELECT 1 FROM {LOG} t WHERE t.c_custkey = l.c_custkey AND t.change_id < l.change_id)")
def first_touch_changes(spark, d):
    return verify.first_touches(log(spark, d), ["c_custkey"])


@query(f"""WITH f AS (SELECT c_custkey, min(change_id) AS id FROM {LOG} GROUP BY c_custkey)
SELECT (id - 1) // 500 AS window_no, count(*) AS cnt, {XOR('c.c_custkey')}, {XOR('c.c_name')}, {XOR('c.c_mktsegment')} FROM f LEFT JOIN customer c USING (c_custkey) GROUP BY 1""")
def delta_checksum_windows(spark, d):
    return verify.by_change_window(customers(spark, d), log(spark, d), ["c_custkey"], ["c_custkey", "c_name", "c_mktsegment"], 0, None, 500, md5_prefix)


@query(f"SELECT {SUMS} FROM orders")
def checksum_full(spark, d):
    return verify.whole(orders(spark, d), CHECKED, md5_prefix)


@query(f"""WITH b AS (SELECT i, list_reduce([i::UBIGINT] || range(8)::UBIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS c FROM range(256) t(i)),
t AS (SELECT list(c ORDER BY i) AS t FROM b),
h AS (SELECT {', '.join(CRC.format(c=c) for c in CHECKED)} FROM orders, t)
SELECT count(*) AS cnt, {', '.join(f'coalesce(bit_xor({c}), 0)::BIGINT AS {c}' for c in CHECKED)} FROM h""")
def checksum_full_crc32(spark, d):
    return verify.whole(orders(spark, d), CHECKED)


@query()
def checksum_native_strong(spark, d):
    return verify.strong(orders(spark, d), CHECKED)


@query(f"""SELECT coalesce(sum(('0x' || substr(md5(concat_ws(',', {', '.join(f"coalesce('=' || hex(encode({c}::VARCHAR)), '-')" for c in sorted(CHECKED))})), 1, 15))::BIGINT), 0)::DECIMAL(38, 0)::VARCHAR AS checksum FROM orders""")
def checksum_strong_portable(spark, d):
    return verify.strong_portable(orders(spark, d), CHECKED).select(F.col("checksum").cast("string"))


@query(f"SELECT chunk_id, {SUMS} FROM {NUMBERED} GROUP BY chunk_id")
def checksum_by_chunk(spark, d):
    return verify.by_chunk(orders(spark, d), ["o_orderkey"], CHUNK, CHECKED, md5_prefix)


def _mutated(spark, d):
    return orders(spark, d).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4001 == 17, "Z").otherwise(F.col("o_orderstatus")))


@query(f"""WITH a AS (SELECT chunk_id, {SUMS} FROM {NUMBERED} GROUP BY chunk_id),
b AS (SELECT chunk_id, {SUMS} FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 4001 = 17 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus) FROM {NUMBERED}) GROUP BY chunk_id)
SELECT chunk_id, a.cnt AS cnt_old, b.cnt AS cnt_new, 'o_orderstatus' AS mismatched FROM a JOIN b USING (chunk_id) WHERE a.o_orderstatus <> b.o_orderstatus""")
def checksum_compare_chunks(spark, d):
    sums = lambda t: verify.by_chunk(t, ["o_orderkey"], CHUNK, CHECKED, md5_prefix)
    return verify.compared(sums(orders(spark, d)), sums(_mutated(spark, d)), "chunk_id", CHECKED)


@query(f"""WITH a AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // {CHUNK} AS chunk_id FROM orders WHERE o_orderkey % 5000 <> 7),
cuts AS (SELECT chunk_id, min(o_orderkey) AS low FROM a GROUP BY chunk_id),
b AS (SELECT o.* REPLACE (CASE WHEN o_orderkey % 4001 = 17 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus), coalesce(chunk_id, 0) AS chunk_id FROM orders o ASOF LEFT JOIN cuts ON o.o_orderkey >= cuts.low),
x AS (SELECT chunk_id, {SUMS} FROM a GROUP BY chunk_id), y AS (SELECT chunk_id, {SUMS} FROM b GROUP BY chunk_id)
SELECT chunk_id, CASE WHEN chunk_id > 0 THEN low ELSE 0 END AS first_o_orderkey, x.cnt AS cnt_old, y.cnt AS cnt_new, array_to_string(list_filter([{', '.join(f"CASE WHEN x.{c} <> y.{c} THEN '{c}' END" for c in CHECKED)}], lambda v: v IS NOT NULL), ',') AS mismatched
FROM x JOIN y USING (chunk_id) JOIN cuts USING (chunk_id) WHERE x.cnt <> y.cnt OR ({' OR '.join(f'x.{c} <> y.{c}' for c in CHECKED)})""")
def checksum_tree_chunks(spark, d):
    """Chunks that differ by cuts that both sides share: rows of one side only change their own chunk and no later one."""
    return tree.differing_chunks(orders(spark, d).where("o_orderkey % 5000 <> 7"), _mutated(spark, d), ["o_orderkey"], CHECKED, CHUNK, 4, md5_prefix).fillna(0, ["first_o_orderkey"])


@query(f"SELECT coalesce(bit_xor(xor(xor(xor(xor(cnt, o_orderkey), o_custkey), o_orderstatus), o_orderpriority)), 0)::BIGINT AS fingerprint FROM (SELECT chunk_id, {SUMS} FROM {NUMBERED} GROUP BY chunk_id)")
def checksum_fingerprint(spark, d):
    return verify.fingerprint(checksum_by_chunk(spark, d), CHECKED)


@query("WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders), b AS (SELECT * REPLACE (CASE WHEN o_orderkey % 4001 = 17 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus) FROM a) SELECT 'old' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'new', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def mismatch_drilldown(spark, d):
    return verify.row_differences(orders(spark, d), _mutated(spark, d))


@query("SELECT count(*) AS total, count(*) FILTER (TRY_CAST(o_orderstatus AS INTEGER) IS NULL) AS not_castable, count(*) FILTER (TRY_CAST(o_orderkey AS SMALLINT) IS NULL) AS overflowing FROM orders")
def type_change_cast(spark, d):
    bad = lambda c, t: F.count(F.when(F.col(c).try_cast(t).isNull(), 1))
    return orders(spark, d).agg(F.count(F.lit(1)).alias("total"), bad("o_orderstatus", "int").alias("not_castable"), bad("o_orderkey", "smallint").alias("overflowing"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, '' AS o_note FROM orders")
def new_column_default(spark, d):
    return copied(read(spark, d, "orders"), parse_table(NEW_ORDERS)).drop("o_orderdate")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_key_violations(spark, d):
    return verify.duplicates(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT text, doc_id FROM (SELECT text, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def eliminate_dups_first_wins(spark, d):
    return first_of_duplicates(read(spark, d, "documents").select("text", "doc_id"), ["text"], ["doc_id"])


@query("""SELECT unnest(list_reduce(list(struct_pack(a := [o_custkey::VARCHAR || ' ' || o_orderstatus], b := [o_orderdate::VARCHAR], taken := [o_orderkey]) ORDER BY o_orderkey),
lambda x, y: CASE WHEN list_has_any(x.a, y.a) OR list_has_any(x.b, y.b) THEN x ELSE struct_pack(a := list_concat(x.a, y.a), b := list_concat(x.b, y.b), taken := list_concat(x.taken, y.taken)) END).taken) AS o_orderkey FROM orders""")
def insert_ignore_several_keys(spark, d):
    """Orders taken one by one under three unique keys, each refused that meets one taken before."""
    rows = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return uniques.accepted(rows, [["o_orderkey"], ["o_custkey", "o_orderstatus"], ["o_orderdate"]], ["o_orderkey"]).select("o_orderkey")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey % 5 = 0 AND x.l_orderkey = lineitem.l_orderkey AND x.l_partkey = lineitem.l_partkey AND x.l_suppkey = lineitem.l_suppkey AND x.l_linenumber = lineitem.l_linenumber)")
def full_row_identity_replay(spark, d):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = read(spark, d, "lineitem").select(*keys)
    return replay.delete_matching(rows, rows.where("l_orderkey % 5 = 0").withColumn("dml_type", F.lit(2)), keys)


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN o_orderkey < 1000 THEN 'p0' WHEN o_orderkey < 5000 THEN 'p1' ELSE 'pmax' END AS part FROM orders) GROUP BY part")
def range_partition_assign(spark, d):
    return _assigned(spark, d, "RANGE (o_orderkey) (PARTITION p0 VALUES LESS THAN (1000), PARTITION p1 VALUES LESS THAN (5000), PARTITION pmax VALUES LESS THAN MAXVALUE)")


@query("SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN 'done' WHEN o_orderstatus = 'P' THEN 'open' END AS part, count(*) AS n FROM orders GROUP BY 1")
def list_partition_assign(spark, d):
    return _assigned(spark, d, "LIST COLUMNS (o_orderstatus) (PARTITION done VALUES IN ('F', 'O'), PARTITION open VALUES IN ('P'))")


@query("SELECT o_custkey % 8 AS part, count(*) AS n FROM orders GROUP BY 1")
def hash_partition_assign(spark, d):
    return _assigned(spark, d, "HASH (o_custkey) PARTITIONS 8")


BY_DAY = "RANGE (to_days(o_orderdate)) (PARTITION old VALUES LESS THAN (to_days('1995-01-01')), PARTITION mid VALUES LESS THAN (to_days('1997-01-01')))"


@query("SELECT CASE WHEN o_orderdate < DATE '1995-01-01' OR o_orderdate IS NULL THEN 'old' WHEN o_orderdate < DATE '1997-01-01' THEN 'mid' END AS part, count(*) AS n FROM orders GROUP BY 1")
def day_partition_assign(spark, d):
    return read(spark, d, "orders").groupBy(parse_partitions(BY_DAY).assign().alias("part")).agg(F.count(F.lit(1)).alias("n"))


def _assigned(spark, d, by):
    return orders(spark, d).groupBy(parse_partitions(by).assign().alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH a AS (SELECT DISTINCT 'p' || (o_orderkey // 1000) AS p FROM orders WHERE o_orderkey < 9000), b AS (SELECT DISTINCT 'p' || (o_orderkey // 1000) AS p FROM orders WHERE o_orderkey >= 2000) SELECT 'drop' AS action, p AS part FROM (SELECT p FROM a EXCEPT SELECT p FROM b) UNION ALL SELECT 'add', p FROM (SELECT p FROM b EXCEPT SELECT p FROM a)")
def partition_sync_diff(spark, d):
    part = lambda where: orders(spark, d).where(where).select(F.concat(F.lit("p"), F.floor(F.col("o_orderkey") / 1000).cast("string")).alias("part")).distinct()
    return sync_actions(part("o_orderkey < 9000"), part("o_orderkey >= 2000"))


BY_STATUS = "RANGE COLUMNS (o_orderstatus, o_orderdate) (PARTITION f_early VALUES LESS THAN ('F', '1994-01-01'), PARTITION f_late VALUES LESS THAN ('F', MAXVALUE), PARTITION o_early VALUES LESS THAN ('O', '1996-01-01'), PARTITION o_late VALUES LESS THAN ('O', MAXVALUE), PARTITION rest VALUES LESS THAN (MAXVALUE, MAXVALUE))"


@query("""WITH o AS (SELECT CASE WHEN o_orderstatus < 'F' OR o_orderstatus = 'F' AND o_orderdate < DATE '1994-01-01' THEN 'f_early' WHEN o_orderstatus <= 'F' THEN 'f_late' WHEN o_orderstatus < 'O' OR o_orderstatus = 'O' AND o_orderdate < DATE '1996-01-01' THEN 'o_early' WHEN o_orderstatus <= 'O' THEN 'o_late' ELSE 'rest' END AS part FROM orders)
SELECT CASE part WHEN 'f_early' THEN 'drop' WHEN 'o_late' THEN 'add' ELSE 'replace' END AS action, part, count(*) AS n FROM o WHERE part IN ('f_early', 'o_late', 'o_early') GROUP BY part""")
def partitioned_copy_sync(spark, d):
    """What is moved when a partitioned copy follows a table that lost one partition, got one, and changed in a third."""
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    part = parse_partitions(BY_STATUS).assign()
    copy = PartitionedCopy(spark, f"{checkpoint_folder(spark).rstrip('/')}/copy-{uuid.uuid4().hex}", part, rows.schema)
    copy.write(rows.where(part != "o_late"))
    changed = F.when(part == "o_early", F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority"))
    return copy.sync(rows.where(part != "f_early").withColumn("o_orderpriority", changed))


DECLARED = [
    "CREATE TABLE region (r_regionkey BIGINT NOT NULL, PRIMARY KEY (r_regionkey))",
    "CREATE TABLE nation (n_nationkey BIGINT NOT NULL, n_regionkey BIGINT, PRIMARY KEY (n_nationkey), CONSTRAINT fk_nation FOREIGN KEY (n_regionkey) REFERENCES region (r_regionkey))",
    "CREATE TABLE customer (c_custkey BIGINT NOT NULL, c_nationkey BIGINT, PRIMARY KEY (c_custkey), CONSTRAINT fk_customer FOREIGN KEY (c_nationkey) REFERENCES nation (n_nationkey))",
    "CREATE TABLE orders (o_orderkey BIGINT NOT NULL, o_custkey BIGINT, PRIMARY KEY (o_orderkey), CONSTRAINT fk_orders FOREIGN KEY (o_custkey) REFERENCES customer (c_custkey) ON DELETE CASCADE)",
]


@query("""WITH r(name, child, col, parent, n, orphans) AS (
SELECT 'fk_customer', 'customer', 'c_nationkey', 'nation', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer WHERE c_nationkey IS NOT NULL AND c_nationkey NOT IN (SELECT n_nationkey FROM nation)) UNION ALL
SELECT 'fk_orders', 'orders', 'o_custkey', 'customer', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)))
SELECT * FROM r""")
def fk_discovery(spark, d):
    """The foreign keys of customer and on it, with the rows of their child tables and those whose parent is not there."""
    found = foreign_keys(spark, [parse_table(t) for t in DECLARED], "customer")
    keys = {"nation": "n_nationkey", "customer": "c_custkey"}
    out = []
    for r in found.collect():  # declared keys
        child, parent = read(spark, d, r.child), read(spark, d, r.parent).select(F.col(keys[r.parent]).alias("key")).distinct().withColumn("there", F.lit(True))
        lost = F.count(F.when(F.col(r.col).isNotNull() & F.col("there").isNull(), 1))
        counts = child.join(parent, child[r.col] == F.col("key"), "left").agg(F.count(F.lit(1)).alias("n"), lost.alias("orphans"))
        out.append(counts.select(*[F.lit(v).alias(c) for c, v in zip(("name", "child", "col", "parent"), (r.name, r.child, r.col, r.parent), strict=True)], "n", "orphans"))
    return functools.reduce(DataFrame.unionByName, out)


@query("SELECT '__tw_' || CASE WHEN c_custkey % 3 = 0 THEN 'new_' WHEN c_custkey % 3 = 1 THEN 'old_' ELSE 'own_' END || c_name AS name FROM customer WHERE c_custkey % 3 < 2")
def orphans_by_prefix(spark, d):
    """Of names some of which a migration made, those."""
    kind = F.when(F.col("c_custkey") % 3 == 0, "new_").when(F.col("c_custkey") % 3 == 1, "old_").otherwise("own_")
    return capture.named_with(customers(spark, d).select(F.concat(F.lit("__tw_"), kind, "c_name").alias("name")), "name", list(PREFIXES.values()))


@query("SELECT p_name FROM part WHERE left(p_name, 4) = 'part'")
def orphan_objects_by_prefix(spark, d):
    return read(spark, d, "part").where(F.col("p_name").startswith("part")).select("p_name")


@query("""SELECT v.*, CASE v.name WHEN 'o_totalprice' THEN (SELECT count(o_totalprice) FROM orders) WHEN 'o_orderpriority' THEN (SELECT count(o_orderpriority) FROM orders) ELSE (SELECT count(*) FROM orders) END AS affected
FROM (VALUES ('drop', 'column', 'o_totalprice', '`o_totalprice` double DEFAULT NULL', '', 'DROP_COL', false),
('modify', 'column', 'o_orderpriority', '`o_orderpriority` varchar(15) DEFAULT NULL', '`o_orderpriority` varchar(30) DEFAULT NULL', 'CHANGE_COL_DATA_TYPE', false),
('add', 'column', 'o_note', '', '`o_note` varchar(10) NOT NULL DEFAULT ''''', 'ADD_COL', true),
('add', 'key', 'ix_cust', '', 'KEY `ix_cust` (`o_custkey`)', 'ADD_INDEX', false)) v(change, object, name, old, new, alter_types, instant)""")
def schema_diff_rows(spark, d):
    """What changes, and how many rows of the table it affects: values that go or are converted, rows that get a value or a place in a key."""
    table = read(spark, d, "orders")
    counts = table.agg(F.count(F.lit(1)).alias("__all"), *[F.count(c).alias(c) for c in table.columns]).first()
    affected = functools.reduce(lambda out, c: F.when((F.col("name") == c) & (F.col("change") != "add"), F.lit(counts[c])).otherwise(out), table.columns, F.lit(counts["__all"]))
    return SchemaDiff(parse_table(OLD_ORDERS), parse_table(NEW_ORDERS)).rows(spark).withColumn("affected", affected)


_DAYS = "CREATE TABLE orders (o_orderkey BIGINT NOT NULL, o_orderdate DATE, PRIMARY KEY (o_orderkey)) PARTITION BY {}"
_MORE = BY_DAY[:-1] + ", PARTITION late VALUES LESS THAN (to_days('1999-01-01')))"


@query("""WITH y AS (SELECT count(*) FILTER (o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1999-01-01') AS late, count(*) FILTER (o_orderdate IS NULL OR o_orderdate < DATE '1997-01-01') AS held, count(*) FILTER (o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01') AS early FROM orders)
SELECT t.*, CASE case_ WHEN 'removed' THEN held WHEN 'split' THEN early ELSE late END AS moved FROM y, (VALUES ('grown', 'ADD_PARTITION', 'ADD PARTITION (PARTITION late VALUES LESS THAN (to_days(''1999-01-01'')))'), ('shrunk', 'DROP_PARTITION', 'DROP PARTITION late'),
('removed', 'REMOVE_PARTITIONING', 'REMOVE PARTITIONING'), ('split', 'REORGANIZE_PARTITION', 'REORGANIZE PARTITION mid INTO (PARTITION early VALUES LESS THAN (to_days(''1996-01-01'')), PARTITION mid VALUES LESS THAN (to_days(''1997-01-01'')))')) t(case_, alter_type, sql)""")
def schema_diff_partitions(spark, d):
    """What changed partitions by day are, and how many rows come to lie in another one."""
    split = BY_DAY.replace("PARTITION mid", "PARTITION early VALUES LESS THAN (to_days('1996-01-01')), PARTITION mid")
    cases = [("grown", BY_DAY, _MORE), ("shrunk", _MORE, BY_DAY), ("removed", BY_DAY, ""), ("split", BY_DAY, split)]
    rows = [(case, c.alter_types[0], c.new, diff.segments[0]) for case, a, b in cases for diff in [SchemaDiff(*[parse_table(_DAYS.format(x).removesuffix(" PARTITION BY ")) for x in (a, b)])] for c in diff.changes]
    table = read(spark, d, "orders")
    part = lambda text: parse_partitions(text).assign() if text else F.lit(None).cast("string")
    moved = table.agg(*[F.count(F.when(~part(a).eqNullSafe(part(b)), 1)).alias(case) for case, a, b in cases]).first()
    return spark.createDataFrame([(*r[:2], r[3], moved[r[0]]) for r in rows], "case_ string, alter_type string, sql string, moved long")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def dump_then_load(spark, d):
    """All chunks written and loaded again."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    table = orders(spark, d)
    chunks.dump(table, ["o_orderkey"], CHUNK * 9, path)
    return chunks.load(spark, path, table.schema)


def _migrated(spark, d):
    """The migrated orders, and the old table as it is read after the changes: another way to the same rows."""
    base = read(spark, d, "orders")
    old, new = base.where("o_orderkey % 10 < 8"), base.where("o_orderkey % 10 >= 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 < 4, "X").otherwise(F.col("o_orderstatus")))
    changes = capture.snapshot_changes(old, new, ["o_orderkey"]).withColumn("change_id", F.col("o_orderkey") + 1)
    return new, Migration(parse_table(OLD_ORDERS), parse_table(NEW_ORDERS), allow_drop=True, strict=True).run(old, changes, expected=new)


MIGRATED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_note"]


@query(f"""WITH m AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 < 4 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, '' AS o_note,
(row_number() OVER (ORDER BY o_orderkey) - 1) // {CHUNK} AS chunk_id FROM orders WHERE o_orderkey % 10 >= 2)
SELECT chunk_id, count(*) AS cnt, {', '.join(map(XOR, MIGRATED))} FROM m GROUP BY chunk_id""")
def migrate_checksums(spark, d):
    """Checksums by chunk of the migrated table's values."""
    _, (moved, _) = _migrated(spark, d)
    return verify.by_chunk(moved, ["o_orderkey"], CHUNK, MIGRATED, md5_prefix)


@query(f"WITH n AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // {CHUNK} AS chunk_id FROM orders WHERE o_orderkey % 10 >= 2) SELECT chunk_id, count(*) AS cnt_old, count(*) AS cnt_new, '' AS mismatched FROM n GROUP BY chunk_id")
def migrate_end_to_end(spark, d):
    """Rows by chunk of the migrated table and of the old one after the changes; no column may differ."""
    new, (moved, wrong) = _migrated(spark, d)
    counts = lambda t, name: chunks.chunk_counts(t, ["o_orderkey"], CHUNK).withColumnRenamed("cnt", name)
    odd = wrong.select("chunk_id", "mismatched")
    return counts(new, "cnt_old").join(counts(moved, "cnt_new"), "chunk_id", "full_outer").join(odd, "chunk_id", "left").select("chunk_id", "cnt_old", "cnt_new", F.coalesce("mismatched", F.lit("")).alias("mismatched"))
