import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.cleanup import CleanUp
from tablewright.errors import ERRORS, MigrationError
from tablewright.functions.columns import after, collated, quoted, readable_size
from tablewright.migrate import PREFIXES, Migration, asserting, clean_up
from tablewright.operators import capture, chunks, gaps, replay, verify
from tablewright.plans import checks
from tablewright.plans.partitions import parse_partitions
from tablewright.plans.diff import SchemaDiff, converted_columns, needs_current_time
from tablewright.plans.schema import droppable_keys, expires, parse_table, same_schema
from tablewright.sources.tables import foreign_keys, require_database, size

T = "CREATE TABLE t (id INT NOT NULL, a VARCHAR(10), PRIMARY KEY (id)) ENGINE=InnoDB DEFAULT CHARSET=utf8"


def test_errors_have_their_own_codes():
    assert len({c for c, _, _ in ERRORS.values()}) == len(ERRORS)
    assert str(MigrationError("NEW_PK", table="t")).startswith("103: NEW_PK: ")


def test_parse_and_render():
    t = parse_table("CREATE TABLE IF NOT EXISTS `a``b` (\n id bigint(20) unsigned NOT NULL AUTO_INCREMENT, e enum('x','y''z') DEFAULT 'x', d decimal(10,2), u int UNIQUE, KEY k (e(3) DESC, d), CONSTRAINT f FOREIGN KEY (u) REFERENCES o (i), PRIMARY KEY (id)) COMMENT='c' /*!50100 PARTITION BY HASH (id) PARTITIONS 4 */;")
    assert t.name == "a`b" and t.column("e").values == ("x", "y'z") and t.primary.names() == ["id"]
    assert [k.name for k in t.keys] == ["u", "k"] and t.keys[1].columns[0] == ("e", "3", "DESC")
    assert t.struct()["id"].dataType.simpleString() == "decimal(20,0)" and t.partition.startswith("HASH")
    assert same_schema(parse_table(t.sql().split(" PARTITION")[0]), parse_table(t.sql().split(" PARTITION")[0]))


@pytest.mark.parametrize("text", ["CREATE TABLE t (id FOO)", "CREATE TABLE t (id INT PRIMARY KEY, PRIMARY KEY (id))", "CREATE TABLE t (id INT", "DROP TABLE t"])
def test_bad_syntax(text):
    with pytest.raises(MigrationError, match="INVALID_SYNTAX"):
        parse_table(text)


def test_equal_spellings():
    assert same_schema(parse_table("CREATE TABLE t (a INT(11), b BOOL, c TIMESTAMP, d INT DEFAULT 1)"), parse_table("CREATE TABLE t (a INT DEFAULT NULL, b BOOLEAN, c TIMESTAMP NOT NULL DEFAULT CURRENT_TIMESTAMP ON UPDATE CURRENT_TIMESTAMP, d INT DEFAULT '1')"))


@pytest.mark.parametrize(
    ("new", "types"),
    [
        ("CREATE TABLE t (id INT NOT NULL, a VARCHAR(10), b INT, PRIMARY KEY (id))", {"ADD_COL"}),
        ("CREATE TABLE t (id INT NOT NULL, PRIMARY KEY (id))", {"DROP_COL"}),
        ("CREATE TABLE t (id INT NOT NULL, a VARCHAR(20), PRIMARY KEY (id))", {"CHANGE_COL_DATA_TYPE"}),
        ("CREATE TABLE t (id INT NOT NULL, a VARCHAR(10) DEFAULT 'x' COMMENT 'y', PRIMARY KEY (id))", {"CHANGE_COL_DEFAULT_VAL", "CHANGE_COL_COMMENT"}),
        ("CREATE TABLE t (a VARCHAR(10), id INT NOT NULL, PRIMARY KEY (id))", {"REORDER_COL"}),
        ("CREATE TABLE t (id INT NOT NULL, a VARCHAR(10), PRIMARY KEY (id), UNIQUE KEY u (a))", {"ADD_INDEX", "BECOME_UNIQUE_INDEX"}),
        ("CREATE TABLE t (id INT NOT NULL, a VARCHAR(10), PRIMARY KEY (id)) PARTITION BY HASH (id) PARTITIONS 2", {"ADD_PARTITIONING"}),
        ("CREATE TABLE t (id INT NOT NULL, a VARCHAR(10))", {"DROP_PK"}),
    ],
)
def test_diff_types(new, types):
    old = parse_table("CREATE TABLE t (id INT NOT NULL, a VARCHAR(10), PRIMARY KEY (id))")
    diff = SchemaDiff(old, parse_table(new))
    assert diff.alter_types() == types and diff.to_sql().startswith("ALTER TABLE `t` ")


def test_partition_diffs():
    t = lambda p: parse_table(f"CREATE TABLE t (id INT) PARTITION BY {p}")
    sql = lambda a, b: SchemaDiff(t(a), t(b)).to_sql()
    assert "ADD PARTITION PARTITIONS 2" in sql("HASH (id) PARTITIONS 2", "HASH (id) PARTITIONS 4")
    assert "COALESCE PARTITION 1" in sql("HASH (id) PARTITIONS 3", "HASH (id) PARTITIONS 2")
    a = "RANGE (id) (PARTITION p0 VALUES LESS THAN (10), PARTITION p1 VALUES LESS THAN (20))"
    b = "RANGE (id) (PARTITION p0 VALUES LESS THAN (10), PARTITION p1 VALUES LESS THAN (20), PARTITION p2 VALUES LESS THAN (30))"
    assert "ADD PARTITION (PARTITION p2" in sql(a, b) and "DROP PARTITION p2" in sql(b, a)
    c = "RANGE (id) (PARTITION p0 VALUES LESS THAN (5), PARTITION q VALUES LESS THAN (10), PARTITION p1 VALUES LESS THAN (20))"
    assert "REORGANIZE PARTITION p0 INTO" in sql(a, c)


def test_no_diff_and_helpers():
    t = parse_table(T)
    assert SchemaDiff(t, t).to_sql() is None and quoted("a`b") == "`a``b`" and readable_size(2048) == "2.00 KB"
    assert converted_columns(t, parse_table(T.replace("VARCHAR(10)", "VARCHAR(11)"))) == ["a"]
    assert needs_current_time(t, parse_table(T.replace("a VARCHAR(10)", "a VARCHAR(10), ts TIMESTAMP"))) == ["ts"]
    assert chunks.rows_per_chunk(2 << 20, 100) % 2 == 1 and chunks.rows_per_chunk(1, 100) == 1


def test_checks():
    keyless = parse_table("CREATE TABLE t (id INT, a INT)")
    with pytest.raises(MigrationError, match="NEW_PK"):
        checks.identity(keyless)
    assert checks.identity(keyless, True) == (["id", "a"], True)
    t = parse_table(T)
    with pytest.raises(MigrationError, match="MISSING_COLUMN"):
        checks.require_migratable(t, parse_table("CREATE TABLE t (id INT NOT NULL, PRIMARY KEY (id))"))
    with pytest.raises(MigrationError, match="PRI_COL_DROPPED"):
        checks.require_migratable(t, parse_table("CREATE TABLE t (a VARCHAR(10), PRIMARY KEY (a))"), True)
    with pytest.raises(MigrationError, match="INVALID_SYNTAX"):
        checks.session_overrides("a")


def sequential(base, changes):
    rows = dict(base)
    for _, kind, key, value in sorted(changes):
        if kind == 1:
            rows.setdefault(key, value)
        elif kind == 2:
            rows.pop(key, None)
        elif key in rows:
            rows[key] = value
    return rows


def test_fold_equals_ordered_replay(spark):
    rnd = random.Random(3)
    base = [(k, f"b{k}") for k in range(0, 300, 2)]
    changes = [(i + 1, rnd.choice([1, 2, 3]), rnd.randrange(300), f"c{i}" if rnd.random() < 0.9 else None) for i in range(1500)]
    out = replay.folded(spark.createDataFrame(base, "k long, v string"), spark.createDataFrame(changes, "change_id long, dml_type long, k long, v string"), ["k"])
    assert {r.k: r.v for r in out.collect()} == sequential(base, changes) and out.count() == len(sequential(base, changes))


def test_capture_then_replay(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "k long, v string")
    changes = capture.snapshot_changes(old, new, ["k"]).where("k IS NOT NULL").withColumn("change_id", F.col("k"))
    assert sorted((r.dml_type, r.k) for r in changes.collect()) == [(1, 4), (2, 1), (3, 2)]
    got = replay.folded(old.where("k IS NOT NULL"), changes, ["k"])
    assert verify.row_differences(got, new).count() == 0


def test_chunks_and_ranges(spark):
    t = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    assert sorted((r.chunk_id, r.cnt) for r in chunks.chunk_counts(t, ["k"], 301).collect()) == [(0, 301), (1, 301), (2, 301), (3, 97)]
    assert t.where(after(["v", "k"], [5, 500])).count() == t.where("v > 5 OR (v = 5 AND k > 500)").count()
    assert chunks.chunk_counts(t.limit(0), ["k"], 3).count() == 0


def test_numbers_of_text_and_composite_keys(spark):
    rnd = random.Random(5)
    rows = {(rnd.choice(["a", "ü", "zz", None, ""]), rnd.choice([None, *range(200)])) for _ in range(900)}
    t = spark.createDataFrame(sorted(rows, key=str), "k string, n long").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0))
    got = {(r.k, r.n): r.row_no for r in chunks.numbered(t, ["k", "n"]).collect()}
    assert [got[r] for r in order] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("grouped", [False, True])
def test_change_groups(spark, grouped):
    rnd, kinds = random.Random(6), []
    while len(kinds) < 900:
        kinds += [rnd.choice([1, 2, 3])] * rnd.choice([1, 2, 5, 300])
    expected = []
    for i, kind in enumerate(kinds, 1):
        if expected and expected[-1][0] == kind and expected[-1][3] < 7 and (grouped or kind != 3):
            expected[-1][2:] = [i, expected[-1][3] + 1]
        else:
            expected.append([kind, i, i, 1])
    log = spark.createDataFrame(list(enumerate(kinds, 1)), "change_id long, dml_type long").repartition(3)
    got = sorted(map(tuple, replay.change_groups(log, 7, grouped).collect()))
    assert got == [(i, *g) for i, g in enumerate(expected, 1)]
    assert replay.change_groups(log.limit(0), 7).count() == 0


def test_gaps(spark):
    ids = spark.createDataFrame([(2,), (5,), (2_000_001,)], "change_id long")
    assert sorted(map(tuple, gaps.gap_ranges(ids).collect())) == [(1, 1), (3, 4), (6, 2_000_000)]
    assert gaps.gap_ids(ids).selectExpr("count(*)", "count(distinct missing_id)", "max(missing_id)").first()[:] == (1_999_998, 1_999_998, 2_000_000)


def test_stream_with_late_ids(spark, tmp_path):
    from tablewright.streaming.replay_stream import ReplayTarget, replay_available

    schema = "change_id long, dml_type long, k long, v string"
    target = ReplayTarget(spark, str(tmp_path / "t"), ["k"])
    target.start(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    run = lambda: replay_available(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), target, str(tmp_path / "c"))
    put([(1, 3, 1, "A"), (4, 1, 3, "c")])
    run()
    assert sorted(map(tuple, target.table().collect())) == [(1, "A"), (2, "b"), (3, "c")]
    put([(2, 2, 2, None), (5, 3, 3, "C")])
    run()
    assert sorted(map(tuple, target.table().collect())) == [(1, "A"), (3, "C")]
    left = target.state(target.versions()[-1]).where("first IS NOT NULL").select("first", "last").collect()
    assert [tuple(r) for r in left] == [(3, 3)]
    target.apply(spark.createDataFrame([(9, 2, 1, None)], schema), target.versions()[-1])  # a repeat changes nothing
    with pytest.raises(MigrationError):
        target.apply(spark.createDataFrame([(1, 3, 1, "Z")], schema), 99)


def test_queries_run(spark):
    from tablewright.queries import QUERIES

    assert QUERIES["migrate_end_to_end"](spark, "/root/testdata/sf0.001").where("mismatched <> ''").count() == 0


@pytest.fixture(scope="module")
def long_log(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("spark-log"))
    kind = F.element_at(F.array(F.lit("signup"), F.lit("error"), F.lit("click")), (F.col("id") % 3 + 1).cast("int"))
    spark.range(100_600).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 100_600).alias("user_id"), kind.alias("event_type")).write.parquet(f"{d}/events.parquet")
    spark.range(0, 100_600, 50).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit("s").alias("c_mktsegment")).write.parquet(f"{d}/customer.parquet")
    return d


def test_checksum_windows_to_the_end_of_the_log(spark, long_log):
    from tablewright.queries import QUERIES

    out = {r.window_no: r.cnt for r in QUERIES["delta_checksum_windows"](spark, long_log).collect()}
    assert sorted(out) == list(range(202)) and sum(out.values()) == 100_600


def test_whole_log_is_replayed(spark, long_log):
    from tablewright.queries import QUERIES

    rows = lambda name: sorted(map(tuple, QUERIES[name](spark, long_log).collect()))
    changes = [(i, ("signup", "error", "click")[i % 3], i * 7 % 100_600) for i in range(100_600)]
    base = range(0, 100_600, 50)
    gone = {k for _, kind, k in changes if kind == "error"}
    new = [k for _, kind, k in changes if kind == "signup"]
    assert rows("delta_max_id_whole") == [(100_600,)]
    assert rows("replay_delete_whole") == [(k, "n", "s") for k in base if k not in gone]
    assert rows("replay_insert_whole") == sorted([(k, "s") for k in base] + [(k, "signup") for k in new])
    assert rows("replay_insert_ignore_whole") == sorted([(k, "s") for k in base] + [(k, "signup") for k in set(new) - set(base)])


def test_partitions_are_typed():
    days = "RANGE (to_days(d)) (PARTITION p0 VALUES LESS THAN (to_days('2024-01-01')), PARTITION p1 VALUES LESS THAN MAXVALUE)"
    assert parse_partitions(days).sql() == days and parse_partitions(days).parts[0].bounds == ("to_days('2024-01-01')",)
    assert parse_partitions("LINEAR KEY (`a`, b) PARTITIONS 4").sql() == "LINEAR KEY (a, b) PARTITIONS 4"
    assert parse_partitions("RANGE COLUMNS (a, b) (PARTITION p VALUES LESS THAN (1, MAXVALUE) ENGINE = InnoDB)").parts[0].bounds == ("1", "MAXVALUE")
    for bad in ("NONSENSE", "RANGE (id)", "RANGE (id) (PARTITION a VALUES LESS THAN (5), PARTITION b VALUES LESS THAN (3))", "RANGE (id) (PARTITION a VALUES LESS THAN MAXVALUE, PARTITION b VALUES LESS THAN (9))", "LIST (id) (PARTITION a VALUES IN (1, 2), PARTITION b VALUES IN (2))", "LIST (id) (PARTITION a VALUES IN (1), PARTITION A VALUES IN (2))", "HASH (id) PARTITIONS 2 x"):
        with pytest.raises(MigrationError, match="INVALID_SYNTAX"):
            parse_table(f"CREATE TABLE t (id INT, d DATE) PARTITION BY {bad}")


def test_partition_of_a_row(spark):
    t = spark.createDataFrame([(None, None), (5, "x"), (-3, "y"), (10, "z")], "n long, s string")
    of = lambda by: [r[0] for r in t.select(parse_partitions(by).assign()).collect()]
    assert of("RANGE (n) (PARTITION a VALUES LESS THAN (5), PARTITION b VALUES LESS THAN (10))") == ["a", "b", "a", None]
    assert of("LIST COLUMNS (s) (PARTITION a VALUES IN ('x', NULL), PARTITION b VALUES IN ('y'))") == ["a", "a", "b", None]
    assert of("HASH (n) PARTITIONS 4") == [None, 1, 3, 2]


def test_lists_and_merges_are_reorganized():
    t = lambda p: parse_table(f"CREATE TABLE t (id INT) PARTITION BY {p}")
    change = lambda a, b: SchemaDiff(t(a), t(b)).alter_types()
    lists = lambda *parts: "LIST (id) (" + ", ".join(f"PARTITION p{i} VALUES IN ({v})" for i, v in enumerate(parts)) + ")"
    ranges = lambda *parts: "RANGE (id) (" + ", ".join(f"PARTITION p{v} VALUES LESS THAN ({v})" for v in parts) + ")"
    assert change(lists("1, 2", "3"), lists("1", "2, 3")) == {"REORGANIZE_PARTITION"} and change(lists("1, 2"), lists("1")) == {"INVALID_PARTITIONING"}
    assert change(ranges(5, 10, 20), ranges(10, 20)) == {"DROP_PARTITION"} and change(ranges(5, 10), ranges(5, 12)) == {"REORGANIZE_PARTITION"}
    assert change(ranges(5, 12), ranges(5, 10)) == {"INVALID_PARTITIONING"} and change(ranges(5, 20), ranges(5, 10, 20)) == {"REORGANIZE_PARTITION"}


@pytest.mark.parametrize(("old", "new", "types"), [
    ("KEY k (a) KEY_BLOCK_SIZE=4", "KEY k (a) KEY_BLOCK_SIZE=8", {"CHANGE_INDEX_BLOCK_SIZE"}), ("KEY k (a)", "KEY k (a) INVISIBLE", {"CHANGE_INDEX_VISIBILITY"}), ("KEY k (a)", "KEY k (a) USING HASH", {"CHANGE_INDEX_TYPE"}),
    ("KEY k (a)", "KEY k (a) COMMENT 'it''s'", {"CHANGE_INDEX_COMMENT"}), ("KEY k (a)", "UNIQUE KEY k (a)", {"CHANGE_UNIQUE_CONSTRAINT", "BECOME_UNIQUE_INDEX"}), ("KEY k (a)", "FULLTEXT KEY k (a)", {"CHANGE_INDEX_KIND"}), ("KEY k (a)", "KEY k (a DESC)", {"CHANGE_INDEX_COLUMNS"}),
])
def test_index_attributes(old, new, types):
    t = lambda key: parse_table(f"CREATE TABLE t (a VARCHAR(9), ts TIMESTAMP(3) DEFAULT CURRENT_TIMESTAMP(3), {key})")
    assert SchemaDiff(t(old), t(new)).alter_types() == types | {"DROP_INDEX", "ADD_INDEX"}
    assert same_schema(parse_table(t(new).sql()), t(new))


def test_sharding_keys_and_time_precision():
    t = lambda more, ts="TIMESTAMP(3) NULL": parse_table(f"CREATE TABLE t (a INT, ts {ts}) UNION=(x,y) {more}")
    assert SchemaDiff(t(""), t("SHARDING_KEY=(a)")).alter_types() == {"ADD_SHARDING_KEY"} and SchemaDiff(t("SHARDING_KEY=(a)"), t("")).to_sql() == "ALTER TABLE `t` SHARDING_KEY=()"
    assert t("").options["UNION"] == "(x,y)"
    on = "DATETIME(6) ON UPDATE CURRENT_TIMESTAMP({})"
    assert SchemaDiff(t("", on.format(3)), t("", on.format(6))).alter_types() == {"CHANGE_COL_DEFAULT_VAL"}


@pytest.mark.parametrize("text", ["CREATE TABLE t (a INT, A INT)", "CREATE TABLE t (a INT, KEY k (b))", "CREATE TABLE t (a INT, KEY k (a), KEY k (a))", "CREATE TABLE t (a INT, PRIMARY KEY (b))"])
def test_inconsistent_tables(text):
    with pytest.raises(MigrationError, match="INVALID_SYNTAX"):
        parse_table(text)


OLD = parse_table("CREATE TABLE t (k BIGINT NOT NULL, v VARCHAR(9), PRIMARY KEY (k))")
NEW = parse_table("CREATE TABLE t (k BIGINT NOT NULL, v VARCHAR(20), n INT NOT NULL, b BIGINT DEFAULT b'101', q VARCHAR(9) DEFAULT 'it''s', PRIMARY KEY (k))")
LOG = "change_id long, dml_type long, k long, v string"


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")


def test_migration_verifies_values(spark, table):
    changes = spark.createDataFrame([(1, 3, 1, "A"), (2, 2, 2, None), (3, 1, 4, "d")], LOG)
    after_changes = spark.createDataFrame([(1, "A"), (3, "c"), (4, "d")], "k long, v string")
    seen = []
    run = Migration(OLD, NEW, verify=True, strict=True, hooks={f"{w}_{s}": lambda x=f"{w}_{s}": seen.append(x) for w in ("before", "after") for s in ("check", "copy", "replay", "verify")})
    new, odd = run.run(table, changes, expected=after_changes)
    assert sorted(map(tuple, new.collect())) == [(1, "A", 0, 5, "it's"), (3, "c", 0, 5, "it's"), (4, "d", 0, 5, "it's")] and odd.count() == 0
    assert seen == [f"{w}_{s}" for s in ("check", "copy", "replay", "verify") for w in ("before", "after")] and run.seconds["copy"] > 0.01
    with pytest.raises(MigrationError, match="CHECKSUM_MISMATCH.*columns v"):
        Migration(OLD, NEW, verify=True).run(table, changes.where("dml_type <> 3"), expected=after_changes)


def test_migration_errors(spark, table):
    odd = lambda *rows: spark.createDataFrame(list(rows), LOG)
    for change in ((1, 2, 9, None), (1, 1, 1, "x")):
        with pytest.raises(MigrationError, match="REPLAY_WRONG_AFFECTED"):
            Migration(OLD, NEW, strict=True).run(table, odd(change))
        assert Migration(OLD, NEW).run(table, odd(change))[0].count() == 3
    with pytest.raises(MigrationError, match="UNKNOWN_REPLAY_TYPE"):
        Migration(OLD, NEW).run(table, odd((1, 7, 1, "x")))
    slow = odd((1, 3, 1, "x")).withColumn("v", F.when(F.expr("java_method('java.lang.Thread', 'sleep', 3000L) is null"), F.col("v")))
    with pytest.raises(MigrationError, match="REPLAY_TIMEOUT"):
        Migration(OLD, NEW, seconds_limit=0.2).run(table, slow)
    assert Migration(OLD, NEW, where="k > 1").run(table, odd((1, 3, 3, "x")))[0].count() == 2
    assert Migration(OLD, OLD).run(table, odd())[0] is table
    spark.range(3).createOrReplaceTempView("three")
    asserting(spark, "SELECT count(*) FROM three", [(3,)])()
    with pytest.raises(MigrationError, match="OUTSIDE_HOOK_ERROR.*ASSERTION_ERROR"):
        Migration(OLD, NEW, hooks={"before_copy": asserting(spark, "SELECT count(*) FROM three", [(4,)])}).run(table, odd())
    Migration(OLD, NEW, critical=False, hooks={"before_copy": lambda: 1 / 0}).run(table, odd())


def test_migrate_a_table_of_the_catalog(spark, table):
    none = spark.createDataFrame([], LOG)
    with pytest.raises(MigrationError, match="TABLE_NOT_EXIST"):
        Migration(OLD, NEW).run_table(spark, "absent", none)
    table.write.mode("overwrite").saveAsTable("t")
    try:
        table.write.mode("overwrite").saveAsTable(PREFIXES["new"] + "t")
        with pytest.raises(MigrationError, match="TABLE_ALREADY_EXIST"):
            Migration(OLD, NEW).run_table(spark, "t", none)
        assert clean_up(spark) == [PREFIXES["new"] + "t"]
        with pytest.raises(MigrationError, match="CHECKSUM_MISMATCH"):
            Migration(OLD, NEW, verify=True).run_table(spark, "t", none, expected=table.where("k < 3"))
        assert spark.table("t").columns == ["k", "v"] and not clean_up(spark)
        assert Migration(OLD, NEW, verify=True, keep_old=True).run_table(spark, "t", spark.createDataFrame([(1, 2, 3, None)], LOG)) == PREFIXES["old"] + "t"
        assert spark.table("t").columns == ["k", "v", "n", "b", "q"] and spark.table("t").count() == 2 and spark.table(PREFIXES["old"] + "t").count() == 3
    finally:
        clean_up(spark)
        spark.sql("DROP TABLE IF EXISTS t")


def test_sources(spark, tmp_path, table):
    from tablewright.sources import tables

    path = str(tmp_path / "f")
    table.write.parquet(path)
    before = tables.fingerprint(spark.read.parquet(path))
    tables.require_unchanged(spark.read.parquet(path), before)
    table.write.mode("append").parquet(path)
    with pytest.raises(MigrationError, match="TABLE_TIMESTAMP_CHANGED_ERROR"):
        tables.require_unchanged(spark.read.parquet(path), before)
    (tmp_path / "t.sql").write_text("-- of t\nCREATE TABLE t (id INT) ENGINE=InnoDB")
    assert tables.read_ddl(spark, str(tmp_path / "t.sql"), "innodb").name == "t"
    with pytest.raises(MigrationError, match="engine"):
        tables.read_ddl(spark, str(tmp_path / "t.sql"), "rocksdb")
    chunks.dump(table, None, 0, str(tmp_path / "d"))
    assert chunks.load(spark, str(tmp_path / "d"), table.schema).count() == 3
    assert verify.strong(table, ["k", "v"]).first()[0] != verify.strong(table.unionByName(table), ["k", "v"]).first()[0]


def test_catching_up(spark, tmp_path):
    from tablewright.streaming.replay_stream import ReplayTarget, catch_up

    log = str(tmp_path / "log")
    spark.createDataFrame([(1, 3, 1, "A")], LOG).write.parquet(log)
    target = ReplayTarget(spark, str(tmp_path / "t"), ["k"])
    target.start(spark.createDataFrame([(1, "a")], "k long, v string"))
    stream = lambda: spark.readStream.schema(LOG).parquet(log)
    assert catch_up(stream(), target, str(tmp_path / "c"), seconds=600) == 1 and target.table().first().v == "A"
    with pytest.raises(MigrationError, match="MAX_ATTEMPT_EXCEEDED"):
        catch_up(stream(), target, str(tmp_path / "c"), seconds=0, attempts=2)
    small = ReplayTarget(spark, str(tmp_path / "t"), ["k"], max_changes=1)
    with pytest.raises(MigrationError, match="REPLAY_TOO_MANY_DELTAS"):
        small.apply(spark.createDataFrame([(2, 3, 1, "B")], LOG), 9)


def test_stream_writes_touched_buckets_and_verifies(spark, tmp_path):
    from tablewright.streaming.replay_stream import ReplayTarget, verify_changes

    base = spark.createDataFrame([(k, f"b{k}") for k in range(40)], "k long, v string")
    log = lambda *rows: spark.createDataFrame(list(rows), LOG)
    target = ReplayTarget(spark, str(tmp_path / "t"), ["k"], buckets=8)
    target.start(base, last_id=5, seen=spark.createDataFrame([(1,), (2,), (5,)], "change_id long"))
    left = lambda: sorted(map(tuple, target.state(target.versions()[-1]).where("first IS NOT NULL").select("first", "last").collect()))
    assert left() == [(3, 4)] and target.table().count() == 40
    target.apply(log((3, 3, 7, "late"), (6, 3, 7, "new"), (7, 2, 8, None)), 0)
    assert left() == [(4, 4)] and sum(v == 0 for v in target.lie(0).values()) <= 2
    with pytest.raises(MigrationError, match="ASSERTION_ERROR"):
        target.apply(log((2, 3, 7, "was in the snapshot")), 1)
    target.apply(log(*[(8 + k, 2, k, None) for k in range(40) if k != 8]), 1)
    assert target.table().count() == 0 and target.table(0).count() == 39
    target.apply(log((60, 1, 3, "back")), 2)
    assert list(map(tuple, target.table().collect())) == [(3, "back")]
    every = log((6, 3, 7, "new"), (60, 1, 3, "back"))
    verify_changes(target, spark.createDataFrame([(3, "back")], "k long, v string"), every, ["k", "v"])
    with pytest.raises(MigrationError, match="CHECKSUM_MISMATCH"):
        verify_changes(target, spark.createDataFrame([(3, "other")], "k long, v string"), every, ["k", "v"])
    assert target.prune(1) == [-1, 0, 1] and target.table().count() == 1


def test_ranges_of_a_backlog(spark, tmp_path):
    from tablewright.streaming.replay_stream import ReplayTarget, replay_ranges

    rnd = random.Random(8)
    base, log = {k: f"b{k}" for k in range(20)}, [(i, rnd.choice([1, 2, 3]), rnd.randrange(30), f"c{i}") for i in range(1, 61)]
    target = ReplayTarget(spark, str(tmp_path / "t"), ["k"], buckets=4)
    target.start(spark.createDataFrame(list(base.items()), "k long, v string"))
    assert replay_ranges(spark.createDataFrame(log, LOG), target, 25) == 3 and target.versions() == [-1, 0, 1, 2]
    assert {r.k: r.v for r in target.table().collect()} == sequential(base, log)
    assert replay_ranges(spark.createDataFrame(log, LOG), target, 25) == 0


def test_ways_to_verify_and_models(spark):
    t = lambda inside, more="": parse_table(f"CREATE TABLE t ({inside}) {more}")
    old = t("a VARCHAR(9) COLLATE latin1_bin NOT NULL, n INT, PRIMARY KEY (a)")
    assert checks.verification(old, t("a VARCHAR(9) COLLATE latin1_bin NOT NULL, n INT, PRIMARY KEY (a)"), ["a"]) == "chunks"
    assert checks.verification(old, t("a VARCHAR(9) COLLATE latin1_swedish_ci NOT NULL, n INT, PRIMARY KEY (a)"), ["a"]) == "whole"
    assert checks.verification(old, t("a VARCHAR(9) COLLATE latin1_bin NOT NULL, n INT, PRIMARY KEY (n), KEY k (a)"), ["a"]) == "whole"
    assert checks.verification(old, old, ["a"], where="n > 1") == "none"
    keyed = t("a INT AUTO_INCREMENT, b INT, PRIMARY KEY (b), KEY x (a), KEY y (a, b), UNIQUE KEY z (b)", "ENGINE=ROCKSDB COMMENT='ttl_duration=60;'")
    assert [k.name for k in droppable_keys(keyed)] == ["y", "z"] and [k.name for k in droppable_keys(keyed, True)] == ["y"]
    assert expires(keyed) and not expires(old)
    assert sorted((r.kind, r.name) for r in keyed.rows(spark).collect()) == [("column", "a"), ("column", "b"), ("key", "PRIMARY"), ("key", "x"), ("key", "y"), ("key", "z"), ("option", "COMMENT"), ("option", "ENGINE")]
    linked = t("a INT, CONSTRAINT f FOREIGN KEY (a) REFERENCES o (i)")
    with pytest.raises(MigrationError, match="FOREIGN_KEY_FOUND.* f"):
        checks.require_no_foreign_keys(foreign_keys(spark, [linked], "t"), "t")
    checks.require_no_foreign_keys(foreign_keys(spark, [linked], "x"), "x")
    checks.require_space(100, 112)
    for bytes_, free, new in ((100, 105, False), (100, 112, True)):
        with pytest.raises(MigrationError, match="NOT_ENOUGH_SPACE"):
            checks.require_space(bytes_, free, new)
    with pytest.raises(MigrationError, match="DB_NOT_EXIST"):
        require_database(spark, "absent")


def test_what_is_kept_of_failures(spark, table, tmp_path):
    with pytest.raises(MigrationError, match="REPLAY_WRONG_AFFECTED: 1 "):
        Migration(OLD, NEW, strict=True, keep_failed_in=str(tmp_path / "odd")).run(table, spark.createDataFrame([(1, 2, 9, None), (2, 3, 1, "x")], LOG))
    assert [r.k for r in spark.read.parquet(str(tmp_path / "odd")).collect()] == [9]
    other = table.withColumn("v", F.when(F.col("k") == 3, "z").otherwise(F.col("v")))
    sums = lambda frame: verify.by_chunk(frame, ["k"], 1, ["k", "v"])
    verify.write_differing(table, other, ["k"], 1, verify.compared(sums(table), sums(other), "chunk_id", ["k", "v"]), str(tmp_path / "diff"))
    assert sorted((r.side, r.chunk_id, r.v) for r in spark.read.parquet(str(tmp_path / "diff")).collect()) == [("new", 2, "z"), ("old", 2, "c")]
    table.write.parquet(str(tmp_path / "f"))
    files, bytes_ = size(spark.read.parquet(str(tmp_path / "f")))
    assert files >= 1 and bytes_ > 100
    made = CleanUp(spark)
    made.files += [str(tmp_path / "f"), str(tmp_path / "absent")]
    table.createOrReplaceTempView("seen")
    made.views.append("seen")
    assert made.run() == [("file", str(tmp_path / "f")), ("view", "seen")] and not (tmp_path / "f").exists()


def _target(spark, path, base, **more):
    from tablewright.streaming.replay_stream import ReplayTarget

    target = ReplayTarget(spark, str(path), ["k"], buckets=4, **more)
    target.start(spark.createDataFrame(base, "k long, v string"))
    return target


def _rows(target):
    return sorted(map(tuple, target.table().collect()))


def test_a_stream_after_ranges_loses_nothing(spark, tmp_path):
    from tablewright.streaming.replay_stream import replay_available, replay_ranges

    target = _target(spark, tmp_path / "t", [(1, "a")])
    first = [(1, 3, 1, "A"), (2, 1, 2, "b")]
    assert replay_ranges(spark.createDataFrame(first, LOG), target, 1) == 2
    spark.createDataFrame([(3, 1, 3, "c")], LOG).write.parquet(str(tmp_path / "log"))
    stream = lambda: spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
    replay_available(stream(), target, str(tmp_path / "c1"))
    assert _rows(target) == [(1, "A"), (2, "b"), (3, "c")] and target.versions() == [-1, 0, 1, 2]
    replay_available(stream(), target, str(tmp_path / "c1"))
    assert target.versions() == [-1, 0, 1, 2]
    with pytest.raises(Exception, match="ids that were seen"):  # a new checkpoint reads the log again: an error, not a silent repeat
        replay_available(stream(), target, str(tmp_path / "c2"))
    assert [(c.writer[:6], c.batch, c.first_id, c.last_id) for c in target.commits.entries()] == [("start", 0, None, 0), ("ranges", 0, 1, 1), ("ranges", 1, 2, 2), ("stream", 0, 3, 3)]


def test_two_writers_cannot_both_win(spark, tmp_path):
    from tablewright.streaming.replay_stream import ReplayTarget

    a = _target(spark, tmp_path / "t", [(1, "a")])
    b = ReplayTarget(spark, str(tmp_path / "t"), ["k"], buckets=4)
    log = lambda *r: spark.createDataFrame(list(r), LOG)
    mine = a._applied(log((1, 3, 1, "A"), (2, 1, 2, "b")), 0, "a", -1)
    assert b.apply(log((3, 1, 3, "c")), 0, "b") == 0  # it came first
    assert not a.commits.claim(mine) and _rows(a) == [(1, "a"), (3, "c")]  # what was written aside does not show
    assert a.apply(log((1, 3, 1, "A"), (2, 1, 2, "b")), 0, "a") == 1  # ids 1 and 2 were gaps of the other writer's version
    assert _rows(a) == _rows(b) == [(1, "A"), (2, "b"), (3, "c")]
    assert a.apply(log((9, 2, 1, None)), 0, "b") is None and len(a.versions()) == 3

    race = ReplayTarget(spark, str(tmp_path / "t"), ["k"], buckets=4)
    applied, turns = race._applied, []

    def overtaken(*args):  # another writer commits while this one writes
        made = applied(*args)
        if not turns:
            turns.append(b.apply(log((4, 2, 3, None)), 1, "b"))
        return made

    race._applied = overtaken
    assert race.apply(log((5, 3, 1, "AA")), 0, "race") == turns[0] + 1
    assert _rows(a) == [(1, "AA"), (2, "b")]


def test_final_replay_is_one_version(spark, tmp_path):
    from tablewright.streaming.replay_stream import final_replay

    target = _target(spark, tmp_path / "t", [(1, "a")])
    log = spark.createDataFrame([(i, 3, 1, f"v{i}") for i in range(1, 30)], LOG)
    target.apply(log.where("change_id in (2, 5)"), 0)
    assert final_replay(log, target, ceiling=20) == 1 and _rows(target) == [(1, "v20")]
    assert target.last_id() == 20 and target.state(1).where("first IS NOT NULL").count() == 0
    assert final_replay(log, target) == 2 and final_replay(log, target) is None
    with pytest.raises(MigrationError, match="UNKNOWN_REPLAY_TYPE"):
        final_replay(spark.createDataFrame([(40, 3, 1, "x"), (41, 9, 1, "y")], LOG), target)
    assert target.last_id() == 29


def test_missing_ranges_shrink(spark, monkeypatch):
    monkeypatch.setattr(gaps, "CELL", 7)
    ranges = spark.createDataFrame([(3, 30), (40, 40), (50, 52)], "first long, last long")
    left = gaps.still_missing(ranges, spark.createDataFrame([(3,), (8,), (9,), (30,), (40,), (51,), (51,), (99,)], "id long"))
    got = sorted(i for a, b in left.collect() for i in range(a, b + 1))
    assert got == [i for i in [*range(3, 31), 40, 50, 51, 52] if i not in (3, 8, 9, 30, 40, 51)]
    inside = gaps.in_ranges(spark.createDataFrame([(i,) for i in range(60)], "change_id long"), ranges)
    assert sorted(r[0] for r in inside.collect()) == [*range(3, 31), 40, 50, 51, 52]


def brute_groups(rows, size):
    out, seen = [], set()
    for i, kind, key in rows:
        if out and out[-1][0] == kind and out[-1][3] < size and not (kind == 3 and key in seen):
            out[-1][2:] = [i, out[-1][3] + 1]
        else:
            out.append([kind, i, i, 1])
            seen = set()
        seen |= {key} if kind == 3 else set()
    return [(n, *g) for n, g in enumerate(out, 1)]


@pytest.mark.parametrize("size, range_rows", [(7, 7), (5, 16), (200, 1000)])
def test_no_group_updates_a_key_twice(spark, size, range_rows):
    from tablewright.operators import groups

    rng = random.Random(size)
    rows = [(3 * i, rng.choice([3, 3, 3, 3, 1, 2]) if i % 40 < 20 else 3, 1 if rng.random() < 0.34 else rng.randrange(60)) for i in range(900)]  # a hot key
    log = spark.createDataFrame(rows, "change_id long, dml_type long, k long").repartition(3)
    assert sorted(map(tuple, groups.change_groups(log, size, ["k"], range_rows).collect())) == brute_groups(rows, size)
    assert groups.change_groups(log.limit(0), size, ["k"]).count() == 0


def brute_accepted(rows, unique):
    taken, out = set(), set()
    for row in rows:
        keys = {(i, tuple(row[c] for c in u)) for i, u in enumerate(unique) if None not in [row[c] for c in u]}
        if not keys & taken:
            taken |= keys
            out.add(row["o"])
    return out


@pytest.mark.parametrize("few", [0, 100_000])
def test_several_unique_keys(spark, few):
    from tablewright.operators import uniques

    rng = random.Random(3)
    rows = [{"o": o, "a": rng.choice([None, *range(40)]), "b": rng.randrange(30), "c": rng.choice("xyz"), "d": 7 if rng.random() < 0.33 else o} for o in range(300)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "o long, a long, b long, c string, d long").repartition(3)
    unique = [["a"], ["b", "c"], ["d"]]
    assert {r.o for r in uniques.accepted(frame, unique, ["o"], few=few).collect()} == brute_accepted(rows, unique)
    table = frame.where("o < 20")
    base = [r for r in rows if r["o"] < 20]
    later = uniques.accepted(frame.where("o >= 20"), [["a"], ["d"]], ["o"], table=table, few=few)
    free = [r for r in rows if r["o"] >= 20 and not any(r["a"] is not None and r["a"] == b["a"] or r["d"] == b["d"] for b in base)]
    assert {r.o for r in later.collect()} == brute_accepted(free, [["a"], ["d"]])


def test_a_chain_of_unique_keys(spark):
    from tablewright.operators import uniques

    rows = [{"o": i, "a": i // 2, "b": (i + 1) // 2} for i in range(1000)]  # each row meets the one before and the one behind
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "o long, a long, b long").repartition(3)
    assert {r.o for r in uniques.accepted(frame, [["a"], ["b"]], ["o"]).collect()} == brute_accepted(rows, [["a"], ["b"]])


def test_an_inserted_row_changes_one_range(spark):
    from tablewright.operators import tree

    rows = [(a, b, f"v{a}{b}") for a in range(60) for b in range(10)]
    old = spark.createDataFrame(rows, "a long, b long, v string")
    new = spark.createDataFrame([*rows, (30, 4_000, "more")], "a long, b long, v string")
    t = tree.ChecksumTree.over(old, ["a", "b"], 9, fanout=4)
    found = t.differing(old, new, ["a", "v"])
    assert [(r.node, r.cnt_old, r.cnt_new) for r in found.collect()] == [(309 // 9, 9, 10)]
    assert t.depth == 4 and [(x.nodes, x.differing) for x in t.levels] == [(1, 1)] * 4
    assert [x.rows for x in t.levels] == [1201, 1153, 289, 73]  # 64, 16 and 4 leaves of 9 rows a side, and the row
    mixed = spark.createDataFrame([(a, b, v + "!" if (a, b) in ((0, 0), (59, 9)) else v) for a, b, v in rows if (a, b) != (12, 3)], old.schema)
    got = {r.chunk_id: (r.cnt_old, r.cnt_new, r.mismatched) for r in tree.differing_chunks(old, mixed, ["a", "b"], ["a", "b", "v"], 9, 4).collect()}
    assert got == {0: (9, 9, "v"), 13: (9, 8, "a,b,v"), 66: (6, 6, "v")}
    assert tree.differing_chunks(old, old, ["a", "b"], ["v"], 9, 4).count() == 0
    none = old.limit(0)
    assert tree.differing_chunks(none, none, ["a", "b"], ["v"], 9).count() == 0
    assert [(r.chunk_id, r.cnt_old, r.cnt_new) for r in tree.differing_chunks(none, old, ["a", "b"], ["v"], 9).collect()] == [(0, 0, 600)]
    huge = tree.differing_chunks(old, none, ["a", "b"], ["v"], 9, 4)
    assert huge.count() == 67 and huge.where("cnt_new > 0").count() == 0


def test_equal_changes_of_two_ranges_do_not_cancel(spark):
    from tablewright.operators import tree

    rows = [(i, "a") for i in range(900)]
    old = spark.createDataFrame(rows, "k long, v string")
    new = spark.createDataFrame([(k, "b" if k in (5, 14, 500, 501) else v) for k, v in rows], old.schema)  # 5 and 14: two leaves; 500 and 501: one
    found = tree.differing_chunks(old, new, ["k"], ["k", "v"], 9, 4)
    assert sorted(map(tuple, found.collect())) == [(0, None, 9, 9, "v"), (1, 9, 9, 9, "v")]


def test_ranges_are_summed_in_one_reading(spark):
    """Rows that are hashed do not grow with the levels of the tree, though every range differs; equal keys share a range on both sides."""
    from tablewright.operators import tree

    hashed = spark.sparkContext.accumulator(0)

    def told(name):
        @F.udf("long")
        def own(value):
            hashed.add(1)
            return int.from_bytes(hashlib.md5(str(value).encode()).digest()[:7])  # not linear, as a CRC is

        return own(name)

    rng = random.Random(4)
    keys = [rng.randrange(-50, 250) for _ in range(500)]
    old = spark.createDataFrame([(k if k else None, i) for i, k in enumerate(keys)], "k int, v long").repartition(3)
    new = spark.createDataFrame([(k if k else None, i + 1_000) for i, k in enumerate(keys)] + [(-90, 1), (300, 2)], "k int, v long").repartition(2)
    ordered = sorted(keys, key=lambda k: k or -1_000)
    place = lambda k: max(0, (sum(1 for x in ordered if (x or -1_000) <= k) - 1) // 7)
    sides = [Counter(place(k or -1_000) for k in side) for side in (keys, [*keys, -90, 300])]
    found = tree.differing_chunks(old, new, ["k"], ["v"], 7, 2, told).collect()
    assert sorted((r.chunk_id, r.cnt_old, r.cnt_new) for r in found) == sorted((n, sides[0][n], sides[1][n]) for n in sides[1])
    assert all(r.first_k == ordered[r.chunk_id * 7] or (r.first_k is None and not ordered[r.chunk_id * 7]) for r in found if r.chunk_id)
    assert hashed.value == 1_002


def test_a_migration_computes_its_changes_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def told(value):
        made.add(1)
        return value

    old, new = parse_table("CREATE TABLE t (k BIGINT NOT NULL, v VARCHAR(9), PRIMARY KEY (k))"), parse_table("CREATE TABLE t (k BIGINT NOT NULL, v VARCHAR(19), PRIMARY KEY (k))")
    table = spark.createDataFrame([(k, "a") for k in range(50)], "k long, v string")
    changes = spark.createDataFrame([(1, 3, 4, "b"), (2, 2, 5, None), (3, 1, 70, "c")], "change_id long, dml_type long, k long, v string").withColumn("k", told("k"))
    expected = spark.createDataFrame([(k, "b" if k == 4 else "a") for k in range(50) if k != 5] + [(70, "c")], "k long, v string")
    moved, wrong = Migration(old, new, strict=True).run(table, changes, expected)
    assert wrong.count() == 0 and sorted(moved.collect()) == sorted(expected.collect())
    assert made.value == 3


def test_ranges_grow_with_the_table(spark, tmp_path):
    from tablewright.streaming.replay_stream import ReplayTarget, replay_ranges

    target = ReplayTarget(spark, str(tmp_path / "t"), ["k"], buckets=4)
    target.start(spark.range(600_000).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    log = spark.createDataFrame([(1, 3, 5, "b"), (600_001, 2, 7, None), (1_100_000, 3, 6, "c")], LOG)
    assert replay_ranges(log, target) == 2  # of 600,000 ids, as the table has rows; each writes all its buckets again
    assert target.table().count() == 599_999 and {tuple(r) for r in target.table().where("v <> 'a'").collect()} == {(5, "b"), (6, "c")}


def test_violations_of_a_hot_key(spark):
    rng = random.Random(9)
    log = [(i, rng.choice([1, 2, 3]), rng.choice([1, 1, 1, *range(9)]), "x") for i in range(1, 400)]
    base = {1, 2, 3}
    state, odd, strict = set(base), [], []
    for i, kind, k, _ in log:
        odd += [i] if (kind == 2 and k not in state) or (kind == 1 and k in state) else []
        strict += [i] if (kind in (2, 3) and k not in state) or (kind == 1 and k in state) else []
        state = state | {k} if kind == 1 else state - {k} if kind == 2 else state
    table, changes = spark.createDataFrame([(k,) for k in base], "k long"), spark.createDataFrame(log, LOG).repartition(3)
    assert sorted(r.change_id for r in replay.violations(table, changes, ["k"]).collect()) == odd
    assert sorted(r.change_id for r in replay.violations(table, changes, ["k"], updates=True).collect()) == strict
    assert replay.violations(table, changes.limit(0), ["k"]).count() == 0


def test_strong_checksum_sees_a_moved_value(spark):
    a, b = (spark.createDataFrame([row], "k long, x string, y string") for row in ((1, None, "v"), (1, "v", None)))
    for way in (verify.strong, verify.strong_portable):
        assert way(a, ["k", "x", "y"]).first() != way(b, ["k", "x", "y"]).first()


def test_no_swap_without_a_comparison(spark, table):
    none = spark.createDataFrame([], LOG)
    odd = spark.createDataFrame([(1, 3, 99, "fits no row")], LOG)
    table.write.mode("overwrite").saveAsTable("t")
    try:
        more = table.unionByName(spark.createDataFrame([(77, "x")], "k long, v string").select(*[F.col(c).cast(t).alias(c) for c, t in table.dtypes]))
        with pytest.raises(MigrationError, match="CHECKSUM_MISMATCH"):
            Migration(OLD, NEW).run_table(spark, "t", none, expected=more)
        with pytest.raises(MigrationError, match="UNVERIFIED_SWAP"):
            Migration(OLD, NEW).run_table(spark, "t", odd)
        with pytest.raises(MigrationError, match="UNVERIFIED_SWAP"):
            Migration(OLD, NEW, where="k > 1").run_table(spark, "t", none)
        broken = Migration(OLD, NEW)
        broken.replayed = lambda copy, changes, keys: copy.where("k <> 2")  # a fold that loses a row
        with pytest.raises(MigrationError, match="CHECKSUM_MISMATCH"):
            broken.run_table(spark, "t", none)
        keys = foreign_keys(spark, [parse_table("CREATE TABLE c (i INT NOT NULL, PRIMARY KEY (i), CONSTRAINT f FOREIGN KEY (i) REFERENCES t (k))")], "t")
        with pytest.raises(MigrationError, match="FOREIGN_KEY_FOUND"):
            Migration(OLD, NEW, foreign=keys).run_table(spark, "t", none)
        with pytest.raises(MigrationError, match="NOT_ENOUGH_SPACE"):
            Migration(OLD, NEW, free_bytes=10).run_table(spark, "t", none)
        with pytest.raises(MigrationError, match="DB_NOT_EXIST"):
            Migration(OLD, NEW).run_table(spark, "nowhere.t", none)
        with pytest.raises(MigrationError, match="TABLE_TIMESTAMP_CHANGED_ERROR"):
            Migration(OLD, NEW, hooks={"after_verify": lambda: spark.createDataFrame([(50, "w")], "k long, v string").select(*[F.col(c).cast(t).alias(c) for c, t in table.dtypes]).write.insertInto("t")}).run_table(spark, "t", none)
        table.write.mode("overwrite").saveAsTable("t")
        assert spark.table("t").columns == ["k", "v"] and not clean_up(spark)
        unique = parse_table(NEW.sql().split(", PRIMARY")[0] + ", PRIMARY KEY (k), UNIQUE KEY u (v))") if ", PRIMARY" in NEW.sql() else None
        if unique is not None:
            twice = spark.createDataFrame([(1, 1, 8, "same"), (2, 1, 9, "same")], LOG)
            with pytest.raises(MigrationError, match="DUPLICATE_KEY"):
                Migration(OLD, unique).run_table(spark, "t", twice)
            Migration(OLD, unique, eliminate_dups=True).run_table(spark, "t", twice)
            assert spark.table("t").where("v = 'same'").select("k").first().k == 8
            table.write.mode("overwrite").saveAsTable("t")
        table.write.mode("overwrite").saveAsTable(PREFIXES["new"] + "t")
        run = Migration(OLD, NEW, swap_unverified=True, force_cleanup=True, ceiling=1, chunk_rows=None)
        run.run_table(spark, "t", spark.createDataFrame([(1, 3, 99, "fits no row"), (2, 2, 1, None)], LOG))
        assert spark.table("t").count() == 3 and "n" in spark.table("t").columns
        copied = {r[0]: r for r in run.stats.rows()}["copy"]
        assert copied[1] == 3 and copied[2] > 0 and copied[4] > 0
    finally:
        clean_up(spark)
        spark.sql("DROP TABLE IF EXISTS t")


def test_long_names_beside_a_table():
    from tablewright.migrate import LONGEST_NAME, beside

    a, b = "x" * 60 + "a", "x" * 60 + "b"
    assert beside("__tw_new_", "t") == "__tw_new_t" and beside("__tw_new_", a) != beside("__tw_new_", b) and len(beside("__tw_new_", a)) == LONGEST_NAME


def test_a_round_verifies_its_own_changes(spark, tmp_path):
    from tablewright.streaming.verified import VerifiedChanges

    store = VerifiedChanges(spark, str(tmp_path / "v"), ["k"], ["k", "v"])
    store.start()
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    log = lambda *ids: spark.createDataFrame([(i, 3, i % 10, "x") for i in ids], LOG)
    good, bad = frame([(k, f"v{k}") for k in range(20)]), frame([(k, "other" if k in (4, 15) else f"v{k}") for k in range(20)])
    assert store.round(log(1, 2, 3, 6, 7), good, bad) == 5  # keys 4 and 15 were not changed
    assert sorted(map(tuple, store.missing().collect())) == [(4, 5)] and store.verified() == 7
    with pytest.raises(MigrationError, match="CHECKSUM_MISMATCH"):  # the late change 4 touches key 4
        store.round(log(1, 2, 3, 4, 6, 7, 8), good, bad)
    assert store.round(log(1, 2, 3, 4, 6, 7, 8, 9), good, good) == 3 and store.verified() == 9
    assert store.round(log(1, 2, 3, 4, 6, 7, 8, 9), good, bad) == 0
    assert [tuple(r) for r in store.missing().collect()] == [(5, 5)] and store.touched().count() == 8


def test_range_bounds_of_several_columns(spark):
    by = parse_partitions("RANGE COLUMNS (a, b) (PARTITION p0 VALUES LESS THAN (1, 'm'), PARTITION p1 VALUES LESS THAN (1, MAXVALUE), PARTITION p2 VALUES LESS THAN (5, 'a'), PARTITION p3 VALUES LESS THAN (MAXVALUE, MAXVALUE))")
    rows = [(0, "z", "p0"), (None, "z", "p0"), (1, None, "p0"), (1, "l", "p0"), (1, "m", "p1"), (1, "zz", "p1"), (2, "a", "p2"), (5, "A", "p2"), (5, "a", "p3"), (6, None, "p3")]
    got = spark.createDataFrame(rows, "a int, b string, want string").select(by.assign().alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_only_differing_partitions_move(spark, tmp_path):
    from tablewright.operators.partitioned import PartitionedCopy

    rows = spark.createDataFrame([(k, f"{'abc'[k % 3]}/x", f"v{k}") for k in range(90)], "k long, kind string, v string")
    copy = PartitionedCopy(spark, str(tmp_path / "t"), F.col("kind"), rows.schema, shares=3)
    copy.write(rows)
    files = lambda: {f: (tmp_path / "t").joinpath(f).stat().st_mtime_ns for f in (str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t").rglob("*.parquet"))}
    before = files()
    wanted = rows.where("kind <> 'b/x'").withColumn("v", F.when(F.col("k") == 2, "new").otherwise(F.col("v"))).unionByName(spark.createDataFrame([(500, "d", "more")], rows.schema))
    assert sorted(map(tuple, copy.sync(wanted).collect())) == [("add", "d", 1), ("drop", "b/x", 30), ("replace", "c/x", 30)]
    assert sorted(map(tuple, copy.rows().collect())) == sorted(map(tuple, wanted.collect()))
    after_ = files()
    assert {f for f in before if "a%2Fx" in f} == {f for f in after_ if "a%2Fx" in f and before.get(f) == after_[f]} and not [f for f in after_ if "b%2Fx" in f]
    assert copy.sync(wanted).count() == 0
    with pytest.raises(MigrationError, match="NO_PARTITION"):
        copy.write(spark.createDataFrame([(1, None, "x")], rows.schema))


def test_keys_without_case(spark):
    plain = spark.createDataFrame([("Ann", 1), ("bob", 2), ("Zoé", 3)], "k string, v long")
    table = collated(plain, {"k": "UTF8_LCASE"})
    log = collated(spark.createDataFrame([(1, 3, "ANN", 10), (2, 2, "Bob", None), (3, 1, "zoÉ", 30), (4, 1, "new", 4), (5, 1, "NEW", 5)], "change_id long, dml_type long, k string, v long"), {"k": "UTF8_LCASE"})
    got = replay.folded(table, log, ["k"]).collect()
    assert sorted((r.k, r.v) for r in got) == [("Ann", 10), ("Zoé", 3), ("new", 4)]
    numbers = chunks.numbered(collated(spark.createDataFrame([(x,) for x in "bADc"], "k string"), {"k": "UTF8_LCASE"}), ["k"]).collect()
    assert {r.k: r.row_no for r in numbers} == {"A": 1, "b": 2, "c": 3, "D": 4}


def test_ranges_without_ids():
    import numpy as np

    from tablewright.streaming.gap_stream import without

    firsts, lasts, ages = np.array([3, 20, 40]), np.array([9, 20, 41]), np.array([5, 6, 7])
    a, b, age, odd = without(firsts, lasts, ages, np.array([1, 3, 5, 6, 20, 30, 41]))
    assert list(zip(a.tolist(), b.tolist(), age.tolist(), strict=True)) == [(4, 4, 5), (7, 9, 5), (40, 40, 7)] and odd == 2
    assert without(firsts[:0], lasts[:0], ages[:0], np.array([4]))[3] == 1


def test_gaps_as_streaming_state(spark, tmp_path):
    from tablewright.streaming.gap_stream import GapTracker

    tracker = GapTracker(spark, str(tmp_path / "told"), start=5, size=20)
    seen = []

    def round_(ids):
        seen.extend(ids)
        spark.createDataFrame([(i,) for i in ids], "change_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        tracker.round(spark.readStream.schema("change_id long").parquet(str(tmp_path / "log")), str(tmp_path / "c"))  # a new stream each time: a restart
        want = gaps.gap_ranges(spark.createDataFrame([(i,) for i in seen], "change_id long"), 5).collect()
        got = tracker.missing().collect()
        assert sorted(i for r in got for i in range(r.first, r.last + 1)) == sorted(i for a, b in want for i in range(a, b + 1))
        return {r.first: r.age for r in got}

    assert round_([6, 7, 9, 15, 16, 30]) == {8: 0, 10: 0, 17: 0, 20: 0}
    assert round_([8, 12, 110, 111]).keys() == {10, 13, 17, 20, 31, 80, 100}  # cells 2 to 4 are wholly missing, of which only the last is known
    ages = round_([13, 55, 14])
    assert ages[10] >= 2 and ages[17] >= 2 and 13 not in ages and 14 not in ages
    assert {r.first for r in tracker.too_old(2).collect()} >= {10, 17} and tracker.told().where("repeated > 0").count() == 0
    tracker.round(spark.readStream.schema("change_id long").parquet(str(tmp_path / "log")), str(tmp_path / "c"))


def test_columns_that_the_log_lacks(spark):
    """Known without a reading: rows that were inserted again have defaults, others keep their values; null keys are not replayed."""
    old = parse_table("CREATE TABLE m (k BIGINT NOT NULL, v VARCHAR(9), w VARCHAR(9) DEFAULT 'd', PRIMARY KEY (k))")
    new = parse_table("CREATE TABLE m (k BIGINT NOT NULL, v VARCHAR(20), w VARCHAR(9) DEFAULT 'd', n INT DEFAULT 3, PRIMARY KEY (k))")
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "k long, v string, w string")
    log = spark.createDataFrame([(1, 2, 1, None), (2, 1, 1, "again"), (3, 3, 1, "later"), (4, 3, 2, "B"), (5, 1, 9, "new"), (6, 1, None, "nowhere")], LOG)
    base.write.mode("overwrite").saveAsTable("m")
    try:
        assert Migration(old, old).run_table(spark, "m", log) is None and spark.table("m").count() == 3
        Migration(old, new).run_table(spark, "m", log)
        assert sorted(map(tuple, spark.table("m").collect())) == [(1, "later", "d", 3), (2, "B", "y", 3), (3, "c", "z", 3), (9, "new", "d", 3)]
    finally:
        clean_up(spark)
        spark.sql("DROP TABLE IF EXISTS m")


def test_way_of_a_dump(spark, tmp_path):
    from tablewright.migrate import dump_table

    old = parse_table("CREATE TABLE d (k BIGINT NOT NULL, v VARCHAR(9), PRIMARY KEY (k))")
    other = parse_table("CREATE TABLE d (k BIGINT NOT NULL, v VARCHAR(9) NOT NULL, PRIMARY KEY (v))")
    keyless = parse_table("CREATE TABLE d (k BIGINT, v VARCHAR(9))")
    assert checks.dump_keys(old, old, ["k"], 1 << 40) == ["k"] and checks.dump_keys(old, other, ["k"], 1 << 20) is None
    with pytest.raises(MigrationError, match="NO_INDEX_COVERAGE"):
        checks.dump_keys(old, other, ["k"], checks.WHOLE_DUMP_BYTES)
    with pytest.raises(MigrationError, match="NO_INDEX_COVERAGE"):
        checks.require_migratable(old, other)
    assert checks.require_migratable(old, other, table_bytes=1 << 20) == ["k"]
    spark.createDataFrame([(i, f"v{i}") for i in range(500)], "k long, v string").write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    for n, (a, b, way) in enumerate([(old, old, ["k"]), (old, other, None), (keyless, old, None)]):
        assert dump_table(table, a, b, str(tmp_path / f"out{n}"), 2000) == way
        assert sorted(map(tuple, chunks.load(spark, str(tmp_path / f"out{n}"), table.schema).collect())) == sorted(map(tuple, table.collect()))
    assert len(list((tmp_path / "out0").glob("chunk_id=*"))) > 2
