"""Sources: declared schemas from files, tables from Parquet, and what shows that a source changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import MigrationError
from tablewright.functions.columns import columns, quoted
from tablewright.plans.schema import TableSpec, parse_table


def read_ddl(spark: SparkSession, path: str, engine: str | None = None) -> TableSpec:
    """A CREATE TABLE file from any store; comment lines are left out."""
    text = spark.read.text(path, wholetext=True).first().value
    table = parse_table("\n".join(line for line in text.split("\n") if not line.startswith("--")))
    if engine and table.options.get("ENGINE", engine).lower() != engine.lower():
        raise MigrationError("INVALID_SYNTAX", message=f"engine {table.options['ENGINE']}")
    return table


def scan(table: DataFrame, names: list[str], where: str | None = None) -> DataFrame:
    """Projection and the user's filter; both reach the Parquet scan."""
    return (table.where(F.expr(where)) if where else table).select(*columns(names))


def fingerprint(table: DataFrame) -> int:
    """Of the files that a table reads, by path, length and time of change: differs when any is added, removed or written again."""
    spark = table.sparkSession
    paths = table.inputFiles()
    if not paths:
        return 0
    folders = sorted({p.rsplit("/", 1)[0] for p in paths})
    files = spark.read.format("binaryFile").load(folders).select("path", "length", "modificationTime")
    return files.agg(F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0).cast("long"))).first()[0]


def require_unchanged(table: DataFrame, before: int) -> None:
    if fingerprint(table) != before:
        raise MigrationError("TABLE_TIMESTAMP_CHANGED_ERROR")


def size(table: DataFrame) -> tuple[int, int]:
    """Files and bytes that a table reads: by listing, without reading any."""
    folders = sorted({p.rsplit("/", 1)[0] for p in table.inputFiles()})
    if not folders:
        return 0, 0
    return tuple(table.sparkSession.read.format("binaryFile").load(folders).agg(F.count(F.lit(1)), F.sum("length")).first())


def partition_names(spark: SparkSession, table: str) -> DataFrame:
    """part: the partitions of a table of the catalog."""
    return spark.sql(f"SHOW PARTITIONS {quoted(table)}").select(F.col("partition").alias("part"))


def require_database(spark: SparkSession, database: str) -> None:
    if not spark.catalog.databaseExists(database):
        raise MigrationError("DB_NOT_EXIST", database=database)


def foreign_keys(spark: SparkSession, specs: list[TableSpec], table: str) -> DataFrame:
    """name, child, col, parent of all foreign keys of a table or on it: rules and the columns that they use, joined by name."""
    rules = [(f[0], s.name, f[2]) for s in specs for f in s.foreign]
    usage = [(f[0], s.name, c) for s in specs for f in s.foreign for c in f[1]]
    named = spark.createDataFrame(rules, "name string, child string, parent string")
    used = spark.createDataFrame(usage, "name string, child string, col string")
    return named.join(used, ["name", "child"]).where((F.col("child") == table) | (F.col("parent") == table)).select("name", "child", "col", "parent")
