"""A copy of a table in physical partitions, brought in line with a table partition by partition: only partitions that differ are
written, those that are gone are dropped, and the others' files are left alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.errors import MigrationError
from tablewright.functions.columns import checked_columns, columns, md5_prefix
from tablewright.operators.verify import compared, sums
from tablewright.sources.shared import computed

PART = "__part"


class PartitionedCopy:
    def __init__(self, spark: SparkSession, path: str, part: Column, schema: StructType, file_rows: int = 5_000_000, shares: int = 16):
        """part: the name of a row's partition; a partition is written by `shares` tasks, in files of `file_rows` rows at most."""
        self.spark, self.path, self.part, self.schema, self.file_rows, self.shares = spark, path, part, schema, file_rows, shares

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select("*", self.part.cast("string").alias(PART))

    def write(self, rows: DataFrame, only: DataFrame | None = None) -> None:
        """Write the partitions of these rows (only: those of this frame, by part), each in place of what it was. NO_PARTITION if no partition takes some row."""
        placed = self._placed(rows)
        if lost := placed.where(F.col(PART).isNull()).count():
            raise MigrationError("NO_PARTITION", count=lost)
        if only is not None:
            placed = placed.join(F.broadcast(only.select(F.col("part").alias(PART))), PART, "left_semi").select(*columns(rows.columns), PART)
        share = F.pmod(F.xxhash64(*columns(rows.columns)), F.lit(self.shares))  # a large partition is no single task's
        dealt = placed.repartition(PART, share)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", self.file_rows).partitionBy(PART).parquet(self.path)

    def read(self) -> DataFrame:
        typed = StructType([*self.schema.fields]).add(PART, "string")
        return self.spark.read.schema(typed).parquet(self.path)

    def rows(self) -> DataFrame:
        return self.read().drop(PART)

    def differences(self, rows: DataFrame) -> DataFrame:
        """part, cnt_old (of the copy), cnt_new, mismatched of the partitions in which the copy is not what the rows are."""
        names = checked_columns(rows)
        by_part = lambda frame: frame.groupBy(F.col(PART).alias("part")).agg(*sums(names, md5_prefix))
        return compared(by_part(self.read()), by_part(self._placed(rows)), "part", names)

    def drop(self, parts: list[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for part in parts:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{PART}={escaped(part)}")
            folder.getFileSystem(conf).delete(folder, True)

    def sync(self, rows: DataFrame) -> DataFrame:
        """Bring the copy in line with the rows; action (add, drop, replace), part, n (rows of the partition; of a dropped one those that went)."""
        action = F.when(F.col("cnt_old") == 0, "add").when(F.col("cnt_new") == 0, "drop").otherwise("replace")
        found = computed(self.differences(rows).select(action.alias("action"), "part", F.when(action == "drop", F.col("cnt_old")).otherwise(F.col("cnt_new")).alias("n")))
        moved = found.where("action <> 'drop'")
        if moved.limit(1).count():
            self.write(rows, moved)
        self.drop([r.part for r in found.where("action = 'drop'").select("part").collect()])
        return found
