"""What a migration made and has to take away again: registered while it is made, removed in order."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tablewright.functions.columns import quoted


class CleanUp:
    """Files go first, then views, then tables; what is gone already is passed over."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.files: list[str] = []
        self.views: list[str] = []
        self.tables: list[str] = []

    def forget(self, name: str) -> None:
        """What is to stay, as after a swap."""
        for kind in (self.files, self.views, self.tables):
            if name in kind:
                kind.remove(name)

    def listed(self) -> list[tuple[str, str]]:
        return [(kind, name) for kind, names in (("file", self.files), ("view", self.views), ("table", self.tables)) for name in names]

    def run(self) -> list[tuple[str, str]]:
        """Remove everything; what was removed, in order."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        removed = []
        for kind, name in self.listed():
            if kind == "file":
                path = jvm.org.apache.hadoop.fs.Path(name)
                done = path.getFileSystem(conf).delete(path, True)
            elif kind == "view":
                done = self.spark.catalog.dropTempView(name)
            else:
                done = self.spark.catalog.tableExists(name)
                self.spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")
            if done:
                removed.append((kind, name))
        self.files, self.views, self.tables = [], [], []
        return removed
