"""A log of versions that any number of writers may extend: version n is whoever first puts a commit in its place."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Commit:
    """Who made a version (writer and its batch), of which change ids, and the folder that holds it."""

    version: int
    writer: str
    batch: int
    first_id: int | None
    last_id: int | None
    folder: str


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint: the same after a restart, another one for another checkpoint, in the same place too."""
    return json.loads(read_text(spark, f"{checkpoint}/metadata"))["id"]


class CommitLog:
    """Commits under `path`, one small file for each version. A file is written aside and renamed to its place, which fails if the place is
    taken: the store's rename must be atomic (as on HDFS and local disks)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path, spark.sparkContext._jvm
        self.conf, self.gateway = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.known: dict[int, Commit] = {}

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.conf)

    def entries(self) -> list[Commit]:
        """All commits in order; files of known ones are not read again."""
        fs, root = self._fs(), self.jvm.org.apache.hadoop.fs.Path(self.path)
        found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        for name in found:
            if name.endswith(".json") and not name.startswith(".") and int(name[:-5]) not in self.known:
                self.known[int(name[:-5])] = Commit(**json.loads(read_text(self.spark, f"{self.path}/{name}")))
        return [self.known[v] for v in sorted(self.known)]

    def claim(self, commit: Commit) -> bool:
        """Put the commit in its version's place; False if another one is there."""
        aside, place = self._at(f".{uuid.uuid4().hex}"), self._at(f"{commit.version}.json")
        stream = self._fs().create(aside, True)
        try:
            stream.write(bytearray(json.dumps(asdict(commit)).encode()))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.gateway.new_array(options, 1)
        none[0] = options.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.conf).rename(aside, place, none)
        except Exception:
            self._fs().delete(aside, False)
            if not self._fs().exists(place):
                raise
            return False
        return True
