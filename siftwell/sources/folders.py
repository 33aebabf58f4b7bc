"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from siftwell.errors import StorageError


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on a local master, as in tests, a temporary folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    given = sc._jsc.sc().getCheckpointDir()
    if not folder and given.isDefined():
        folder = given.get()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("on a cluster, set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="siftwell-")
    if not given.isDefined():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: rows are whole texts: Spark's own value, and the one for long rows
TEXT_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def text_batches(spark: SparkSession) -> None:
    """Arrow batches for long rows, where the session still has Spark's own size."""
    key, given, long_rows = TEXT_BATCH
    if spark.conf.get(key) == given:
        spark.conf.set(key, long_rows)


class Folder:
    """A folder of any Hadoop file system, as the driver sees it: names, markers and removal; rows go through Spark."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.path = path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def mark(self, name: str) -> None:
        self._fs.create(self._at(name), True).close()

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def put(self, name: str, content: bytes) -> None:
        """A small file, which is there whole or not at all; one of that name stays as it is until then."""
        held = self._at(f"{name}.{uuid.uuid4().hex}.part")
        out = self._fs.create(held, True)
        try:
            out.write(content)
        finally:
            out.close()
        if not self._fs.rename(held, self._at(name)):
            self._fs.delete(held, False)
            raise StorageError(f"{self.path}/{name} could not be written")
