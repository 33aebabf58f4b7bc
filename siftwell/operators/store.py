"""Tables that are appended to and whose last rows win."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.sources.folders import Folder, shared_folder


def latest(rows: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The row of the highest seq for each key: an upsert as an append."""
    w = Window.partitionBy(key).orderBy(F.col(seq).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def passing(spark: SparkSession) -> str:
    """A new folder, in the one that driver and executors share, for tables that no path was given for."""
    return f"{shared_folder(spark)}/passing-{uuid.uuid4().hex}"


#: rows that go with a broadcast, where they are counted
BROADCAST_ROWS = 1_000_000


def stored(rows: DataFrame) -> DataFrame:
    """Thin rows, such as rankings, written once to the shared folder: what comes next counts and rereads them and computes nothing again."""
    path = passing(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """rows, to be broadcast if a count finds no more than limit of them."""
    return F.broadcast(rows) if rows.count() <= (BROADCAST_ROWS if limit is None else limit) else rows


class Versions:
    """Rows by id, appended in batches; an id's row in the last batch that has it is its live one.

    Each batch is a folder seq=N.  The ids that it replaces, (id, seq) of rows
    that are dead from then on, are found once, when it is written, from ids
    alone; reading is a plain scan as long as nothing was replaced, and an anti
    join with the dead rows otherwise.  A marker is written last: a batch
    without one was cut off and is not read.  Every batch is a file scan, so a
    plan does not grow with what its batches were made from.
    """

    def __init__(self, spark: SparkSession, root: str | None, name: str):
        self.spark = spark
        self.folder = Folder(spark, f"{root or passing(spark)}/{name}")
        self.batches: list[int] = sorted(int(x) for x in self.folder.names("done"))

    def _read(self, part: str, batches: list[int]) -> DataFrame | None:
        if not batches:
            return None
        base = f"{self.folder.path}/{part}"
        return self.spark.read.option("basePath", base).option("mergeSchema", len(batches) > 1).parquet(*[f"{base}/seq={n}" for n in batches]).withColumn("seq", F.col("seq").cast("long"))

    def _write(self, part: str, number: int, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder.path}/{part}/seq={number}")
        return self._read(part, [number])

    def rows(self, batches: list[int]) -> DataFrame | None:
        """All rows of some batches, live or not."""
        return self._read("rows", batches)

    def dead(self) -> DataFrame | None:
        """(id, was) of rows that a later batch replaced."""
        return self._read("dead", sorted(n for n in (int(x.split("=")[1]) for x in self.folder.names("dead")) if n in self.batches))

    def append(self, rows: DataFrame, replace: bool = True, once: bool = False) -> int:
        """A batch of rows, one for each id (any number where nothing is to be replaced); its number.  once: of rows with one id, one is taken."""
        number, before = (self.batches[-1] if self.batches else 0) + 1, self.live("id") if replace else None
        new = self._write("rows", number, rows)
        # written ids alone are compared, so that nothing is computed again unless one stands twice
        if once and new.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            new = self._write("rows", number, rows.dropDuplicates(["id"]))
        if before is not None:
            replaced = before.select("id", F.col("seq").alias("was")).join(new.select("id"), "id", "left_semi")
            if self._write("dead", number, replaced).limit(1).count() == 0:
                self.folder.remove(f"dead/seq={number}")
        self.folder.mark(f"done/{number}")
        self.batches.append(number)
        return number

    def live(self, *columns: str) -> DataFrame | None:
        """The live rows with seq, the batch they came in; None while there are none.  columns: those that are read, beside seq."""
        rows = self._read("rows", self.batches)
        if rows is None:
            return None
        rows = rows.select(*columns, "seq") if columns else rows
        return self.without_dead(rows)

    def without_dead(self, rows: DataFrame) -> DataFrame:
        """rows (id, seq, ...) that no later batch replaced."""
        dead = self.dead()
        return rows if dead is None else rows.join(dead.select("id", F.col("was").alias("seq")), ["id", "seq"], "left_anti")

    def compact(self, live: DataFrame | None = None) -> None:
        """All live rows, by default those of this table's own account, as one batch; the others are removed."""
        if len(self.batches) < 2:
            return
        old, number = list(self.batches), self.batches[-1] + 1
        self._write("rows", number, (self.live() if live is None else live).drop("seq"))
        self.folder.mark(f"done/{number}")
        # without their markers the old batches are not read, whenever this stops
        for n in old:
            self.folder.remove(f"done/{n}")
        for n in old:
            self.folder.remove(f"rows/seq={n}")
            self.folder.remove(f"dead/seq={n}")
        self.batches = [number]
