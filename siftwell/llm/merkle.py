"""Merkle manifest of a dataset: a tree for each group of rows, one over the groups, and a proof for each row.

Digests are lower-case hexadecimal SHA-256.  The leaves of a group ascend by
their key; FAN consecutive nodes become one as long as there are several.

1. Leaves are hashed natively; from then on no text moves.  They are dealt by
   ranges of (group, key) and numbered in their tasks; only a group that goes on
   from one range to the next needs an offset, so there is one row a range.
2. Aligned blocks of FAN ** block_height leaves give one node each, those nodes
   are leaves of the next stage, and so on: a group of any size is many blocks.
3. From the top down, each block is traversed: one existing subtree for each
   band of levels holds what the paths need, while the next one, the desired
   subtree, takes a leaf at each step.  A leaf's path within its block is
   emitted with the path of the block, which came as one row, behind it.

A proof is an array with a string for each level: the digests left of the own
node in its run, a dot, and those right of it.  `folded` computes the root from
a leaf and a proof; `siblings` is the text of all digests of a proof.

Defined results: a null value counts as `-`, an empty text as `0:`; texts of any
length are hashed whole; null groups come first and are one group, null keys come
first; rows of equal keys follow in the order of their leaves, and equal rows have
places, and so proofs, of their own; a group of one row has its leaf as its root;
an empty table gives an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import Scratch

FAN = 3
BLOCK_HEIGHT, SUBTREE_HEIGHT = 6, 2
TASK_ROWS = 1 << 19
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: list[Column]) -> Column:
    """Digest of values, each as its UTF-8 byte count, a colon and itself, or - if it is null."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    return F.aggregate(proof, start, lambda own, step: F.sha2(F.replace(step, F.lit("."), own), 256))


def siblings(proof: Column) -> Column:
    return F.replace(F.array_join(proof, ""), F.lit("."), F.lit(""))


# --- traversal of a block --------------------------------------------------------------------------------------------


def _parent(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above n leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Subtree:
    """Nodes of the levels base to top - 1 below one node of level top, made leaf by leaf; below base only open runs are held."""

    def __init__(self, base: int, top: int):
        self.base, self.top, self.root = base, top, None
        self.nodes: list[list[str]] = [[] for _ in range(base, top)]
        self._open: list[list[str]] = [[] for _ in range(top)]

    def take(self, digest: str, level: int = 0) -> None:
        while level < self.top:
            if level >= self.base:
                self.nodes[level - self.base].append(digest)
            run = self._open[level]
            run.append(digest)
            if len(run) < FAN:
                return
            digest, level = _parent(run), level + 1
            run.clear()
        self.root = digest

    def close(self) -> None:
        """After the last leaf: runs that are not full become nodes too."""
        for level in range(self.top):
            if run := self._open[level]:
                digest = _parent(run)
                run.clear()
                self.take(digest, level + 1)


class Traversal:
    """Successive authentication paths of a block's leaves.

    Memory beside the leaves: two subtrees for each of ceil(height /
    subtree_height) bands.  Each step feeds one leaf to the desired subtree of
    each band, which is whole when the existing one is used up.
    """

    def __init__(self, leaves: list[str], height: int, subtree_height: int = SUBTREE_HEIGHT):
        self.leaves = leaves
        self.bands = [(a, min(a + subtree_height, height)) for a in range(0, height, subtree_height)]
        self.existing = [self._filled(*band, 0) for band in self.bands]
        self.root = self.existing[-1].root if self.bands else leaves[0]

    def _filled(self, base: int, top: int, at: int) -> Subtree:
        tree, span = Subtree(base, top), FAN**top
        for digest in self.leaves[at * span : (at + 1) * span]:
            tree.take(digest)
        tree.close()
        return tree

    def paths(self):
        """For each leaf, its siblings level by level; the list is changed by the next step."""
        n, path = len(self.leaves), [""] * (self.bands[-1][1] if self.bands else 0)
        desired = [Subtree(*band) for band in self.bands]
        for j in range(n):
            for i, (base, top) in enumerate(self.bands):
                span = FAN**top
                if j and j % span == 0:
                    desired[i].close()
                    self.existing[i], desired[i] = desired[i], Subtree(base, top)
                for level in range(base, top):
                    if j % FAN**level == 0:
                        path[level] = self._step(self.existing[i].nodes[level - base], j % span // FAN**level)
                if (ahead := j + span) < n:
                    desired[i].take(self.leaves[ahead])
            yield path

    @staticmethod
    def _step(nodes: list[str], at: int) -> str:
        first = at - at % FAN
        return "".join(nodes[first:at]) + "." + "".join(nodes[at + 1 : first + FAN])


# --- the distributed steps -------------------------------------------------------------------------------------------


def _tasks(rows: DataFrame, n: int) -> int:
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))


def _placed(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """rows (grp, ...) with place, the number of a row within its grp in ascending order; and the number of rows."""
    n = rows.count()
    by = ["grp", *order]

    def number(batches):
        task, at, last, run = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            places, runs = [], []
            for grp in batch["grp"].to_pylist():
                if run == 0 or grp != last:
                    at, last, run = 0, grp, run + 1
                places.append(at)
                runs.append(run == 1)
                at += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(places), task), pa.int32()), pa.array(places, pa.int64()), pa.array(runs, pa.bool_())], names=[*batch.schema.names, "task", "at", "head"])

    dealt = rows.repartitionByRange(_tasks(rows, n), *by).sortWithinPartitions(*by)
    schema = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes) + ", task int, at long, head boolean"
    held = scratch.keep(dealt.mapInArrow(number, schema), name)
    before = Window.partitionBy("grp").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counted = held.groupBy("grp", "task", "head").agg(F.count("*").alias("n"))
    # the first group of each task alone may have begun in another: one row a task
    offsets = counted.withColumn("offset", F.sum("n").over(before)).where("head").select("task", F.coalesce("offset", F.lit(0)).alias("offset"))
    offsets = scratch.keep(offsets, f"{name}-offsets")
    placed = held.join(F.broadcast(offsets), "task").withColumn("place", F.col("at") + F.when(F.col("head"), F.col("offset")).otherwise(0))
    return placed.drop("task", "at", "head", "offset"), n


def _in_blocks(rows: DataFrame, size: int, tasks: int, heads: DataFrame | None = None) -> DataFrame:
    """rows (grp, place, digest, ...) dealt by aligned blocks of size places, in order; heads (grp, blk, ...) stand before their blocks."""
    out = rows.withColumn("blk", F.expr(f"place div {size}"))
    if heads is not None:
        out = out.unionByName(heads.withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)
    return out.repartition(tasks, "grp", "blk").sortWithinPartitions("grp", "blk", "place")


def _blocks(batches):
    """Tables of the rows of one block each."""
    key, held = None, []
    for batch in batches:
        keys, start = list(zip(batch["grp"].to_pylist(), batch["blk"].to_pylist(), strict=True)), 0
        for i, k in enumerate(keys):
            if k != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield key, pa.Table.from_batches(held).combine_chunks()
                key, held, start = k, [], i
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _height(blk: int, n: int, block_height: int) -> int:
    """A group's only block ends at one node; where there are several, all reach block_height."""
    return height_of(n) if blk == 0 and n < FAN**block_height else block_height


def _stages(rows: DataFrame, n: int, block_height: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """The tables (grp, place, digest) of each stage: rows, their blocks' nodes, and so on to one node a group."""
    size, out = FAN**block_height, [rows]

    def climb(batches):
        for (grp, blk), table in _blocks(batches):
            tree = Subtree(0, _height(blk, table.num_rows, block_height))
            for digest in table["digest"].to_pylist():
                tree.take(digest)
            tree.close()
            yield pa.RecordBatch.from_pydict({"grp": pa.array([grp], pa.string()), "place": pa.array([blk], pa.int64()), "digest": pa.array([tree.root], pa.string())})

    while True:
        up = _in_blocks(out[-1].select("grp", "place", "digest"), size, _tasks(rows, n)).mapInArrow(climb, "grp string, place long, digest string")
        out.append(scratch.keep(up, f"{name}-{len(out)}"))
        n, last = out[-1].agg(F.count("*"), F.max("place")).first()
        if not last:
            return out


def _walked(rows: DataFrame, heads: DataFrame, n: int, block_height: int, subtree_height: int) -> DataFrame:
    """rows (grp, place, digest, ...) with proof and top; heads (grp, blk, upper, top) have the path of each block and what is said of its group."""
    kept = [c for c in rows.columns if c not in ("grp", "place", "digest")]

    def walk(batches):
        for (_, blk), table in _blocks(batches):
            upper, top = table["upper"][0].as_py(), table["top"][0].as_py()
            table = table.slice(1)
            if table.num_rows == 0:  # of a table without rows
                continue
            held = Traversal(table["digest"].to_pylist(), _height(blk, table.num_rows, block_height), subtree_height)
            proofs = pa.array([path + upper for path in held.paths()], pa.list_(pa.string()))
            full = table.select(["grp", "place", "digest", *kept]).append_column("top", pa.array([top] * table.num_rows, pa.string())).append_column("proof", proofs)
            yield from full.combine_chunks().to_batches(max_chunksize=256)

    dealt = _in_blocks(rows, FAN**block_height, _tasks(rows, n), heads)
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in ("grp", "place", "digest", *kept))
    return dealt.mapInArrow(walk, f"{schema}, top string, proof array<string>")


def _proved(stages: list[DataFrame], heads: DataFrame, n: int, block_height: int, subtree_height: int, scratch: Scratch, name: str) -> DataFrame:
    """The first stage's rows with their whole proofs; heads (grp, upper, top) stand above the last stage."""
    heads = heads.withColumn("blk", F.lit(0).cast("long"))
    for k in range(len(stages) - 2, 0, -1):
        found = _walked(stages[k], heads, n, block_height, subtree_height)
        heads = scratch.keep(found.select("grp", F.col("place").alias("blk"), F.col("proof").alias("upper"), "top"), f"{name}-paths-{k}")
    return _walked(stages[0], heads, n, block_height, subtree_height)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", carried: tuple[str, ...] = (), block_height: int = BLOCK_HEIGHT, subtree_height: int = SUBTREE_HEIGHT) -> DataFrame:
    """(key, group, place, leaf, subroot, root, proof, carried ...) of each row of docs.

    carried names small columns of docs that go along.  place counts from 0
    within the group.
    """
    scratch = Scratch(docs.sparkSession)
    leaves = docs.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("key"), leaf([F.col(c) for c in fields]).alias("digest"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)], F.rand().alias("salt"))
    # written, since equal rows are told apart by what was drawn
    rows, n = _placed(scratch.keep(leaves, "leaves"), ["key", "digest", "salt"], scratch, "numbered")
    stages = _stages(rows.drop("salt"), n, block_height, scratch, "stage")
    subroots = stages[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    over, groups = _placed(subroots, ["name"], scratch, "subroots")
    tops = _stages(over, groups, block_height, scratch, "over")
    root = (tops[-1].first() or {"digest": None})["digest"]
    above = docs.sparkSession.createDataFrame([("", [], None)], "grp string, upper array<string>, top string")
    heads = _proved(tops, above, groups, block_height, subtree_height, scratch, "over")
    heads = scratch.keep(heads.select(F.col("name").alias("grp"), F.col("proof").alias("upper"), F.col("digest").alias("top")), "heads")
    out = _proved(stages, heads, n, block_height, subtree_height, scratch, "stage")
    return out.select(F.col("key").alias(key), F.col("grp").alias(group), "place", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"), "proof", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)])
