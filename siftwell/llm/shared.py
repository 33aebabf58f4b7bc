"""What the distributed operators share: the shared folder, text blocks, corpus-wide counts, components."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bytewords as bw
from siftwell.sources.folders import Folder, shared_folder

# For the whole process, since it is a worker of these operators: Arrow's pool and the C library give memory back.
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    # arrays from a megabyte up are mapped, so that they go back to the system when they are freed; set, this bound no longer grows
    _LIBC.mallopt(-3, 1 << 20)
    _LIBC.mallopt(-8, 2)
    pa.set_memory_pool(pa.system_memory_pool())
except OSError:
    _LIBC = None

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 10 << 20
TASK_BYTES = 24 << 20
KEY_BITS = 48


# --- tables in the folder that driver and executors share -----------------------------------------------------------


#: rows are whole texts: batches that Spark sizes for short rows would hold a hundred megabytes in each task
LEAN = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(8 << 20)), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512")}


def lean(spark: SparkSession) -> None:
    """Batches for long rows, where the session still has Spark's own sizes."""
    for key, (given, small) in LEAN.items():
        if spark.conf.get(key, None) == given:
            spark.conf.set(key, small)


_MADE: list[list[Scratch]] = []


@contextlib.contextmanager
def discarding():
    """Deletes, at its end, every Scratch made inside: for callers that have written their result by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for scratch in _MADE.pop():
            scratch.drop("")


class Scratch:
    """Tables written once and read again, so that a lost executor costs no recomputation of what is before them."""

    def __init__(self, spark: SparkSession):
        lean(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/siftwell-{uuid.uuid4().hex}"
        if _MADE:
            _MADE[-1].append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        folder = Folder(self.spark, self.root)
        for name in names:
            folder.remove(name)


def spread(df: DataFrame) -> DataFrame:
    """At least two tasks for each core: a file of one row group is scanned as one."""
    lean(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


BROADCAST_IDS = 2_000_000


def without_ids(docs: DataFrame, ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """docs without the rows of these doc_ids; the ids are written, counted, and broadcast only up to limit of them."""
    kept = Scratch(docs.sparkSession).keep(ids.where("doc_id is not null").distinct(), "ids")
    return docs.join(F.broadcast(kept) if kept.count() <= limit else kept.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """left joined with right, one row a key, where one key may hold a third of left's rows.

    Each row of right goes to salts places, and left's rows of a key are dealt
    to them by their column by.
    """
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    spots = right.withColumn("__salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return dealt.join(spots.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def trim() -> None:
    """Gives freed memory back: workers stay alive between tasks, and each executor has several."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


# --- packed arrays ---------------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Byte planes of 64-bit words, compressed: planes that are all zero cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(payload: bytes) -> np.ndarray:
    return np.cumsum(unpack(payload), dtype=np.uint64)


# --- blocks of documents ---------------------------------------------------------------------------------------------


def new_number() -> int:
    """A number that no other task draws, whatever partitions it computes."""
    return uuid.uuid4().int >> 65


_TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])


def pack_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, n_bytes, payload): documents in compressed blocks of about block_bytes of text.

    A block is the unit in which statistics of the corpus are asked for and
    answered.  The result must be written before use: block numbers are drawn.
    """

    def blocks(batches):
        held, size = [], 0

        def flush():
            nonlocal held, size
            table = pa.Table.from_batches(held, _TEXTS)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _TEXTS) as writer:
                writer.write_table(table)
            payload = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
            out = pa.RecordBatch.from_pydict({"block": [new_number()], "n_bytes": [size], "payload": [payload]}, pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary())]))
            held, size = [], 0
            return out

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["text"].cast(pa.large_string())], schema=_TEXTS)
            _, off = bw.text_buffer(batch["text"])
            for i, j in bw.row_slices(off, block_bytes // 4):
                held.append(batch.slice(i, j - i))
                size += int(off[j] - off[i])
                if size >= block_bytes:
                    yield flush()
        if held:
            yield flush()

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(blocks, "block long, n_bytes long, payload binary")


def open_block(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().stream_reader(payload).read()).read_all().combine_chunks()


def sizes(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES, task_bytes: int = TASK_BYTES) -> tuple[int, int]:
    """Buckets of statistics and tasks, in proportion to the text.

    A bucket and a block are what a task holds at a time; it handles several,
    one after the other, so that tables are not cut into many small files.
    """
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    return max(8, -(-total // bucket_bytes)), max(2 * cores, -(-total // task_bytes))


def _bucket_edges(n: int, bits: int) -> np.ndarray:
    return np.array([(i << bits) // n for i in range(1, n)], dtype=np.uint64)


def ask(blocks: DataFrame, extract, bits: list[int], buckets: int) -> DataFrame:
    """(kind, bucket, block, keys, counts): what each block has to say on each range of keys.

    extract(table) returns, for each kind, sorted distinct keys of so many bits
    and their counts in the block.  A key that any number of rows share is one
    entry a block, so a frequent key is no heavier than a rare one.
    """
    edges = [_bucket_edges(buckets, b) for b in bits]

    def requests(batches):
        for batch in batches:
            for block, payload in zip(batch["block"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                out = {k: [] for k in ("kind", "bucket", "block", "keys", "counts")}
                for kind, (keys, counts) in enumerate(extract(open_block(payload))):
                    cuts = np.concatenate([[0], np.searchsorted(keys, edges[kind]), [len(keys)]])
                    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                        a, b = cuts[bucket], cuts[bucket + 1]
                        for name, value in zip(out, (kind, bucket, block, pack_sorted(keys[a:b]), pack(counts[a:b])), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return blocks.mapInArrow(requests, "kind int, bucket int, block long, keys binary, counts binary")


def answer(requests: DataFrame, tasks: int) -> DataFrame:
    """(kind, bucket, block, totals, n_keys, n_tokens): for each request, the corpus-wide totals of its keys in its order.

    n_keys and n_tokens, the bucket's distinct keys with a count and the sum of
    counts, stand on one row of each bucket and are null on the others.
    """

    def total(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        counts = [unpack(x) for x in table["counts"].to_pylist()]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate(counts).astype(np.float64), minlength=len(distinct)).astype(np.uint64)
        cuts = np.cumsum([0, *map(len, keys)])
        answers = [pack(sums[inverse[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        n_keys, n_tokens, n = int((sums > 0).sum()), int(sums.sum()), len(keys)
        del keys, counts, distinct, inverse, sums
        rest = [None] * (n - 1)
        trim()
        return pa.table({"kind": table["kind"], "bucket": table["bucket"], "block": table["block"], "totals": pa.array(answers, pa.binary()), "n_keys": pa.array([n_keys, *rest], pa.int64()), "n_tokens": pa.array([n_tokens, *rest], pa.int64())})

    return requests.repartition(tasks, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(total, "kind int, bucket int, block long, totals binary, n_keys long, n_tokens long")


def told(blocks: DataFrame, answers: DataFrame, work, schema: str, tasks: int) -> DataFrame:
    """work(table of texts, [totals of each kind]) for every block, beside the answers to what it asked."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: dict[int, list] = {}
        for kind, bucket, totals in zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["totals"].to_pylist(), strict=True):
            parts.setdefault(kind, []).append((bucket, totals))
        got = {kind: np.concatenate([unpack(t) for _, t in sorted(x)]) for kind, x in parts.items()}
        out = work(open_block(left["payload"][0].as_py()), got)
        del got
        trim()
        return out

    left = blocks.select("block", "payload").repartition(tasks, "block").groupBy("block")
    right = answers.select("block", "kind", "bucket", "totals").repartition(tasks, "block").groupBy("block")
    return left.cogroup(right).applyInArrow(each, schema)


# --- connected components --------------------------------------------------------------------------------------------


class Forest:
    """Union-find over any hashable ids; the root is the smallest of its set."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x], x = root, y
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True

    def edges(self) -> tuple[list, list]:
        nodes = [x for x in self.up if self.find(x) != x]
        return nodes, [self.find(x) for x in nodes]


_FOREST_NODES = 1 << 18


def contract(edges: DataFrame, kind: str = "long") -> DataFrame:
    """Each task's edges (u, v) as stars of their own components; flushed when its forest is large.  kind: of the ids, long or string."""
    ids = pa.int64() if kind == "long" else pa.string()

    def stars(batches):
        forest = Forest()

        def out():
            u, v = forest.edges()
            return pa.RecordBatch.from_pydict({"u": pa.array(u, ids), "v": pa.array(v, ids)})

        for batch in batches:
            for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
                if u is not None and v is not None:
                    forest.join(u, v)
            if len(forest.up) > _FOREST_NODES:
                yield out()
                forest = Forest()
        yield out()

    return edges.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v")).mapInArrow(stars, f"u {kind}, v {kind}")


HUB_ROWS, MOST_HUBS = 1 << 16, 1000


def _with_least(rows: DataFrame, least: DataFrame, n: int, scratch: Scratch, name: str) -> DataFrame:
    """rows (u, v), n at most, with the m of least (u, m, degree).

    The hub of a component has all its members: nodes of more than HUB_ROWS rows
    and more than a thousandth of all are MOST_HUBS at most, and are broadcast.
    """
    if n <= HUB_ROWS:
        return rows.join(least.select("u", "m"), "u")
    least, bound = scratch.keep(least, name), max(HUB_ROWS, -(-n // MOST_HUBS))
    hubs = least.where(F.col("degree") > bound).select("u", "m")
    if hubs.limit(1).count() == 0:
        return rows.join(least.select("u", "m"), "u")
    others = rows.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(F.col("degree") <= bound).select("u", "m"), "u")
    return rows.join(F.broadcast(hubs), "u").select("u", "v", "m").unionByName(others.select("u", "v", "m"))


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components", rounds: int = 60, contracted: bool = False, kind: str = "long") -> DataFrame:
    """(id, component) of every node with an edge (u, v); component is its smallest reachable id.

    Large-star and small-star steps until nothing moves (logarithmically many
    in the number of nodes).  Each task first contracts what it holds (unless the
    edges are contracted already), so a hub sends one edge a task and not one
    for each neighbour.  The least neighbour
    is found by a pre-aggregated minimum, and told to a hub's rows where they
    are; nothing is collected.
    """
    now = scratch.keep((edges if contracted else contract(edges, kind)).where("u <> v").distinct(), f"{name}-0")
    state, n = None, 2 * now.count()
    for step in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree"))
        large = _with_least(both, least, n, scratch, f"{name}-large-{step}").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = _with_least(down, low, n, scratch, f"{name}-small-{step}").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = scratch.keep(small.where("u <> v").distinct(), f"{name}-{step}")
        found = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}-{step - 1}", f"{name}-large-{step}", f"{name}-small-{step}")
        now, n = after, 2 * found[0]
        if found == state:
            break
        state = found
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
