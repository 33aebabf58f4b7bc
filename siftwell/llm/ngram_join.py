"""N-gram Jaccard join: exact near-duplicate components by signature trees.

Documents link when the Jaccard similarity of their word-shingle sets reaches
the threshold.  The plan, with no step whose task or driver state grows with a
group of copies:

1. Equal sets collapse to one node (a 64-bit hash of the sorted set; where a
   second hash shows that sets of one node differ, it becomes several).
2. Each shingle's document frequency is counted over the whole corpus (blocks
   ask, buckets of keys answer).  Sorted by it, rarest first, two sets of
   similarity t share a shingle among the first n - ceil(t n) + 1 of each.
   Nodes whose prefix holds no shared shingle are done.
3. Nodes that share a prefix shingle fall into one group (components of the
   node-shingle graph, contracted before each shuffle).
4. In blocks of a group, a signature tree holds OR-combined shingle bitmaps and
   size ranges; a dual traversal of the tree with itself prunes node pairs by
   their maximum possible overlap, and surviving leaf pairs are intersected
   exactly.  Pairs already connected are skipped, so a group of copies costs
   about one intersection a member.
5. A group of several blocks shares a few pivots with all its blocks; members
   outside its largest component then meet those blocks in which a set has a
   prefix shingle of theirs, since every link has one.

Defined results: null or wordless text has no shingles and links with nothing; a
similarity of exactly the threshold links; a text of any length is read whole,
in memory proportional to it; a repeated row repeats its result; rows with a
null doc_id get a null component unless linked; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import bytewords as bw
from siftwell.llm.shared import BROADCAST_IDS, KEY_BITS, Forest, Scratch, answer, ask, connected_components, pack_blocks, salted_join, sizes, told

BLOCK_NODES = 2048
BLOCK_SETS = 12 << 20
PIVOTS = 24
LEAF = 16
FAN = 8
_SHIFT = np.uint64(64 - KEY_BITS)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# --- signature tree --------------------------------------------------------------------------------------------------


class SignatureTree:
    """Leaves of LEAF similar sets; each node has an OR bitmap, a size range and its least bitmap slack.

    A set of n shingles with c bits set has slack c - n: removing one shingle
    clears one bit at most, so two sets with overlap o share c - n + o bits or
    more.  Two tree nodes can hold a linked pair only if their common bits reach
    the slack plus the least overlap that their size ranges allow.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        bits = 1 << int(min(13, max(8, np.ceil(np.log2(2 * max(1, int(np.median(self.sizes))))))))
        maps = np.zeros((len(sets), bits), bool)
        for row, s in zip(maps, sets, strict=True):
            row[(s >> np.uint64(20)) & np.uint64(bits - 1)] = True
        self.maps = np.packbits(maps, axis=1).view(np.uint64)
        del maps
        self.slack = np.bitwise_count(self.maps).sum(axis=1).astype(np.int64) - self.sizes
        self.order = np.lexsort((self.sizes, np.array([s[0] if len(s) else 0 for s in sets], np.uint64)))
        members = [self.order[i : i + LEAF] for i in range(0, len(sets), LEAF)]
        level = [(m, None) for m in members]
        self.levels = []
        nodes = [self._node(np.bitwise_or.reduce(self.maps[m], axis=0), int(self.sizes[m].min()), int(self.sizes[m].max()), int(self.slack[m].min()), m, ()) for m, _ in level]
        while len(nodes) > 1:
            nodes = [self._over(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        self.root = nodes[0] if nodes else None

    @staticmethod
    def _node(bitmap, low, high, slack, members, children):
        return {"map": bitmap, "low": low, "high": high, "slack": slack, "members": members, "children": children}

    def _over(self, nodes):
        return self._node(np.bitwise_or.reduce([n["map"] for n in nodes], axis=0), min(n["low"] for n in nodes), max(n["high"] for n in nodes), min(n["slack"] for n in nodes), None, nodes)

    def pairs(self, percent: int):
        """Dual traversal: pairs of leaf member arrays that may hold a linked pair."""
        stack = [(self.root, self.root)] if self.root else []
        while stack:
            x, y = stack.pop()
            if 100 * min(x["high"], y["high"]) < percent * max(x["low"], y["low"]):
                continue
            need = -(-percent * max(x["low"], y["low"]) // 100)
            if int(np.bitwise_count(x["map"] & y["map"]).sum()) < max(x["slack"], y["slack"]) + need:
                continue
            if x["children"] and x is y:
                kids = x["children"]
                stack.extend((kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids)))
            elif x["children"]:
                stack.extend((k, y) for k in x["children"])
            elif y["children"]:
                stack.extend((x, k) for k in y["children"])
            else:
                yield x["members"], y["members"], x is y


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def link_block(ids: list[int], sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of a block; label marks what is already known to be connected."""
    tree = SignatureTree(sets)
    lab = np.arange(len(ids)) if label is None else label.copy()
    out = []
    for xs, ys, same in tree.pairs(percent):
        apart = lab[xs][:, None] != lab[ys][None, :]
        if not apart.any():
            continue
        mx, my, sx, sy = tree.maps[xs], tree.maps[ys], tree.sizes[xs], tree.sizes[ys]
        common = np.bitwise_count(mx[:, None, :] & my[None, :, :]).sum(axis=2).astype(np.int64)
        # of the shingles of one set, those whose bit the other lacks are not shared
        most = np.minimum(common - tree.slack[xs][:, None], common - tree.slack[ys][None, :])
        total = sx[:, None] + sy[None, :]
        may = apart & (100 * most >= percent * (total - most)) & (100 * np.minimum(sx[:, None], sy[None, :]) >= percent * np.maximum(sx[:, None], sy[None, :]))
        if same:
            may &= np.triu(np.ones_like(may), 1)
        for i, j in zip(*np.nonzero(may), strict=True):
            a, b = int(xs[i]), int(ys[j])
            if lab[a] != lab[b] and linked(sets[a], sets[b], percent):
                lab[lab == lab[b]] = lab[a]
                out.append((ids[a], ids[b]))
    return out


# --- the distributed steps -------------------------------------------------------------------------------------------


def shingle_nodes(table: pa.Table, k: int):
    """The shingle sets of a block's rows, their nodes, and the first row of each node."""
    data, off = bw.text_buffer(table["text"])
    sets = [s for i, j in bw.row_slices(off) for s in bw.shingle_sets(data, off[i : j + 1], k)]
    nodes = [_signed(xxhash.xxh3_128_intdigest(s.tobytes())) if len(s) else (None, None) for s in sets]
    first = {}
    for row, node in enumerate(nodes):
        first.setdefault(node, row)
    first.pop((None, None), None)
    return sets, nodes, first


def _signed(digest: int) -> tuple[int, int]:
    """128 bits as two signed longs: a node, and what tells nodes of one number apart."""
    return tuple((x ^ 1 << 63) - (1 << 63) for x in (digest & (1 << 64) - 1, digest >> 64))


def _block_keys(sets, first) -> tuple[np.ndarray, np.ndarray]:
    held = [sets[row] >> _SHIFT for row in first.values()]
    return np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


#: prefix holds keys of which every linked pair shares one; shingles what links are found by.  Both are null where no other node has such a key
DESCRIBED = "doc_id long, n_shingles long, node long, twin long, prefix array<long>, shingles binary"


def described(table: pa.Table, sets, nodes, prefixes, kept) -> pa.Table:
    return pa.table({
        "doc_id": table["doc_id"], "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array([n for n, _ in nodes], pa.int64()), "twin": pa.array([t for _, t in nodes], pa.int64()),
        "prefix": pa.array(prefixes, pa.list_(pa.int64())), "shingles": pa.array(kept, pa.large_binary()).cast(pa.binary()),
    })


def _describe(blocks: DataFrame, answers: DataFrame, k: int, percent: int, partitions: int) -> DataFrame:
    def work(table: pa.Table, totals: dict) -> pa.Table:
        sets, nodes, first = shingle_nodes(table, k)
        keys, _ = _block_keys(sets, first)
        found = totals.get(0, np.zeros(0, np.uint64))
        prefixes, kept = [None] * len(sets), [None] * len(sets)
        for row in first.values():
            s = sets[row]
            df = found[np.searchsorted(keys, s >> _SHIFT)]
            p = prefix_length(len(s), percent)
            if int((df < 2).sum()) < p:
                prefix = s[np.argsort(df, kind="stable")[:p]]
                prefixes[row] = np.sort(df)[:p] >= 2
                prefixes[row] = prefix[prefixes[row]].view(np.int64)
                kept[row] = s.tobytes()
        return described(table, sets, nodes, prefixes, kept)

    return told(blocks, answers, work, DESCRIBED, partitions)


def _told_apart(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows whose nodes are of one set each: numbers that two sets share, a handful in 10**10, are drawn anew from both hashes."""
    shared = rows.where("node is not null").groupBy("node").agg(F.min("twin").alias("a"), F.max("twin").alias("b")).where("a <> b").select("node")
    shared = scratch.keep(shared, "shared")
    n = shared.count()
    if n == 0:
        return rows.drop("twin")
    told_of = shared.withColumn("several", F.lit(True))
    marked = rows.join(F.broadcast(told_of), "node", "left") if n <= BROADCAST_IDS else salted_join(rows, told_of, ["node"], "doc_id", "left")
    return marked.withColumn("node", F.when(F.col("several"), F.xxhash64("node", "twin")).otherwise(F.col("node"))).select([c for c in rows.columns if c != "twin"])


def _node_edges(rows: DataFrame, scratch: Scratch, partitions: int) -> DataFrame:
    """Edges that connect all nodes with a common prefix shingle: linear in the prefixes, whatever they share."""

    def local(batches):
        seen, forest = {}, Forest()
        for batch in batches:
            for node, prefix in zip(batch["node"].to_pylist(), batch["prefix"].to_pylist(), strict=True):
                for key in prefix:
                    if (other := seen.setdefault(key, node)) != node:
                        forest.join(other, node)
            if len(seen) > 1 << 18:
                yield from flush(seen, forest)
                seen, forest = {}, Forest()
        yield from flush(seen, forest)

    def flush(seen, forest):
        u, v = forest.edges()
        schema = pa.schema([("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
        yield pa.RecordBatch.from_pydict({"key": [*seen, *[None] * len(u)], "u": [*seen.values(), *u], "v": [*[None] * len(seen), *v]}, schema)

    def meet(batches):
        seen, forest = {}, Forest()
        for batch in batches:
            for key, node in zip(batch["key"].to_pylist(), batch["u"].to_pylist(), strict=True):
                if (other := seen.setdefault(key, node)) != node:
                    forest.join(other, node)
        u, v = forest.edges()
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    links = scratch.keep(rows.where("shingles is not null").select("node", "prefix").mapInArrow(local, "key long, u long, v long"), "links")
    across = links.where("key is not null").select("key", "u").repartition(partitions, "key").mapInArrow(meet, "u long, v long")
    return links.where("key is null").select("u", "v").unionByName(across)


def _grouped(rows: DataFrame, partitions: int, work, schema: str) -> DataFrame:
    """work(ids, sets, labels) of each (grp, blk), one group in memory at a time."""

    def run(batches):
        at, held = None, []
        for part in (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256)):
            for row in zip(*(part[c].to_pylist() for c in ("grp", "blk", "node", "shingles", "label")), strict=True):
                if row[:2] != at:
                    if len(held) > 1:
                        yield from emit(held)
                    at, held = row[:2], []
                if not held or held[-1][0] != row[2]:
                    held.append(row[2:])
        if len(held) > 1:
            yield from emit(held)

    def emit(held):
        edges = work([r[0] for r in held], [np.frombuffer(r[1], np.uint64) for r in held], None if held[0][2] is None else np.array([r[2] for r in held], np.int64))
        if edges:
            yield pa.RecordBatch.from_pydict({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    return rows.repartition(partitions, "grp", "blk").sortWithinPartitions("grp", "blk", "node").select("grp", "blk", "node", "shingles", "label").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block_nodes: int = BLOCK_NODES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    blocks = scratch.keep(pack_blocks(docs), "blocks")
    buckets, tasks = sizes(blocks)

    def keys(table):
        sets, _, first = shingle_nodes(table, k)
        return [_block_keys(sets, first)]

    answers = answer(ask(blocks, keys, [KEY_BITS], buckets), tasks)
    rows = scratch.keep(_describe(blocks, answers, k, percent, tasks), "rows")
    scratch.drop("blocks")
    return components(rows, scratch, tasks, lambda ids, sets, labels: link_block(ids, sets, percent, labels), block_nodes, block_sets)


def components(rows: DataFrame, scratch: Scratch, tasks: int, link, block_nodes: int, block_bytes: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of rows as DESCRIBED.

    link(ids, what shingles holds, labels) returns the links that span a block.
    """
    rows = _told_apart(rows, scratch)
    groups = scratch.keep(connected_components(_node_edges(rows, scratch, tasks), scratch, "groups", contracted=True), "grouped").select(F.col("id").alias("node"), F.col("component").alias("grp"))
    scratch.drop("links")
    sized = rows.where("shingles is not null").groupBy("node").agg(F.max(F.length("shingles")).cast("long").alias("n"))
    plan = groups.join(sized, "node").groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("bytes"))
    plan = plan.select("grp", "members", F.greatest(F.ceil(F.col("members") / block_nodes), F.ceil(F.col("bytes") / block_bytes)).cast("int").alias("blks"))
    member = salted_join(groups, plan, ["grp"], "node").select("node", "grp", "blks", "members", F.pmod(F.xxhash64("node", F.lit(7)), F.col("members")).alias("draw"))
    pivot = (F.col("draw") < PIVOTS) & (F.col("blks") > 1)
    spots = F.when(pivot, F.sequence(F.lit(0), F.col("blks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blks")).cast("int")))
    held = rows.where("shingles is not null").select("node", "shingles").dropDuplicates(["node"])
    placed = held.join(member, "node").select("node", "shingles", "grp", "blks", F.explode(spots).alias("blk"), F.lit(None).cast("long").alias("label"))
    wide = member.where("blks > 1").select("node", "grp", "blks")
    several = wide.limit(1).count() > 0
    first = _grouped(placed, tasks, link, "u long, v long")
    first = scratch.keep(first, "first") if several else first
    # the links of a block span it and no more, as contracted edges do
    joined = scratch.keep(connected_components(first, scratch, "first", contracted=True), "joined").select(F.col("id").alias("node"), "component")
    if several:
        joined = scratch.keep(connected_components(first.unionByName(_residual(rows, wide, joined, scratch, link, tasks, block_nodes)), scratch, "second", contracted=True), "rejoined").select(F.col("id").alias("node"), "component")
    low = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    linked_low = joined.join(low, "node")
    component = linked_low.groupBy("component").agg(F.min("low").alias("component_id"))
    merged = salted_join(linked_low, component, ["component"], "node").select("node", "component_id")
    alone = low.where("copies > 1").join(joined, "node", "left_anti").select("node", F.col("low").alias("component_id"))
    of_node = merged.unionByName(alone)
    # a group of copies may hold a third of all rows; rows of other nodes stand for themselves
    out = salted_join(rows.select("doc_id", "n_shingles", "node"), of_node, ["node"], "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _residual(rows: DataFrame, wide: DataFrame, joined: DataFrame, scratch: Scratch, link, partitions: int, block_nodes: int) -> DataFrame:
    """Links between blocks of one group that its pivots did not show.

    The members of a group's largest component need no comparison among
    themselves.  Every other member meets the blocks in which some set has a
    prefix shingle of its own; where many come to one block, they come in
    chunks, to each of which the block's own members go.
    """
    home = F.pmod(F.xxhash64("node"), F.col("blks")).cast("int")
    of = scratch.keep(wide.join(joined, "node", "left").select("node", "grp", home.alias("blk"), F.coalesce("component", "node").alias("label")), "labels")
    counts = of.groupBy("grp", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    outside = scratch.keep(salted_join(of, main, ["grp"], "node").where("label <> main").select("node", "grp", "blk", "label"), "outside")
    # what of them is read below is theirs alone, and their keys are exploded after that
    sets = rows.where("shingles is not null")
    sets = sets.join(F.broadcast(of.select("node")), "node", "left_semi") if of.count() <= BROADCAST_IDS else sets
    sets = sets.select("node", "prefix", "shingles").dropDuplicates(["node"])
    spots = sets.select("node", "prefix").join(of.select("node", "grp", "blk"), "node").select("grp", F.explode("prefix").alias("key"), "blk").distinct()
    keys = sets.select("node", "prefix").join(outside.select("node", "grp"), "node").select("grp", F.explode("prefix").alias("key"), "node")
    meets = scratch.keep(keys.join(spots, ["grp", "key"]).select("grp", "blk", "node").distinct(), "meets")
    chunks = meets.groupBy("grp", "blk").agg(F.ceil(F.count("*") / block_nodes).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int")
    guests = salted_join(meets, chunks, ["grp", "blk"], "node").select("node", "grp", "blk", chunk.alias("c")).join(outside.select("node", "label"), "node")
    hosts = salted_join(of, chunks, ["grp", "blk"], "node").select("node", "grp", "blk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), "label")
    both = guests.select("node", "grp", "blk", "c", "label").unionByName(hosts.select("node", "grp", "blk", "c", "label")).distinct()
    placed = both.join(sets.select("node", "shingles"), "node").select("grp", (F.col("blk").cast("long") * (1 << 31) + F.col("c")).alias("blk"), "node", "shingles", "label")
    return scratch.keep(_grouped(placed, partitions, link, "u long, v long"), "residual")
