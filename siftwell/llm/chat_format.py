"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn and then user and assistant
turns in alternation, ending with the assistant.  Dynamic programming over this
automaton chooses, for each turn, the cheapest of keeping it, merging it into
the turn before (of the same role after the change), relabelling it, and putting
an empty turn before it; ties go to the action named first in ACTIONS.  The
repaired sequence is rendered turn by turn: the pieces of a conversation, in
order, join to its text.

Steps of the program compose as (min, +) products of 4 x 4 matrices, so a
conversation of any length is cut into chunks of consecutive turns: turns are
dealt by ranges of their order, whatever their numbers are, and a chunk is one
row of at most CHUNK turns or CHUNK_BYTES of text (a longer turn is alone).
Each chunk gives its matrix, one short row per chunk is combined for each
conversation into the states at the chunks' borders, and the chunks are then
repaired apart from each other.  No task holds more than a chunk of texts.

Defined results: turns are taken in order of turn (null first), then role, then
the first PREFIX characters of the text, then a hash of the text; repeated rows
are turns of their own; a null or unknown role is relabelled at a lower cost;
null text is empty, and text of any length is rendered whole; ways of equal cost
go to the action named first, then to the state before that is named first; rows
of null conv_id make one conversation; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import Scratch, new_number, spread

CHUNK, CHUNK_BYTES, PREFIX = 1024, 1 << 20, 64
KEEP, MERGE, RELABEL, MERGE_RELABELLED, INSERT, INSERT_RELABELLED = range(6)
ACTIONS = ("keep", "merge", "relabel", "merge relabelled", "insert before", "insert before and relabel")
#: a turn that was or becomes a system turn is costly to relabel: instructions are not speech
MERGE_COST, RELABEL_COST, SYSTEM_COST, NAME_COST, INSERT_COST = 1.0, 2.0, 4.0, 0.5, 2.5
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
_STEPS = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: the empty turn that makes a step legal
_BRIDGE = {(START, ASSISTANT): USER, (SYSTEM, ASSISTANT): USER, (USER, USER): ASSISTANT, (ASSISTANT, ASSISTANT): USER}
#: cost of ending in each state, and the empty turns that it adds
END_COST = np.array([0.0, 2 * INSERT_COST, INSERT_COST, 0.0])
END_TURNS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """cost and action [role seen, state before, state after]; role 0 is null or unknown."""
    cost, action = np.full((4, 4, 4), np.inf), np.full((4, 4, 4), -1)
    for seen in range(4):
        for before in range(4):
            for role in (SYSTEM, USER, ASSISTANT):
                other = 0.0 if seen == role else NAME_COST if seen == 0 else SYSTEM_COST if SYSTEM in (seen, role) else RELABEL_COST
                ways = []
                if (before, role) in _STEPS:
                    ways.append((other, KEEP if seen == role else RELABEL))
                if before == role:
                    ways.append((MERGE_COST + other, MERGE if seen == role else MERGE_RELABELLED))
                if (before, role) in _BRIDGE:
                    ways.append((INSERT_COST + other, INSERT if seen == role else INSERT_RELABELLED))
                if ways:
                    cost[seen, before, role], action[seen, before, role] = min(ways)
    return cost, action


COST, ACTION = _tables()


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +): cheapest way through a and then b."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


UNIT = np.where(np.eye(4, dtype=bool), 0.0, np.inf)


def repair(seen: list[int], entry: int = START, leave: int | None = None) -> list[tuple[int, int, float]]:
    """(state, action, cost) of each turn on the cheapest path from entry to leave, or to the cheapest end."""
    best, back = np.full(4, np.inf), []
    best[entry] = 0.0
    for s in seen:
        ways = best[:, None] + COST[s]
        back.append(ways.argmin(axis=0))
        best = ways.min(axis=0)
    state = int((best + END_COST).argmin()) if leave is None else leave
    out = []
    for s, from_ in zip(reversed(seen), reversed(back), strict=True):
        before = int(from_[state])
        out.append((state, int(ACTION[s, before, state]), float(COST[s, before, state])))
        state = before
    return out[::-1]


def _runs(batches, keys: list[str], columns: list[str]):
    """(key, rows) of consecutive rows with equal keys."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in keys + columns), strict=True):
            if at is None or row[: len(keys)] != at:
                if held:
                    yield at, held
                at, held = row[: len(keys)], []
            held.append(row[len(keys) :])
    if held:
        yield at, held


_CHUNK = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("matrix", pa.list_(pa.float64())),
    ("turn", pa.list_(pa.int64())), ("role_seen", pa.list_(pa.string())), ("code", pa.list_(pa.int32())), ("text", pa.list_(pa.string())),
])


def repaired(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, position, turn, role_seen, role, action, cost, rendered) of each turn of conversations (conv_id, turn, role, text)."""
    spark = conversations.sparkSession
    scratch = Scratch(spark)
    role = F.lower(F.trim(F.col("role").cast("string")))
    code = F.coalesce(F.when(role == "system", SYSTEM).when(role == "user", USER).when(role == "assistant", ASSISTANT), F.lit(0)).cast("int")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = spread(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role_seen"), code.alias("code"), text.alias("text")))
    # what tells repeated rows apart is written, so that a range that is made again is the same
    turns = scratch.keep(turns.withColumn("begin", F.substring("text", 1, PREFIX)).withColumn("hash", F.xxhash64("text")).withColumn("own", F.monotonically_increasing_id()), "turns")
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "role_seen", "begin", "hash", "own"]

    def chunks(batches):
        """Chunks of a range of turns; part is the range's number, number the chunk's in it."""
        part = TaskContext.get().partitionId()
        held, size, number, conv, done, bulk = [], 0, 0, None, [], 0

        def close():
            nonlocal held, size, number, bulk
            m = UNIT
            for _, _, c, _ in held:
                m = product(m, COST[c])
            done.append((conv, part, number, new_number(), len(held), m.ravel().tolist(), *map(list, zip(*held, strict=True))))
            bulk += size
            held, size, number = [], 0, number + 1

        def ready():
            nonlocal done, bulk
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), _CHUNK, strict=True)], schema=_CHUNK)
            done, bulk = [], 0
            return out

        for batch in batches:
            for to, *row in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role_seen", "code", "text")), strict=True):
                if held and (to != conv or len(held) >= chunk or size + len(row[3]) > CHUNK_BYTES):
                    close()
                    if bulk > CHUNK_BYTES or len(done) >= 1024:
                        yield ready()
                conv = to
                held.append(row)
                size += len(row[3])
        if held:
            close()
        if done:
            yield ready()

    ranged = turns.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role_seen", "code", "text")
    made = scratch.keep(ranged.mapInArrow(chunks, "conv_id long, part int, number long, chunk long, n long, matrix array<double>, turn array<long>, role_seen array<string>, code array<int>, text array<string>"), "chunks")
    scratch.drop("turns")

    def borders(batches):
        schema = pa.schema([("chunk", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("before", pa.int64()), ("last", pa.bool_())])
        rows = []
        for (_,), held in _runs(batches, ["conv_id"], ["chunk", "n", "matrix"]):
            best, back = np.array([0.0, np.inf, np.inf, np.inf]), []
            for _, _, m in held:
                ways = best[:, None] + np.array(m).reshape(4, 4)
                back.append(ways.argmin(axis=0))
                best = ways.min(axis=0)
            states = [int((best + END_COST).argmin())]
            for b in reversed(back):
                states.append(int(b[states[-1]]))
            states, done = states[::-1], 0
            for k, (part, size, _) in enumerate(held):
                rows.append({"chunk": part, "entry": states[k], "leave": states[k + 1], "before": done, "last": k == len(held) - 1})
                done += size
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    thin = made.select("conv_id", "part", "number", "chunk", "n", "matrix")
    ends = thin.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "number").select("conv_id", "chunk", "n", "matrix").mapInArrow(borders, "chunk long, entry int, leave int, before long, last boolean")
    placed = made.select("conv_id", "chunk", "turn", "role_seen", "code", "text").join(ends, "chunk")

    def render(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("role_seen", pa.string()), ("role", pa.string()), ("action", pa.string()), ("cost", pa.float64()), ("rendered", pa.string())])
        rows, size = [], 0
        for batch in batches:
            for conv, turns, seen, codes, texts, entry, leave, before, last in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role_seen", "code", "text", "entry", "leave", "before", "last")), strict=True):
                state = entry
                for k, (text, (after, action, cost)) in enumerate(zip(texts, repair(codes, entry, leave), strict=True)):
                    if action in (MERGE, MERGE_RELABELLED):
                        piece = "\n" + text
                    else:
                        added = _BRIDGE[state, after] if action in (INSERT, INSERT_RELABELLED) else None
                        piece = ("" if state == START else CLOSE) + ("" if added is None else OPEN.format(ROLES[added]) + CLOSE) + OPEN.format(ROLES[after]) + text
                    if last and k == len(texts) - 1:
                        piece += CLOSE + "".join(OPEN.format(ROLES[x]) + CLOSE for x in END_TURNS[after])
                        cost += float(END_COST[after])
                    state = after
                    rows.append({"conv_id": conv, "position": before + k, "turn": turns[k], "role_seen": seen[k], "role": ROLES[after], "action": ACTIONS[action], "cost": cost, "rendered": piece})
                    size += len(piece)
                if size > CHUNK_BYTES or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    return placed.mapInArrow(render, "conv_id long, position long, turn long, role_seen string, role string, action string, cost double, rendered string")


def conversations_text(pieces: DataFrame) -> DataFrame:
    """(conv_id, cost, text): each conversation in one row, for conversations that fit one."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "rendered"))), lambda p: p["rendered"])
    return pieces.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(parts, "").alias("text"))
