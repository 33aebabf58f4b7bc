import itertools
import random

from siftwell.llm import chat_format as cf


def brute(seen):
    best = float("inf")
    for path in itertools.product((1, 2, 3), repeat=len(seen)):
        state, cost = cf.START, 0.0
        for s, role in zip(seen, path, strict=True):
            cost, state = cost + cf.COST[s, state, role], role
        best = min(best, cost + cf.END_COST[state])
    return best


def test_cost_is_the_least():
    rng = random.Random(3)
    for _ in range(200):
        seen = [rng.randrange(4) for _ in range(rng.randrange(1, 7))]
        path = cf.repair(seen)
        assert abs(sum(c for _, _, c in path) + cf.END_COST[path[-1][0]] - brute(seen)) < 1e-9


def test_chunks_do_not_change_the_cost(spark, sf001):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "User ", "bot", None]), f"t{t}") for c in range(30) for t in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    total = lambda r: {x.conv_id: round(sum(y.cost for y in r if y.conv_id == x.conv_id), 6) for x in r}
    assert total(cf.repaired(df).collect()) == total(cf.repaired(df, chunk=3).collect())


def test_legal_conversations_stay(sf001):
    rows = cf.repaired(sf001("conversations")).collect()
    assert len(rows) == sf001("conversations").count() and {r.action for r in rows} == {"keep"}


def test_rendered(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "system", "s"), (2, 1, "user", "q"), (3, 0, "assistant", "x"), (3, 1, "user", "y"), (3, 2, "assistant", "z")]
    out = {r.conv_id: (r.cost, r.text) for r in cf.conversations_text(cf.repaired(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    assert out[1] == (1.0, "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n")
    assert out[2] == (cf.INSERT_COST, "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
    assert out[3] == (cf.INSERT_COST, "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n<|im_start|>user\ny<|im_end|>\n<|im_start|>assistant\nz<|im_end|>\n")


def test_turns_without_an_order_of_their_own_are_dealt_out(spark):
    rng = random.Random(6)
    rows = [(7, rng.choice([None, 3]), rng.choice(["user", "assistant", "system", None]), f"t{rng.randrange(40)}") for _ in range(300)] + [(7, 3, "user", "same")] * 200 + [(8, 1, "user", "a"), (None, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    whole, cut = ([tuple(r) for r in cf.repaired(df, chunk=c).orderBy("conv_id", "position").collect()] for c in (10**6, 7))
    assert [r[:4] for r in whole] == [r[:4] for r in cut] and len(whole) == len(rows)
    assert sum(r[6] for r in whole) == sum(r[6] for r in cut)
    seven = [r for r in whole if r[0] == 7]
    assert [r[1] for r in seven] == list(range(500)) and [r[2] is None for r in seven] == sorted((r[2] is None for r in seven), reverse=True)
    codes = [{"system": 1, "user": 2, "assistant": 3}.get(r[3], 0) for r in seven]
    path = cf.repair(codes)
    assert abs(sum(r[6] for r in seven) - sum(c for _, _, c in path) - cf.END_COST[path[-1][0]]) < 1e-9


def test_odd_rows(spark):
    rows = [(None, None, None, None, 1), (None, 1, "user", "", 2), (1, 5, "user", "x" * 100_000, 3), (1, 5, "user", "x" * 100_000, 3), (2, None, "?", "a", 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, chunk int")
    out = cf.repaired(df).collect()
    assert len(out) == 5 and sorted(r.position for r in out if r.conv_id == 1) == [0, 1]
    assert cf.repaired(df.limit(0)).collect() == []
