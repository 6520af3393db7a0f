import itertools
import random

import numpy as np

from citegraph.llm import chat


def conversations(spark, n=60):
    rng = random.Random(6)
    word = lambda: rng.choice(["How", "what", "data", "river", "then", "count", "makes"])
    rows = []
    for c in range(n):
        turns = ["system"] * (c % 4 == 0) + ["user", "assistant"] * rng.randint(1, 3)
        for t, role in enumerate(turns):
            text = " ".join(word() for _ in range(rng.randint(3, 9))) + ("?" if role == "user" else ".")
            if role == "assistant":
                text += "\nsecond line of it.\n\nthe end."
            rows.append((c, t, role, text))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_roles_are_recovered(spark):
    given = conversations(spark)
    want, got = {}, {}
    for frame, out in ((given, want), (chat.parse_conversations(given), got)):
        for r in frame.orderBy("conv_id", "turn").collect():
            out.setdefault(r["conv_id"], []).append(r["role"])
    assert got.keys() == want.keys()
    assert np.mean([got[c] == want[c] for c in want]) > 0.7
    row = chat.parse_conversations(given).first()
    assert row["rendered"] == f"<|{row['role']}|>\n{row['text']}\n<|end|>"


def test_blocks_give_the_best_path_of_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(8)
    codes = int(np.prod(list(chat.SIZES.values())))
    chain = chat.Chain(*(rng.normal(size=s) for s in ((chat.STATES,), (chat.STATES, chat.STATES), (chat.STATES, codes))))
    rows = [("a", k, int(rng.integers(codes))) for k in range(103)] + [("b", k, int(rng.integers(codes))) for k in range(5)]
    frame = spark.createDataFrame(rows, "conv string, at long, code int")
    whole = {c: chain.viterbi(np.array([r[2] for r in rows if r[0] == c]), -1, -1).tolist() for c in "ab"}
    for size in (7, 512):
        monkeypatch.setattr(chat, "BLOCK", size)
        out = {}
        for r in chat.decode(frame, chain).orderBy("conv", "at").collect():
            out.setdefault(r["conv"], []).append(r["state"])
        assert out == whole
    short = [r[2] for r in rows if r[0] == "b"]
    value = lambda p: chain.start[p[0]] + sum(chain.step[a, b] for a, b in zip(p, p[1:])) + sum(chain.emit[s, c] for s, c in zip(p, short))
    assert tuple(whole["b"]) == max(itertools.product(range(chat.STATES), repeat=5), key=value)


def test_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string, conv string, state int"
    rows = [(1, 0, "user", None, "x", 1), (1, 1, "assistant", "", "x", 1), (None, 0, "user", "who?", "x", 1), (None, None, None, "what", "x", 1), (2, 0, "user", "hi", "x", 1), (2, 0, "user", "hi", "x", 1), (3, 0, "user", "long\n" * 3000, "x", 1)]
    got = chat.parse_conversations(spark.createDataFrame(rows, schema)).collect()
    assert {r["conv_id"] for r in got} == {1, 2, 3, None}
    assert chat.parse_conversations(spark.createDataFrame([], schema)).collect() == []
