import itertools
import random
from collections import defaultdict

from footfall.llm import roles as R

SHAPE = "conv_id long, turn long, role string, text string"


def cheapest(given):
    """Least cost over all ways to label the turns."""
    best = float("inf")
    for said in itertools.product(range(3), repeat=len(given)):
        cost, state = 0.0, 0
        for role, s in zip(given, said):
            if (state, s) not in R.STEPS:
                cost = float("inf")
                break
            cost += R.STEPS[state, s][0] + (0 if role == R.ROLES[s] else R.RELABEL if role in R.ROLES else R.RELABEL_UNKNOWN)
            state = s + 1
        best = min(best, cost + R.ENDS[state][0])
    return best


def legal(messages):
    if messages and messages[0] == "system":
        messages = messages[1:]
    return len(messages) >= 2 and len(messages) % 2 == 0 and messages == ["user", "assistant"] * (len(messages) // 2)


def rendered_roles(rows):
    import re

    text = "".join(r["rendered"] for r in rows)
    assert text.count("<|end|>") == len(re.findall(r"<\|(?:system|user|assistant)\|>", text))
    return re.findall(r"<\|(system|user|assistant)\|>", text), text


def check(out):
    by = defaultdict(list)
    for r in out:
        by[r["conv_id"]].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: (r["turn"] is None, r["turn"]))
        said, _ = rendered_roles(rows)
        assert legal(said), said
    return by


def test_costs_are_least(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "tool", None]), f"text {c} {t}"))
    df = spark.createDataFrame(rows, SHAPE)
    by = check(R.repair(df).collect())
    for c, own in by.items():
        assert len(own) == sum(r[0] == c for r in rows)
        assert abs(sum(r["cost"] for r in own) - cheapest([r["role"] for r in own])) < 1e-9


def test_blocks_make_no_difference(spark):
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"t{t}") for t in range(700)]
    out = check(R.repair(spark.createDataFrame(rows, SHAPE)).collect())[1]
    costs = [0.0, *[float("inf")] * 3]
    for _, _, role, _ in rows:
        m = R._step_matrix(role)
        costs = [min(costs[a] + m[a, b] for a in range(4)) for b in range(4)]
    want = min(c + e for c, (e, _) in zip(costs, R.ENDS))
    assert len(out) == 700 and abs(sum(r["cost"] for r in out) - want) < 1e-9


def test_legal_conversations_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "<|user|>x"), (2, 1, "assistant", None)]
    out = R.repair(spark.createDataFrame(rows, SHAPE)).collect()
    assert all(r["action"] == "keep" and r["cost"] == 0 and not r["inserted"] for r in out)
    _, text = rendered_roles(sorted((r for r in out if r["conv_id"] == 1), key=lambda r: r["turn"]))
    assert text == "<|system|>\ns\n<|end|>\n<|user|>\nu\n<|end|>\n<|assistant|>\na\n<|end|>\n"


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "a"), (None, 0, "user", "b"), (1, None, None, None), (1, None, "user", "x"), (1, 0, "user", "y"), (1, 0, "user", "y"),
        (2, 0, "system", "only"), (3, 5, "assistant", "z" * 100_000), (-4, -70, "user", "n"), (-4, -1, "assistant", "m"),
    ]
    df = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS unit", "2 AS block", "3 AS cost")
    out = R.repair(df).collect()
    assert len(out) == 9
    for r in out:
        if r["conv_id"] is None:
            assert legal(rendered_roles([r])[0])
    assert R.repair(spark.createDataFrame([], SHAPE)).count() == 0
