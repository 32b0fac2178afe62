"""Chat formatting: minimum-cost role repair and rendering.

A legal conversation is an optional system message and then user and assistant
messages in turn, ending with the assistant. Dynamic programming over that
automaton picks for every turn whether to keep, merge or relabel it and where
to insert empty messages. The step of a turn is a matrix of costs between
states, and such matrices combine associatively (min, plus); so blocks of turns
are reduced each in its own place, the few matrices of a conversation give the
states at block borders, and each block then finds its own best path. No task
needs a whole conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.ship import ship

ROLES = ("system", "user", "assistant")
#: States are what was said last: nothing, then the roles in order.
STATES = 4
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 2.0, 1.0, 1.0, 3.0
BLOCK_TURNS = 64
GROUP_BITS = 10

#: (state, role said) -> cost, roles inserted before, whether it joins the message before.
STEPS = {
    (0, 0): (0.0, (), False),
    (0, 1): (0.0, (), False),
    (0, 2): (INSERT, ("user",), False),
    (1, 0): (MERGE, (), True),
    (1, 1): (0.0, (), False),
    (1, 2): (INSERT, ("user",), False),
    (2, 1): (MERGE, (), True),
    (2, 2): (0.0, (), False),
    (3, 2): (MERGE, (), True),
    (3, 1): (0.0, (), False),
}
#: What ending in a state takes.
ENDS = [(2 * INSERT, ("user", "assistant")), (2 * INSERT, ("user", "assistant")), (INSERT, ("assistant",)), (0.0, ())]

OUT = (
    "conv_id {conv}, turn {turn}, role string, out_role string, action string, inserted array<string>, "
    "inserted_after array<string>, cost double, rendered string"
)


def _relabel(role: str | None, said: int) -> float:
    if role == ROLES[said]:
        return 0.0
    return RELABEL if role in ROLES else RELABEL_UNKNOWN


def _step_matrix(role: str | None) -> np.ndarray:
    out = np.full((STATES, STATES), np.inf)
    for (state, said), (cost, _, _) in STEPS.items():
        out[state, said + 1] = cost + _relabel(role, said)
    return out


MATRICES = {r: _step_matrix(r) for r in (*ROLES, None)}


def _matrix(role) -> np.ndarray:
    return MATRICES[role if role in ROLES else None]


def _combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def best_path(matrices: list[np.ndarray], start: int, end: int) -> list[int]:
    """States after each matrix on a cheapest way from start to end; of equals, the least state."""
    costs = [np.where(np.arange(STATES) == start, 0.0, np.inf)]
    for m in matrices:
        costs.append((costs[-1][:, None] + m).min(axis=0))
    path = [end]
    for m, before in zip(reversed(matrices), reversed(costs[:-1])):
        path.append(int(np.argmin(before + m[:, path[-1]])))
    return path[::-1][1:]


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys, whole."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if batch.empty:
            continue
        values = list(zip(*(batch[k] for k in keys)))
        cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and values[lo] != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.iloc[lo:hi])
            last = values[lo]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _reduce_turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for run in _runs(batches, ["unit", "block"]):
        total = None
        for role in run["role"]:
            m = _matrix(role)
            total = m if total is None else _combine(total, m)
        rows.append((run["unit"].iloc[0], run["block"].iloc[0], total.ravel().tolist()))
        if len(rows) >= 5000:
            yield pd.DataFrame(rows, columns=["unit", "block", "costs"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["unit", "block", "costs"])


def _reduce_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for run in _runs(batches, ["unit", "up"]):
        total = None
        for costs in run["costs"]:
            m = np.reshape(costs, (STATES, STATES))
            total = m if total is None else _combine(total, m)
        rows.append((run["unit"].iloc[0], run["up"].iloc[0], total.ravel().tolist()))
        if len(rows) >= 5000:
            yield pd.DataFrame(rows, columns=["unit", "block", "costs"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["unit", "block", "costs"])


def _place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entry and exit state of every block of a run whose own are known."""
    rows = []
    for run in _runs(batches, ["unit", "up"]):
        matrices = [np.reshape(c, (STATES, STATES)) for c in run["costs"]]
        start, end, last = int(run["start"].iloc[0]), int(run["finish"].iloc[0]), bool(run["last"].iloc[0])
        if end < 0:
            total = matrices[0]
            for m in matrices[1:]:
                total = _combine(total, m)
            end = int(np.argmin(total[start] + [c for c, _ in ENDS]))
        path = [start, *best_path(matrices, start, end)]
        for i, block in enumerate(run["block"]):
            rows.append((run["unit"].iloc[0], block, path[i], path[i + 1], last and i == len(matrices) - 1))
        if len(rows) >= 5000:
            yield pd.DataFrame(rows, columns=["unit", "block", "start", "finish", "last"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["unit", "block", "start", "finish", "last"])


def _render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    opened, closed = "<|{}|>\n", "<|end|>\n"
    empty = lambda roles: "".join(opened.format(r) + closed for r in roles)
    for run in _runs(batches, ["unit", "block"]):
        start, end, last = int(run["start"].iloc[0]), int(run["finish"].iloc[0]), bool(run["last"].iloc[0])
        path = best_path([_matrix(r) for r in run["role"]], start, end)
        out, state = [], start
        for i, (role, text) in enumerate(zip(run["role"], run["text"])):
            said = path[i] - 1
            cost, inserted, merged = STEPS[state, said]
            relabel = _relabel(role, said)
            body = (text or "").replace("<|", "< |")
            if merged:
                rendered = "\n" + body
            else:
                before = "" if state == 0 else "\n" + closed
                rendered = before + empty(inserted) + opened.format(ROLES[said]) + body
            after: tuple = ()
            if last and i == len(path) - 1:
                more, after = ENDS[path[i]]
                cost += more
                rendered += "\n" + closed + empty(after)
            action = "+".join(x for x in ("merge" * merged, "relabel" * (relabel > 0)) if x) or "keep"
            out.append((ROLES[said], action, list(inserted), list(after), cost + relabel, rendered))
            state = path[i]
        done = pd.DataFrame(out, columns=["out_role", "action", "inserted", "inserted_after", "cost", "rendered"])
        ids = run[["conv_id", "turn", "role"]].reset_index(drop=True)
        yield pd.concat([ids, done], axis=1)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per turn of the repaired and rendered conversations.

    Columns: conv_id, turn, role, out_role, action (keep, merge, relabel or
    merge+relabel), inserted (empty messages put before it), inserted_after
    (those that end the conversation), cost and rendered; a conversation's
    rendered parts, in order of turn, make its text. Roles other than system,
    user and assistant, null too, take any role at a small cost. Null text is
    empty. Rows alike in all four columns are one turn; turns with one number
    follow each other by a hash of role and text, null turns come last. A row
    with a null conv_id is a conversation of its own. Markers inside a text are
    broken with a blank, so text can't open a message.
    """
    ship(conversations.sparkSession)
    kinds = dict(conversations.dtypes)
    rows = conversations.select("conv_id", "turn", "role", "text").distinct()
    digest = F.xxhash64("role", "text")
    rows = rows.select(
        "*",
        F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("?"), F.sha1(F.to_json(F.struct("turn", "role", "text"))))).alias("unit"),
        digest.alias("tie"),
        F.coalesce(
            F.floor(F.col("turn") / BLOCK_TURNS).cast("long"),
            F.lit(1 << 40) + F.call_function("shiftrightunsigned", digest, F.lit(52)),
        ).alias("block"),
    )

    def in_order(df: DataFrame, key: str, *order) -> DataFrame:
        return df.repartition("unit", key).sortWithinPartitions("unit", key, *order)

    order = (F.col("turn").asc_nulls_last(), "tie")
    blocks = in_order(rows.select("unit", "block", "turn", "tie", "role"), "block", *order).mapInPandas(
        _reduce_turns, "unit string, block long, costs array<double>"
    )
    up = F.call_function("shiftright", "block", F.lit(GROUP_BITS))
    lower = blocks.withColumn("up", up)
    groups = in_order(lower, "up", "block").mapInPandas(_reduce_blocks, "unit string, block long, costs array<double>")
    placed = "unit string, block long, start int, finish int, last boolean"
    whole = groups.select(
        "*", F.lit(0).alias("up"), F.lit(0).alias("start"), F.lit(-1).alias("finish"), F.lit(True).alias("last")
    )
    borders = in_order(whole, "up", "block").mapInPandas(_place, placed).withColumnRenamed("block", "up")
    inner = in_order(lower.join(borders, ["unit", "up"]), "up", "block").mapInPandas(_place, placed)
    ready = in_order(rows.join(inner, ["unit", "block"]), "block", *order)
    return ready.mapInPandas(_render, OUT.format(conv=kinds["conv_id"], turn=kinds["turn"]))


def op9_role_repair(conversations: DataFrame) -> DataFrame:
    """All conversations, repaired and rendered."""
    return repair(conversations)
