"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, ending with the assistant.  Dynamic programming over this
automaton finds the cheapest way to make a conversation legal by merging turns,
relabelling them or inserting empty ones, and the repaired turns are rendered.

The costs of a stretch of turns form a matrix from state to state, and
stretches combine by (min, +) products.  So a table is cut into ranges of its
order, each range is summed up on its own, the few summaries of a conversation
are combined, and each range then repairs its turns between known states.  No
conversation, however long, has to be in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import read, row_hash, write_and_read

#: Roles, which are also the states after a turn; state 3 is the start.
ROLES = ("system", "user", "assistant")
START = 3
KEEP, MERGE, RELABEL, INSERT = 0.0, 1.0, 2.5, 2.0
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"
_LEGAL = {(3, 0), (3, 1), (0, 1), (1, 2), (2, 1)}
_INF = float("inf")


def _moves() -> dict[int, list[tuple[int, int, int, float, bool, bool]]]:
    """For each role seen (3: unknown), the possible steps, cheapest first where costs tie.

    A step is (from, to, inserted role or -1, cost, merged, relabelled).
    """
    out: dict[int, list] = {}
    for role in range(4):
        steps = []
        for state in range(4):
            for to in range(3):
                change = role != to
                cost = RELABEL if change else KEEP
                if (state, to) in _LEGAL:
                    steps.append((state, to, -1, cost, False, change))
                if state == to:
                    steps.append((state, to, -1, cost + MERGE, True, change))
                for mid in (1, 2):
                    if (state, mid) in _LEGAL and (mid, to) in _LEGAL:
                        steps.append((state, to, mid, cost + INSERT, False, change))
        out[role] = sorted(steps, key=lambda s: (s[0], s[1], s[3], s[4], s[2]))
    return out


_MOVES = _moves()
#: The cheapest step for each role seen, from and to.
_BEST = {role: {(s[0], s[1]): s for s in reversed(steps)} for role, steps in _MOVES.items()}
_COST = np.full((4, 4, 4), _INF)
for _role, _steps in _BEST.items():
    for (_a, _b), _s in _steps.items():
        _COST[_role, _a, _b] = _s[3]
#: Cost of ending in a state: an answer is inserted after a user turn, a whole exchange after a system turn.
END = (2 * INSERT, INSERT, 0.0, _INF)


# Equal costs are told apart by the rows themselves: each step adds far less than any cost, in proportion to a number
# from its row's hash.  So the choice does not depend on where ranges are cut.
_TILT = np.sqrt(np.arange(2.0, 18.0)).reshape(4, 4) % 1 / (1 << 24)


def steps_cost(code: int, row: int) -> np.ndarray:
    return _COST[code] + _TILT * (((row & 0xFFFFF) + 1) / (1 << 20))


def role_code(role: object) -> int:
    name = role.strip().lower() if isinstance(role, str) else ""
    return ROLES.index(name) if name in ROLES else 3


def summary(codes: list[int], rows: list[int]) -> np.ndarray:
    """Cheapest cost from each state to each state over these turns."""
    total = np.full((4, 4), _INF)
    np.fill_diagonal(total, 0.0)
    for c, row in zip(codes, rows):
        total = (total[:, :, None] + steps_cost(c, row)[None]).min(axis=1)
    return total


def path(codes: list[int], rows: list[int], enter: int, leave: int) -> list[tuple[int, int, int, float, bool, bool]]:
    """The cheapest steps over these turns between two states."""
    cost, back = np.full(4, _INF), np.zeros((len(codes), 4), np.int8)
    cost[enter] = 0.0
    for i, (c, row) in enumerate(zip(codes, rows)):
        reach = cost[:, None] + steps_cost(c, row)
        back[i], cost = reach.argmin(axis=0), reach.min(axis=0)
    steps, state = [], leave
    for i in range(len(codes) - 1, -1, -1):
        before = int(back[i, state])
        steps.append(_BEST[codes[i]][before, state])
        state = before
    return steps[::-1]


def chain(parts: list[np.ndarray]) -> tuple[list[tuple[int, int]], float]:
    """The states before and after each stretch of a conversation on its cheapest path, and the cost."""
    fronts = [np.array([_INF, _INF, _INF, 0.0])]
    for m in parts:
        fronts.append((fronts[-1][:, None] + m).min(axis=0))
    last = fronts[-1] + np.array(END)
    state, ends = int(last.argmin()), []
    for m, front in zip(reversed(parts), reversed(fronts[:-1])):
        before = int((front + m[:, state]).argmin())
        ends.append((before, state))
        state = before
    return ends[::-1], float(last.min())


def _ops(group: pd.DataFrame) -> Iterator[dict]:
    """Repaired pieces of one stretch; ``seq`` leaves room for an insertion before and two after each turn."""
    steps = path([role_code(r) for r in group["role"]], group["hash"].tolist(), int(group["enter"].iloc[0]), int(group["leave"].iloc[0]))
    final = bool(group["final"].iloc[0])
    conv = group["conv_id"].iloc[0]
    conv = None if pd.isna(conv) else int(conv)
    at = None
    for row, (_, to, mid, _, merged, changed) in zip(group.itertuples(index=False), steps):
        at, turn = int(row.pos) * 4, None if pd.isna(row.turn) else int(row.turn)
        if mid >= 0:
            yield {"conv_id": conv, "seq": at, "turn": None, "role": ROLES[mid], "op": "insert", "starts": True, "text": ""}
        op = ("merge" if merged else "keep") if not changed else ("merge relabel" if merged else "relabel")
        yield {"conv_id": conv, "seq": at + 1, "turn": turn, "role": ROLES[to], "op": op, "starts": not merged,
               "text": row.text if isinstance(row.text, str) else ""}
    if final:
        state = steps[-1][1]
        for n, role in enumerate(("user", "assistant")[state:] if state < 2 else ()):
            yield {"conv_id": conv, "seq": at + 2 + n, "turn": None, "role": role, "op": "insert", "starts": True, "text": ""}


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations in rendered pieces.

    One row per original turn and per inserted one: conv_id, seq (order of the
    pieces in the conversation), turn (null if inserted), role, op (keep, merge,
    relabel, merge relabel, insert), out_turn (number of the repaired turn from
    0), rendered.  The pieces of a conversation put together by seq are its
    formatted text: a piece that starts a turn carries the opening tag and,
    except for the first turn, the closing tag of the turn before; the last
    piece closes its own.  Merged texts are joined by a line break.

    Turns are ordered by turn, missing ones first, and where equal by a hash of
    the row.  Roles count
    in any case; a missing or unknown one can only be relabelled.  A missing or
    empty text stays an empty turn.  Rows without conv_id form one conversation.
    Repeated rows are turns of their own.  Other columns are ignored.
    """
    spark = conversations.sparkSession
    slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    tied = base.withColumn("tie", F.monotonically_increasing_id())
    cut = write_and_read(tied.repartitionByRange(slices, "conv_id", "turn", row_hash(base), "tie")
                         .withColumn("slice", F.spark_partition_id()))

    def sum_up(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for conv, group in batch.groupby("conv_id", dropna=False, sort=False):
            group = group.sort_values(["turn", "hash", "tie"], na_position="first")
            out.append((None if pd.isna(conv) else int(conv), int(group["slice"].iloc[0]), len(group),
                        summary([role_code(r) for r in group["role"]], group["hash"].tolist()).ravel()))
        return pd.DataFrame({"conv_id": pd.array([o[0] for o in out], "Int64"), "slice": [o[1] for o in out],
                             "n": [o[2] for o in out], "m": [o[3] for o in out]})

    hashed = cut.withColumn("hash", row_hash(cut, ["conv_id", "turn", "role", "text"]))
    parts = hashed.select("conv_id", "turn", "role", "hash", "tie", "slice").groupBy("slice").applyInPandas(
        sum_up, "conv_id long, slice int, n long, m array<double>")

    def link(batch: pd.DataFrame) -> pd.DataFrame:
        # the stretches of one conversation: at most one a range
        batch = batch.sort_values("slice")
        ends, cost = chain([np.array(m).reshape(4, 4) for m in batch["m"]])
        before = batch["n"].cumsum() - batch["n"]
        return pd.DataFrame({"conv_id": batch["conv_id"], "slice": batch["slice"], "enter": [e for e, _ in ends],
                             "leave": [x for _, x in ends], "base": before,
                             "final": [False] * (len(batch) - 1) + [True], "cost": cost})

    def link_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.conv_id, r.parts) for r in b.itertuples(index=False)]
            out = [link(pd.DataFrame({"conv_id": pd.array([None if pd.isna(c) else int(c)] * len(p), "Int64"),
                                      "slice": [x["slice"] for x in p], "n": [x["n"] for x in p], "m": [x["m"] for x in p]}))
                   for c, p in rows]
            if out:
                yield pd.concat(out)

    linked = write_and_read(parts.groupBy("conv_id").agg(F.collect_list(F.struct("slice", "n", "m")).alias("parts")).mapInPandas(
        link_all, "conv_id long, slice int, enter int, leave int, base long, final boolean, cost double"))

    def fix(key, batch: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        known = {None if pd.isna(r.conv_id) else int(r.conv_id): r for r in ends.itertuples(index=False)}
        out: list[dict] = []
        for conv, group in batch.groupby("conv_id", dropna=False, sort=False):
            group = group.sort_values(["turn", "hash", "tie"], na_position="first")
            e = known[None if pd.isna(conv) else int(conv)]
            out += _ops(group.assign(enter=e.enter, leave=e.leave, final=e.final, pos=np.arange(len(group)) + e.base))
        frame = pd.DataFrame(out, columns=["conv_id", "seq", "turn", "role", "op", "starts", "text"])
        frame["slice"] = int(key[0])
        return frame.astype({"conv_id": "Int64", "turn": "Int64"})

    pieces = write_and_read(hashed.groupBy("slice").cogroup(linked.groupBy("slice")).applyInPandas(
        fix, "conv_id long, seq long, turn long, role string, op string, starts boolean, text string, slice int"))

    # turns are numbered by ranges too: openings in earlier ranges of the conversation, then within the range
    key = F.coalesce(F.col("conv_id"), F.lit(-(1 << 63)))
    opened = pieces.groupBy("conv_id", "slice").agg(F.sum(F.col("starts").cast("int")).alias("opened"), F.max("seq").alias("top"))
    by_conv = Window.partitionBy("conv_id")
    opened = opened.select(key.alias("k"), "slice", (F.max("top").over(by_conv)).alias("end"), F.coalesce(F.sum("opened").over(
        by_conv.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    here = Window.partitionBy("conv_id", "slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = pieces.withColumn("k", key).withColumn("nth", F.sum(F.col("starts").cast("int")).over(here)).join(opened, ["k", "slice"])
    number = F.col("before") + F.col("nth") - 1
    head = F.when(F.col("starts"), F.concat(F.when(number > 0, CLOSE).otherwise(""), F.lit("<|im_start|>"), "role", F.lit("\n")))
    tail = F.when(F.col("seq") == F.col("end"), CLOSE).otherwise("")
    return out.select("conv_id", "seq", "turn", "role", "op", number.cast("bigint").alias("out_turn"),
                      F.concat(head.otherwise("\n"), "text", tail).alias("rendered"))


def op1_role_repair(spark, sf: str) -> DataFrame:
    return repair(read(spark, sf, "conversations"))
