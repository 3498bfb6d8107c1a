"""Operator 9: chat formatting with minimum-cost role repair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: States of the legal-turn automaton: nothing yet, and the role of the last turn. A conversation ends after the assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
#: Turns of a conversation that one task holds at once.
SEGMENT = 256
_FAR = 1e18


def _insertions(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns that make a turn of role legal after state; None if none do."""
    if role in LEGAL[state]:
        return ()
    for mid in LEGAL[state]:
        if role in LEGAL[mid]:
            return (mid,)
    return None


def options(state: int, role: int | None) -> list[tuple[float, int, int, str, tuple[int, ...]]]:
    """What can be done with a turn, cheapest kinds first: (cost, order, next state, action, roles inserted before)."""
    out: list[tuple[float, int, int, str, tuple[int, ...]]] = []
    if role is not None:
        ins = _insertions(state, role)
        if ins is not None:
            out.append((INSERT * len(ins), 0 if not ins else 3, role, "keep" if not ins else "insert", ins))
    if state != START and (role == state or role is None):
        out.append((MERGE, 1, state, "merge", ()))
    for other in LEGAL[state]:
        if other != role:
            out.append((RELABEL, 2, other, "relabel", ()))
    return out


def ending(state: int) -> tuple[int, ...]:
    """Empty turns that end a conversation after the assistant."""
    return {START: (), ASSISTANT: (), USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}[state]


def _role(value: str | None) -> int | None:
    return ROLES.get((value or "").strip().lower())


def segment_costs(roles: list[int | None]) -> np.ndarray:
    """Least cost from every state before the turns to every state after them: a (min, +) product of the turns' matrices."""
    total = np.full((4, 4), _FAR)
    np.fill_diagonal(total, 0)
    for r in roles:
        step = np.full((4, 4), _FAR)
        for s in range(4):
            for cost, _, nxt, _, _ in options(s, r):
                step[s, nxt] = min(step[s, nxt], cost)
        total = (total[:, :, None] + step[None, :, :]).min(axis=1)
    return total


def repair(roles: list[int | None], begin: int, end: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """The cheapest way through the turns from state to state: (role, action, inserted before) of each. Ties: keep, merge, relabel, insert."""
    n = len(roles)
    best = np.full((n + 1, 4), _FAR)
    best[n, end] = 0
    for i in range(n - 1, -1, -1):
        for s in range(4):
            best[i, s] = min([c + best[i + 1, t] for c, _, t, _, _ in options(s, roles[i])], default=_FAR)
    out, state = [], begin
    for i in range(n):
        _, _, state, action, ins = min(options(state, roles[i]), key=lambda o: (o[0] + best[i + 1, o[2]], o[1], o[2]))
        out.append((state, action, ins))
    return out


def _by_key(df: DataFrame, keys: list[str], order: list[str], handle: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """handle(key, rows in order) for each key: dealt by key, sorted, and read as a stream, so that small groups cost no call of their own."""
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        rows: list[tuple] = []

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[: len(keys)] != key:
                    if rows:
                        out += handle(key, rows)
                    key, rows = row[: len(keys)], []
                rows.append(row[len(keys) :])
            if out:
                yield batch_of(out)
        if rows:
            yield batch_of(handle(key, rows))

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def format_chat(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row per turn: conv_id, seq, turn, role, action, inserted (roles of empty turns before it), cost and rendered.

    The rendered pieces of a conversation, joined by seq, are the repaired conversation in the form
    <|role|> newline text newline <|end|> newline, for every turn.

    Turns are ordered by turn, role and text. A conversation is cut into segments of bounded length. Each segment gives a
    4 x 4 cost matrix; the matrices of a conversation, one row for every `segment` turns, fix the states at its
    segments' borders; then each segment is repaired by itself. So no task holds more than a segment's texts.

    Unknown or null roles can be merged or relabelled; null texts are empty; null turns come first; rows of a null
    conversation form one conversation; repeated rows are turns like any other. No rows give no rows.
    """
    space = Workspace(turns.sparkSession, "chat")
    src = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", F.xxhash64("text"))
    # a streamed, spilling sort; nothing after it holds more than a segment
    src = space.save(src.withColumn("seq", F.row_number().over(w).cast("long") - 1), "turns").withColumn("seg", F.floor(F.col("seq") / segment))
    conv_type = src.schema["conv_id"].dataType.simpleString()

    def costs(key: tuple, rows: list[tuple]) -> list[tuple]:
        return [(*key, segment_costs([_role(r[1]) for r in rows]).ravel().tolist())]

    def borders(key: tuple, rows: list[tuple]) -> list[tuple]:
        ms = [np.asarray(m).reshape(4, 4) for _, m in rows]
        after = [np.asarray([INSERT * len(ending(s)) for s in range(4)])]
        for m in reversed(ms):
            after.append((m + after[-1][None, :]).min(axis=1))
        after.reverse()
        states = [START]
        for i, m in enumerate(ms):
            states.append(int(np.argmin(m[states[-1]] + after[i + 1])))
        return [(*key, rows[i][0], states[i], states[i + 1], i == len(ms) - 1) for i in range(len(ms))]

    def repaired(key: tuple, rows: list[tuple]) -> list[tuple]:
        begin, end, last = rows[0][4], rows[0][5], rows[0][6]
        open_, state = begin != START, begin
        out: list[list] = []
        for (role, action, ins), (seq, turn, _, text, *_rest) in zip(repair([_role(r[2]) for r in rows], begin, end), rows):
            piece = ""
            for r in ins:
                piece += ("\n<|end|>\n" if open_ else "") + f"<|{NAMES[r]}|>\n"
                open_ = True
            piece += "\n" + text if action == "merge" else ("\n<|end|>\n" if open_ else "") + f"<|{NAMES[role]}|>\n" + text
            open_, state = True, role
            cost = {"keep": 0.0, "merge": MERGE, "relabel": RELABEL, "insert": INSERT * len(ins)}[action]
            out.append([key[0], seq, turn, NAMES[role], action, [NAMES[r] for r in ins], cost, piece])
        if last:
            for r in ending(state):
                out[-1][7] += f"\n<|end|>\n<|{NAMES[r]}|>\n"
                out[-1][6] += INSERT
                out[-1][5] = [*out[-1][5], NAMES[r]]
            out[-1][7] += "\n<|end|>\n"
        return [tuple(x) for x in out]

    seg_key = ["conv_id", "seg"]
    matrices = _by_key(src.select("conv_id", "seg", "seq", "role"), seg_key, ["seq"], costs, f"conv_id {conv_type}, seg long, m array<double>")
    edges = space.save(_by_key(matrices, ["conv_id"], ["seg"], borders, f"conv_id {conv_type}, seg long, begin int, end int, last boolean"), "borders")
    edges = edges.withColumnsRenamed({"conv_id": "_c", "seg": "_s"})
    full = src.join(edges, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("seg") == F.col("_s"))).select("conv_id", "seg", "seq", "turn", "role", "text", "begin", "end", "last")
    return _by_key(full, seg_key, ["seq"], repaired, f"conv_id {conv_type}, seq long, turn long, role string, action string, inserted array<string>, cost double, rendered string")
