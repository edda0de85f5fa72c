"""Chat formatting by minimum-cost role repair.

A legal conversation is a path of an automaton: an optional system turn, then user
and assistant in turn, user first. A dynamic program over its states chooses, per
turn of the input, to keep it, to relabel it, to merge it into the turn before, or
to put empty turns before it, at the least total cost; then the turns are rendered.
A long conversation is cut into pieces. Each gives the least cost from every state
to every state, a small matrix; matrices of a conversation are chained, and each
piece is repaired on its own between the states that the chain chose.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import dense_id
from .common import partitions, table, written

#: States: before the first turn, then the role of the last turn.
STATES = ("start", "system", "user", "assistant")
ROLES = STATES[1:]
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: States a conversation may end in.
FINAL = ("start", "user", "assistant")
COST = {"keep": 0, "merge": 1, "relabel": 2, "merge_relabel": 3, "insert": 3}
#: Most rows of a piece.
PIECE = 1024
INFINITE = 1 << 40


def _paths() -> dict[tuple[str, str], list[str]]:
    """The fewest empty turns that lead from a state to one from which the role is legal."""
    out = {}
    for s in STATES:
        level, seen = [(s, [])], {s}
        while level:
            for q, path in level:
                for r in LEGAL[q]:
                    out.setdefault((s, r), path)
            level = [(r, [*p, r]) for q, p in level for r in LEGAL[q] if r not in seen and not seen.add(r)]
    return out


INSERTS = _paths()


def moves(role: str | None) -> dict[str, list[tuple[int, str, str, list[str]]]]:
    """For each state the ways to take a turn of this role: cost, next state, action, roles of empty turns before it.

    An unknown role costs nothing to relabel. Ways are in the order that settles ties.
    """
    out: dict[str, list] = {}
    for s in STATES:
        ways = []
        if s in ROLES:
            ways.append((COST["merge"] if role in (s, None) else COST["merge_relabel"], s, "merge", []))
        for q in ROLES:
            if (s, q) in INSERTS:
                path = INSERTS[s, q]
                changed = 0 if role in (q, None) else COST["relabel"]
                ways.append((changed + COST["insert"] * len(path), q, "keep" if role == q else "relabel", path))
        out[s] = sorted(ways, key=lambda w: (w[0], ROLES.index(w[1]), w[2], len(w[3])))
    return out


MOVES: dict[str | None, dict] = {r: moves(r) for r in (*ROLES, None)}


def tables(roles: list[str | None], start: str) -> list[dict[str, tuple[int, str, tuple]]]:
    """After each turn, for each state: least cost, the state before, the way taken."""
    best: dict[str, tuple] = {start: (0, "", ())}
    out = [best]
    for r in roles:
        now: dict[str, tuple] = {}
        for s in STATES:
            if s in best:
                for way in MOVES[r][s]:
                    cost = best[s][0] + way[0]
                    if way[1] not in now or cost < now[way[1]][0]:
                        now[way[1]] = (cost, s, way)
        best = now
        out.append(best)
    return out


def repair(roles: list[str | None], start: str = "start", end: str | None = None) -> tuple[int, list[tuple[str, str, list[str]]]]:
    """Least cost, and per turn: action, role, roles of empty turns before it. `end` fixes the last state, else the cheapest legal one is taken."""
    steps = tables(roles, start)
    last = [s for s in STATES if s in steps[-1] and (s == end if end else s in FINAL)]
    if not last:
        # only a lone system turn: it can't end there, so it becomes a user turn or gets one after it
        last = list(steps[-1])
    s = min(last, key=lambda s: (steps[-1][s][0], STATES.index(s)))
    cost, out = steps[-1][s][0], []
    for step in reversed(steps[1:]):
        _, before, way = step[s]
        out.append((way[2], way[1], way[3]))
        s = before
    return cost, out[::-1]


def header(role: str) -> str:
    return f"<|{role}|>\n"


def grouped_rows(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], on: Callable[[tuple, list[dict]], Iterator[dict]]) -> Iterator[dict]:
    """Runs of equal keys of sorted rows."""
    at, held = None, []
    for b in batches:
        for row in b.to_pylist():
            k = tuple(row[c] for c in key)
            if k != at and held:
                yield from on(at, held)
                held = []
            at = k
            held.append(row)
    if held:
        yield from on(at, held)


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == 5000:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def repaired(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, piece, seq, turn, action, role, merged, rendered, cost: a row for each turn of the input and each empty turn.

    Rendered, in order of piece and seq, are a conversation's text. Roles are read
    trimmed and in lower case; a null or unknown one may become any. Null text counts
    as empty. Turns are taken in the order of turn (nulls first), role, text; rows equal
    in all four columns count once. Rows of null conv_id are a conversation of their own.
    A lone system turn becomes a user turn. An empty table gives no rows.
    """
    spark = turns.sparkSession
    rows = (
        turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.lower(F.trim("role")).alias("role"), F.col("text").cast("string"))
        .distinct()
    )
    rows = written(rows, "turns")
    n = partitions(spark)

    # conversations of more rows than a piece are numbered and cut; there is at most one for each `piece` rows of the table, broadcast only while Spark finds them small
    long = written(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece).select(F.col("conv_id").alias("_conv")), "long")
    is_long = F.col("conv_id").eqNullSafe(F.col("_conv"))
    short = rows.join(long, is_long, "left_anti").withColumn("piece", F.lit(0).cast("long"))
    numbered = dense_id(rows.join(long, is_long, "left_semi"), [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")], "_at")
    firsts = numbered.groupBy("conv_id").agg(F.min("_at").alias("_from")).withColumnRenamed("conv_id", "_conv")
    pieces = numbered.join(firsts, is_long).withColumn("piece", F.floor((F.col("_at") - F.col("_from")) / piece)).drop("_conv", "_at", "_from")

    # their matrices, chained per conversation
    cut = pieces.repartition(n, "conv_id", "piece")
    cut = cut.sortWithinPartitions("conv_id", "piece", F.col("turn").asc_nulls_first(), "role", "text")
    sides = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("costs", pa.list_(pa.int64()))])

    def known(role: str | None) -> str | None:
        return role if role in ROLES else None

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def on(key: tuple, held: list[dict]) -> Iterator[dict]:
            costs = []
            for s in STATES:
                last = tables([known(r["role"]) for r in held], s)[-1]
                costs += [last[q][0] if q in last else INFINITE for q in STATES]
            yield {"conv_id": key[0], "piece": key[1], "costs": costs}

        yield from _batched(grouped_rows(batches, ("conv_id", "piece"), on), sides)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        best, steps = [0, INFINITE, INFINITE, INFINITE], []
        for costs in pdf["costs"]:
            ways = [min((best[s] + costs[s * 4 + q], s) for s in range(4)) for q in range(4)]
            steps.append([w[1] for w in ways])
            best = [w[0] for w in ways]
        q = min((s for s in range(4) if STATES[s] in FINAL), key=lambda s: (best[s], s))
        ends = []
        for back in reversed(steps):
            ends.append((STATES[back[q]], STATES[q]))
            q = back[q]
        ends.reverse()
        return pd.DataFrame({"conv_id": pdf["conv_id"].to_list(), "piece": pdf["piece"].to_list(), "enter": [e[0] for e in ends], "leave": [e[1] for e in ends]}).astype({"conv_id": "Int64"})

    borders = (
        cut.mapInArrow(matrices, "conv_id long, piece long, costs array<long>")
        .groupBy("conv_id")
        .applyInPandas(chain, "conv_id long, piece long, enter string, leave string")
        .withColumnsRenamed({"conv_id": "_conv", "piece": "_piece"})
    )
    shape = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("action", pa.string()), ("role", pa.string()), ("merged", pa.bool_()), ("rendered", pa.string()), ("cost", pa.int64())])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def on(key: tuple, held: list[dict]) -> Iterator[dict]:
            roles = [known(r["role"]) for r in held]
            enter, leave = held[0]["enter"] or "start", held[0]["leave"]
            if roles == ["system"] and leave is None:
                plan = [("relabel", "user", [])]
            else:
                _, plan = repair(roles, enter, leave)
            seq = 0
            for r, given, (action, role, before) in zip(held, roles, plan):
                base = {"conv_id": key[0], "piece": key[1], "turn": r["turn"]}
                for x in before:
                    yield base | {"seq": seq, "action": "insert", "role": x, "merged": False, "rendered": header(x) + "\n", "cost": COST["insert"]}
                    seq += 1
                merged = action == "merge"
                cost = (COST["merge"] if given in (role, None) else COST["merge_relabel"]) if merged else COST["relabel"] if given not in (role, None) else 0
                yield base | {"seq": seq, "action": action, "role": role, "merged": merged, "rendered": ("" if merged else header(role)) + (r["text"] or "") + "\n", "cost": cost}
                seq += 1

        yield from _batched(grouped_rows(batches, ("conv_id", "piece"), on), shape)

    placed = pieces.join(borders, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece"))).drop("_conv", "_piece")
    placed = placed.unionByName(short.withColumns({"enter": F.lit(None).cast("string"), "leave": F.lit(None).cast("string")}))
    placed = placed.repartition(n, "conv_id", "piece").sortWithinPartitions("conv_id", "piece", F.col("turn").asc_nulls_first(), "role", "text")
    return placed.mapInArrow(render, "conv_id long, piece long, seq long, turn long, action string, role string, merged boolean, rendered string, cost long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
