"""Chat formatting by minimum-cost role repair.

A conversation is legal if it is: an optional system turn, then user and assistant turns in alternation that begin with user and
end with assistant. Each turn of the input either

* stands as it is (cost 0; MEND if its role is none of the three, as it then needs a role anyway),
* is merged into the turn before it, whose role it has (MERGE),
* is given another role (RELABEL), or
* has an empty turn of the missing role put in before it (INSERT; so too at the end),

and dynamic programming over the automaton of legal turns finds the cheapest repair; ties go to the first of: stand, merge,
insert, relabel. The repaired turns are then rendered as <|role|>\\ntext<|end|>\\n.

The states are what the last turn was (nothing yet, system, user, assistant), so a part of a conversation is a 4 x 4 matrix of
least costs, and parts combine by min-plus products.

Every conversation of at most STRETCH turns and STRETCH_CHARS characters comes to one task, is repaired there and is one row. A
longer one, which may be a third of all rows, is numbered by a range sort, and cut before every STRETCH turns and every
STRETCH_CHARS characters, counted from its beginning; each part gives its matrix, a conversation's few matrices are combined in
order to find the costs ahead at the cuts; each part shows where each state before it leads, and is then repaired and rendered on its
own from the state that is reached there, as the whole conversation would be. What parts say is put together in order, so each conversation is one row whatever its length, up to the 2 GB that a string may have; rows
depend on the conversations alone and never on partitions or tasks.

Turns are ordered by turn (null first), then role and text. A null text is empty; a null or unknown role is relabelled at cost
MEND; case and white space around a role are ignored. Rows with a null conv_id are one conversation. Repeated rows are turns of
their own (two equal user turns are merged). A very long text is a turn like any other, never cut. Empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.staging import staged

from .common import numbered_parts

ROLES = ("system", "user", "assistant")
NONE, SYSTEM, USER, ASSISTANT = range(4)
MERGE, INSERT, RELABEL, MEND = 1, 3, 4, 2
_BIG = 1 << 40
END = "<|end|>\n"
#: Turns and characters of one conversation that are repaired together; a longer one is cut where it reaches a multiple of them.
STRETCH, STRETCH_CHARS = 50_000, 16_000_000
#: Rows and characters that a task passes on at once.
FLUSH, FLUSH_CHARS = 1000, 4_000_000


def _moves() -> list[list[tuple[int, int, int, bool, int]]]:
    """For each input role (NONE: unknown): (state before, state after, cost, merged, role of an empty turn put in before or NONE), in order of preference."""
    follows = {(NONE, SYSTEM), (NONE, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    out: list[list[tuple[int, int, int, bool, int]]] = []
    for role in range(4):
        own = []
        for new in (SYSTEM, USER, ASSISTANT):
            change = 0 if new == role else MEND if role == NONE else RELABEL
            for old in range(4):
                if (old, new) in follows:
                    own.append((change, 0, old, new, False, NONE))
                if old == new:
                    own.append((change + MERGE, 1, old, new, True, NONE))
                for put in (USER, ASSISTANT):
                    if (old, put) in follows and (put, new) in follows:
                        own.append((change + INSERT, 2, old, new, False, put))
        out.append([(old, new, cost, merged, put) for cost, _, old, new, merged, put in sorted(own)])
    return out


MOVES = _moves()


def least_matrix(roles: np.ndarray) -> np.ndarray:
    """Least cost from each state before to each state after a stretch of input roles."""
    cost = np.full((4, 4), _BIG, np.int64)
    np.fill_diagonal(cost, 0)
    step = np.full((4, 4, 4), _BIG, np.int64)
    for role, moves in enumerate(MOVES):
        for old, new, c, _, _ in moves:
            step[role, old, new] = min(step[role, old, new], c)
    for role in roles.tolist():
        cost = (cost[:, :, None] + step[role][None]).min(1)
    return np.minimum(cost, _BIG)


def end_costs() -> list[int]:
    """Cost of ending in each state: an empty user or assistant turn may be missing."""
    return [_BIG, 2 * INSERT, INSERT, 0]


def only(state: int) -> list[int]:
    """Costs of ending in each state where there is only one to end in."""
    return [0 if s == state else _BIG for s in range(4)]


def repair(roles: np.ndarray, before: int, ahead: list[int]) -> tuple[list[tuple[int, bool, int]], int]:
    """The cheapest (new role, merged, role of an empty turn put in before) for each turn, from a state to any with these costs
    ahead of it, and the state it ends in."""
    n = len(roles)
    best = np.full((n + 1, 4), _BIG, np.int64)
    best[n] = ahead
    for i in range(n - 1, -1, -1):
        for old, new, c, _, _ in MOVES[roles[i]]:
            best[i, old] = min(best[i, old], c + best[i + 1, new])
    out, state = [], before
    for i in range(n):
        for old, new, c, merged, put in MOVES[roles[i]]:
            if old == state and c + best[i + 1, new] == best[i, state]:
                out.append((new, merged, put))
                state = new
                break
    return out, state


PACKED = "conv_id long, part long, roles array<int>, texts array<string>, cost array<bigint>"
REPAIRED = "conv_id long, part long, opens boolean, closes boolean, cost long, turns array<struct<role:string,text:string,n_source:bigint,joins:boolean>>"
_KINDS = {"conv_id": pa.int64(), "part": pa.int64(), "roles": pa.list_(pa.int32()), "texts": pa.list_(pa.string()), "cost": pa.list_(pa.int64())}


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (conv_id, part), with its matrix. Rows (conv_id, part, role, text) come in order."""
    rows: list[tuple] = []
    roles: list[int] = []
    texts: list[str] = []
    at, waiting = None, 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], list(_KINDS))
        rows.clear()
        return out

    for batch in batches:
        for conv, part, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if at != (conv, part):
                if at:
                    rows.append((*at, list(roles), list(texts), least_matrix(np.array(roles)).ravel().tolist()))
                    roles.clear()
                    texts.clear()
                if waiting > FLUSH_CHARS or len(rows) >= FLUSH:
                    yield flush()
                    waiting = 0
                at = (conv, part)
            roles.append(role)
            texts.append(text)
            waiting += len(text)
    if at:
        rows.append((*at, list(roles), list(texts), least_matrix(np.array(roles)).ravel().tolist()))
        yield flush()


def _borders(table: pa.Table) -> pa.Table:
    """The costs ahead of each of one conversation's parts, as a repair of the whole conversation has them there."""
    table = table.sort_by("part")
    steps = [np.array(c).reshape(4, 4) for c in table["cost"].to_pylist()]
    states, total = border_states(steps)
    ahead = [only(states[-1])]
    for m in reversed(steps[1:]):
        ahead.append(np.minimum((m + np.array(ahead[-1])[None]).min(1), _BIG).tolist())
    n = len(steps)
    return pa.table({
        "of": table["conv_id"], "of_part": table["part"], "ahead": pa.array(ahead[::-1], pa.list_(pa.int64())),
        "opens": [i == 0 for i in range(n)], "closes": [i == n - 1 for i in range(n)], "total": pa.array([total] * n, pa.int64()),
    })


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each state before a part leads to."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            roles, ahead = np.array(row.column("roles")[0].as_py()), row.column("ahead")[0].as_py()
            ends = [repair(roles, s, ahead)[1] for s in range(4)]
            yield pa.RecordBatch.from_arrays([row.column("conv_id"), row.column("part"), pa.array([ends], pa.list_(pa.int32()))], ["conv_id", "part", "ends"])


def _reached(table: pa.Table) -> pa.Table:
    """The state before each part of one conversation."""
    table = table.sort_by("part")
    states = [NONE]
    for ends in table["ends"].to_pylist():
        states.append(ends[states[-1]])
    return pa.table({"of": table["conv_id"], "of_part": table["part"], "before": pa.array(states[:-1], pa.int32())})


def border_states(steps: list[np.ndarray]) -> tuple[list[int], int]:
    """The states of a cheapest repair before, between and after stretches with these matrices, and what it costs."""
    tail = [np.array(end_costs(), np.int64)]
    for m in reversed(steps):
        tail.append((m + tail[-1][None]).min(1))
    tail.reverse()
    states = [NONE]
    for i, m in enumerate(steps):
        states.append(int((m[states[-1]] + tail[i + 1]).argmin()))
    return states, int(tail[0][NONE])


def repaired_stretch(roles: list[int], texts: list[str], before: int, ahead: list[int], closes: bool) -> list[tuple[str, str, int, bool]]:
    """(role, text, turns of the input in it, does it continue the last turn of the stretch before)."""
    out: list[list] = []
    moves, after = repair(np.array(roles), before, ahead)
    for text, (role, merged, put) in zip(texts, moves, strict=True):
        if put != NONE:
            out.append([put, [], False])
        if merged and out:
            out[-1][1].append(text)
        else:
            out.append([role, [text], merged])
    if closes and after == SYSTEM:
        out.append([USER, [], False])
    if closes and after != ASSISTANT:
        out.append([ASSISTANT, [], False])
    return [(ROLES[role - 1], "\n".join(own), len(own), joins) for role, own, joins in out]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("n_source", pa.int64()), ("joins", pa.bool_())]))
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            own = batch.slice(i, 200)
            out, opens, closes, costs = [], [], [], []
            for row in own.to_pylist():
                before, ahead, total = row.get("before"), row.get("ahead"), row.get("total")
                if before is None:
                    (before, after), total = border_states([np.array(row["cost"]).reshape(4, 4)])
                    ahead = only(after)
                opens.append(row.get("opens") is not False)
                closes.append(row.get("closes") is not False)
                costs.append(total)
                turns = repaired_stretch(row["roles"], row["texts"], before, ahead, closes[-1])
                out.append([dict(zip(("role", "text", "n_source", "joins"), t, strict=True)) for t in turns])
            columns = [own.column("conv_id"), own.column("part"), pa.array(opens), pa.array(closes), pa.array(costs, pa.int64()), pa.array(out, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "opens", "closes", "cost", "turns"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _repaired(_packed(batches))


def repaired_parts(conversations: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(a row for each conversation of at most STRETCH turns and STRETCH_CHARS characters, a row for each part of longer ones or None).

    part is the number of its first turn, from 0; opens and closes mark the first and last part of a conversation, cost is that of
    the whole conversation. turns: role, text, n_source (turns of the input in it), joins (it continues the turn before the part).
    """
    role = F.lower(F.trim("role"))
    number = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), role), F.lit(0)).cast("int")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), number.alias("role_no"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role_no", "text")]
    per = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = staged(per.where((F.col("n") > STRETCH) | (F.col("chars") > STRETCH_CHARS)).select(F.col("conv_id").alias("of")))
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    whole = rows.join(long, same, "left_anti").repartition("conv_id").sortWithinPartitions(*order)
    out = whole.select("conv_id", F.lit(0).cast("long").alias("part"), "role_no", "text").mapInArrow(_whole, REPAIRED)
    if long.isEmpty():
        return out, None
    cut = numbered_parts(rows.join(long, same, "left_semi"), order, STRETCH, STRETCH_CHARS)
    packed = staged(cut.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "part", "role_no", "text").mapInArrow(_packed, PACKED))
    of = same & (F.col("part") == F.col("of_part"))
    borders = packed.select("conv_id", "part", "cost").groupBy("conv_id").applyInArrow(_borders, "of long, of_part long, ahead array<bigint>, opens boolean, closes boolean, total long")
    borders = staged(borders)
    ends = packed.select("conv_id", "part", "roles").join(borders, of).select("conv_id", "part", "roles", "ahead").mapInArrow(_ends, "conv_id long, part long, ends array<int>")
    reached = staged(staged(ends).groupBy("conv_id").applyInArrow(_reached, "of long, of_part long, before int"))
    both = packed.join(borders, of).drop("of", "of_part").join(reached, of).drop("of", "of_part")
    return out, both.mapInArrow(_repaired, REPAIRED)


def render(parts: DataFrame) -> DataFrame:
    """parts with `rendered`: chat markup that, put together in order, is the conversation. A turn's end is written by the next."""
    head = lambda t, i: F.concat(F.when(F.col("opens") & (i == 0), "").otherwise(END), F.lit("<|"), t["role"], F.lit("|>\n"))
    turn = lambda t, i: F.concat(F.when(t["joins"], "\n").otherwise(head(t, i)), t["text"])
    return parts.withColumn("rendered", F.concat(F.array_join(F.transform("turns", turn), ""), F.when(F.col("closes"), END).otherwise("")))


CHATS = "conv_id long, n_turns long, n_source long, cost long, rendered string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its parts, which come in order."""
    names = [c.split()[0] for c in CHATS.split(", ")]
    own: list = []
    said: list[str] = []

    def row() -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.large_string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*own, "".join(said)], kinds, strict=True)], names)

    for batch in batches:
        for i in range(batch.num_rows):
            conv, n_turns, n_source, cost, rendered = (batch.column(k)[i].as_py() for k in range(5))
            if own and own[0] == conv:
                own[1:3] = own[1] + n_turns, own[2] + n_source
                said.append(rendered)
                continue
            if own:
                yield row()
            own, said = [conv, n_turns, n_source, cost], [rendered]
    if own:
        yield row()


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_source, cost, rendered): one row for each conversation and its repaired turns."""
    whole, parts = (said(x) if x else None for x in repaired_parts(conversations))
    columns = [c.split()[0] for c in CHATS.split(", ")]
    if parts is None:
        return whole.select(*columns)
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").select(*columns)
    return whole.select(*columns).union(parts.mapInArrow(_joined, CHATS))


def said(parts: DataFrame) -> DataFrame:
    """parts with what they are rendered to and how many turns of their own, and of the input, they have."""
    n_source = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["n_source"])
    n_turns = F.size(F.filter("turns", lambda t: ~t["joins"])).cast("long")
    return render(parts).select("conv_id", "part", n_turns.alias("n_turns"), n_source.alias("n_source"), "cost", "rendered")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
