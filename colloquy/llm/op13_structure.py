"""Conversation structure repair: a time-major tensor of state costs for many conversations at once.

Turns come in the order of turn (null first), then role and text. The first fault of each counts: blank (nothing but white space),
duplicate (role and text were seen earlier in the conversation), truncated (the last character that isn't white space ends no
sentence). Edits make the initials of roles match (s?(ua)+)?: keep a turn (0), give it the role user or assistant (REROLE), delete it
(DELETE; blank and duplicate turns must go) or put an empty turn of user or assistant in anywhere (INSERT); a truncated turn that
stays adds TRUNCATED. Of the cheapest edits those whose initials D, I, K, R are least as a string are taken.

A state is what the last turn was (nothing, system, user, assistant), and each state has one role that may follow by another's
doing, so a letter leads to one state. Conversations are bucketed by length (powers of two); for each bucket a tensor (time, conversation,
state) of the costs that lie ahead is filled from the last turn to the first for all conversations at once and kept, and edits are
then traced from first to last for all at once: at each turn the least letter that keeps to the stored cost.

Every conversation of at most STRETCH turns and STRETCH_CHARS characters comes to one task, with many others. A longer one, which may
hold a third of all rows, is numbered by a range sort and cut into parts of that size. Each part gives its matrix of least costs
between states (the same tensor with four ends); a conversation's few matrices give the costs ahead at the cuts; each part is traced
from all four states to see where they lead, and then once more from the state it is reached in. Duplicates across parts are found by
a grouped minimum and a join. Results are those of the whole conversation: its one row holds the parts' edits in order, and the
digest of its text is fed part by part, as a hash of a sequence must be, with one part in memory. What a conversation's row holds,
one letter for each edit, is as long as the conversation.

Nulls: a null role or text is one space; null conv_ids are one conversation; null turns come first. Repeated rows are duplicates.
Empty and very long texts are turns like any other, never cut. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.staging import staged

from .common import numbered_parts

START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {USER: "user", ASSISTANT: "assistant"}
WHITE = " \t\n\v\f\r"
#: Turns and characters of one conversation that a task holds together.
STRETCH, STRETCH_CHARS = 50_000, 16_000_000
#: Turns and bytes of text that a task gathers before it repairs them, and cells (turns by conversations) of one tensor.
ROWS, BYTES, CELLS = 50_000, 8_000_000, 250_000
_BIG = 1 << 40
#: The state after a role that is put in or given, and after a role that is kept (rows: state; columns: s, u, a, other; -1: not legal).
_FOLLOW = np.array([USER, USER, ASSISTANT, USER])
_KEEP = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: Costs of ending in each state.
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_D, _I, _K, _R = (ord(c) for c in "DIKR")


# --- tensors -----------------------------------------------------------------------------------------


@dataclass
class Bucket:
    """Turns of conversations by (time, conversation); a conversation's own turns are its first `length`."""

    kind: np.ndarray  # initial of the role: 0 s, 1 u, 2 a, 3 other
    goes: np.ndarray  # must be deleted
    extra: np.ndarray  # cost of staying
    length: np.ndarray


def costs_ahead(own: Bucket, end: np.ndarray) -> np.ndarray:
    """(time + 1, conversation, state): the least cost from before a turn to the end, whose costs by state are given."""
    steps, n = own.kind.shape
    ahead = np.empty((steps + 1, n, 4), np.int64)
    ahead[steps] = end
    states = np.arange(4)
    for t in range(steps - 1, -1, -1):
        after = ahead[t + 1]
        to = _KEEP[states[None], own.kind[t][:, None]]
        keep = np.where(to < 0, _BIG, np.take_along_axis(after, np.maximum(to, 0), 1))
        stay = np.minimum(keep, REROLE + after[:, _FOLLOW]) + own.extra[t][:, None]
        best = np.minimum(after + DELETE, np.where(own.goes[t][:, None], _BIG, stay))
        user, assistant = best[:, USER].copy(), best[:, ASSISTANT].copy()
        best[:, USER] = np.minimum(user, assistant + INSERT)
        best[:, ASSISTANT] = np.minimum(assistant, user + INSERT)
        best[:, :USER] = np.minimum(best[:, :USER], best[:, USER, None] + INSERT)
        ahead[t] = np.where((t < own.length)[:, None], best, after)
    return ahead


def traced(own: Bucket, ahead: np.ndarray, start: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, state after each letter, last state): letters by (3 * time + turn at it, conversation), 0 where there is none."""
    steps, n = own.kind.shape
    letters, states = np.zeros((3 * steps + 2, n), np.uint8), np.zeros((3 * steps + 2, n), np.uint8)
    state, at = start.copy(), np.arange(n)
    for t in range(steps):
        live = t < own.length
        for turn in range(3):
            if not live.any():
                break
            cost, after = ahead[t, at, state], ahead[t + 1]
            to = _KEEP[state, own.kind[t]]
            drop = live & (after[at, state] + DELETE == cost)
            put = live & ~drop & (ahead[t, at, _FOLLOW[state]] + INSERT == cost)
            keep = live & ~drop & ~put & ~own.goes[t] & (to >= 0) & (after[at, np.maximum(to, 0)] + own.extra[t] == cost)
            name = live & ~drop & ~put & ~keep
            state = np.where(put | name, _FOLLOW[state], np.where(keep, to, state))
            letters[3 * t + turn] = drop * _D + put * _I + keep * _K + name * _R
            states[3 * t + turn] = state
            live = put
    for turn in range(2):
        put = closes & ((state == SYSTEM) | (state == USER))
        state = np.where(put, _FOLLOW[state], state)
        letters[3 * steps + turn], states[3 * steps + turn] = put * _I, state
    return letters, states, state


# --- turns of a task ---------------------------------------------------------------------------------


@dataclass
class Turns:
    """Whole stretches of turns in order, as arrays; `begin` has the first row of each and the end."""

    table: pa.Table
    begin: np.ndarray
    kind: np.ndarray
    blank: np.ndarray
    duplicate: np.ndarray
    truncated: np.ndarray

    def sums(self, flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return total[self.begin[1:]] - total[self.begin[:-1]]

    def illegal(self) -> np.ndarray:
        """Neighbours in one stretch whose initials can't follow each other."""
        pair = np.zeros(len(self.kind), bool)
        good = np.array([[(a, b) in _LEGAL for b in range(4)] for a in range(4)])
        pair[1:] = ~good[self.kind[:-1], self.kind[1:]]
        pair[self.begin[:-1]] = False
        return self.sums(pair)

    def buckets(self, most: int) -> Iterator[tuple[np.ndarray, Bucket]]:
        """(stretches, their turns), of about equal length each and of at most `most` cells."""
        length = np.diff(self.begin)
        size = np.ceil(np.log2(length)).astype(np.int64)
        for s in np.unique(size).tolist():
            which = np.flatnonzero(size == s)
            step = max(1, most >> s)
            for a in range(0, len(which), step):
                own = which[a : a + step]
                at = np.minimum(self.begin[own][None] + np.arange(length[own].max())[:, None], len(self.kind) - 1)
                yield own, Bucket(self.kind[at], (self.blank | self.duplicate)[at], np.where(self.truncated, TRUNCATED, 0)[at], length[own])


def _seen_before(table: pa.Table, group: np.ndarray) -> np.ndarray:
    """Was a row's role and text seen in its stretch before it?"""
    role, text = (table[c].combine_chunks().dictionary_encode() for c in ("role", "text"))
    key = group * max(1, len(role.dictionary)) + role.indices.to_numpy()
    key = key * max(1, len(text.dictionary)) + text.indices.to_numpy()
    first = np.unique(key, return_index=True)[1]
    out = np.ones(len(key), bool)
    out[first] = False
    return out


def _as_turns(table: pa.Table, begin: np.ndarray) -> Turns:
    flag = lambda c: table[c].to_numpy().astype(bool)
    group = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    blank = flag("blank")
    again = flag("again") if "again" in table.column_names else _seen_before(table, group)
    duplicate = again & ~blank
    return Turns(table, begin, table["kind"].to_numpy().astype(np.int64), blank, duplicate, flag("cut_off") & ~blank & ~duplicate)


def whole_stretches(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[Turns]:
    """Sorted rows, gathered to about so many rows or bytes and cut between stretches (conv_id, part)."""
    waiting: list[pa.RecordBatch] = []
    n = held = 0

    def borders(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for c in ("conv_id", "part"):
            own = table[c].combine_chunks()
            v, null = own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= (v[1:] != v[:-1]) | (null[1:] != null[:-1])
        return np.flatnonzero(new)

    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            piece = batch.slice(a, 1000)
            waiting.append(piece)
            n, held = n + piece.num_rows, held + piece.get_total_buffer_size() * piece.num_rows // max(1, batch.num_rows)
            if n >= rows or held >= size:
                table = pa.Table.from_batches(waiting)
                begin = borders(table)
                if len(begin) > 1:
                    yield _as_turns(table.slice(0, begin[-1]), begin)
                    table = table.slice(begin[-1])
                waiting, n, held = table.to_batches(), len(table), table.nbytes
                rows, size = max(rows, 2 * n), max(size, 2 * held)  # so that one long stretch isn't looked at for each piece
    if n:
        table = pa.Table.from_batches(waiting)
        yield _as_turns(table, np.append(borders(table), len(table)))


def _starts(own: Turns, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state before, costs at the end, is it the last part) of stretches; a whole conversation's if rows don't say."""
    if "start" not in own.table.column_names:
        return np.zeros(len(which), np.int64), np.broadcast_to(_END, (len(which), 4)), np.ones(len(which), bool)
    first = own.begin[:-1][which]
    column = lambda c: own.table[c].to_numpy()[first]
    return column("start").astype(np.int64), np.stack([column(f"after{s}") for s in range(4)], 1), column("closes").astype(bool)


REPAIRED = "conv_id long, part long, first int, last int, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in whole_stretches(batches, ROWS, BYTES):
        count = len(own.begin) - 1
        cost, audit, repaired = np.zeros(count, np.int64), [""] * count, [[]] * count
        role, text = own.table["role"].to_pylist(), own.table["text"].to_pylist()
        for which, bucket in own.buckets(CELLS):
            start, end, closes = _starts(own, which)
            ahead = costs_ahead(bucket, end)
            letters, states, _ = traced(bucket, ahead, start, closes)
            cost[which] = ahead[0, np.arange(len(which)), start]
            for k, b in enumerate(which.tolist()):
                slots = np.flatnonzero(letters[:, k])
                said = letters[slots, k]
                audit[b] = said.tobytes().decode()
                rows = (own.begin[b] + slots // 3).tolist()
                repaired[b] = [
                    (role[i], text[i]) if x == _K else (ROLES[s], text[i] if x == _R else "")
                    for x, i, s in zip(said.tolist(), rows, states[slots, k].tolist(), strict=True) if x != _D
                ]
        ids = own.table.select(["conv_id", "part"]).take(pa.array(own.begin[:-1]))
        ends = pa.array(own.kind[own.begin[:-1]], pa.int32()), pa.array(own.kind[own.begin[1:] - 1], pa.int32())
        sums = [pa.array(x) for x in (own.sums(own.blank), own.sums(own.duplicate), own.sums(own.truncated), own.illegal(), cost)]
        turns = pa.array([[{"role": r, "text": t} for r, t in turns] for turns in repaired], pa.list_(_TURN))
        columns = [ids["conv_id"].combine_chunks(), ids["part"].combine_chunks(), *ends, *sums, pa.array(audit, pa.string()), turns]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in REPAIRED.split(", ")])


# --- parts of long conversations -----------------------------------------------------------------------


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least costs between the states before and after each part."""
    for own in whole_stretches(batches, ROWS, BYTES):
        out: list = [None] * (len(own.begin) - 1)
        for which, b in own.buckets(CELLS // 4):
            four = Bucket(np.repeat(b.kind, 4, 1), np.repeat(b.goes, 4, 1), np.repeat(b.extra, 4, 1), np.repeat(b.length, 4))
            end = np.tile(np.where(np.eye(4, dtype=bool), 0, _BIG), (len(which), 1))
            cost = costs_ahead(four, end)[0].reshape(-1, 4, 4).swapaxes(1, 2)
            for k, i in enumerate(which.tolist()):
                out[i] = np.minimum(cost[k], _BIG).ravel().tolist()
        ids = own.table.select(["conv_id", "part"]).take(pa.array(own.begin[:-1]))
        yield pa.RecordBatch.from_arrays([ids["conv_id"].combine_chunks(), ids["part"].combine_chunks(), pa.array(out, pa.list_(pa.int64()))], ["conv_id", "part", "cost"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each state before a part leads to."""
    for own in whole_stretches(batches, ROWS, BYTES):
        out: list = [None] * (len(own.begin) - 1)
        for which, b in own.buckets(CELLS // 4):
            _, end, _ = _starts(own, which)
            ahead = costs_ahead(b, end)
            last = [traced(b, ahead, np.full(len(which), s), np.zeros(len(which), bool))[2] for s in range(4)]
            for i, states in zip(which.tolist(), np.stack(last, 1).tolist(), strict=True):
                out[i] = states
        ids = own.table.select(["conv_id", "part"]).take(pa.array(own.begin[:-1]))
        yield pa.RecordBatch.from_arrays([ids["conv_id"].combine_chunks(), ids["part"].combine_chunks(), pa.array(out, pa.list_(pa.int32()))], ["conv_id", "part", "ends"])


def _borders(table: pa.Table) -> pa.Table:
    """Costs ahead at the end of each part of one conversation."""
    table = table.sort_by("part")
    end, after = _END, []
    for cost in reversed(table["cost"].to_pylist()):
        after.append(end)
        end = (np.array(cost).reshape(4, 4) + end[None]).min(1)
    after = np.stack(after[::-1])
    closes = [False] * (len(table) - 1) + [True]
    return pa.table({"of": table["conv_id"], "of_part": table["part"], **{f"after{s}": after[:, s] for s in range(4)}, "closes": closes})


def _reached(table: pa.Table) -> pa.Table:
    """The state before each part of one conversation."""
    table = table.sort_by("part")
    states = [START]
    for ends in table["ends"].to_pylist():
        states.append(ends[states[-1]])
    return pa.table({"of": table["conv_id"], "of_part": table["part"], "start": pa.array(states[:-1], pa.int32())})


def _of_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(parts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).drop("of", "of_part")


def _in_order(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "part", *columns)


def _long(rows: DataFrame) -> DataFrame:
    """Repaired parts of long conversations."""
    cut = staged(numbered_parts(rows, _order(), STRETCH, STRETCH_CHARS))
    said = cut.select("conv_id", "place", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"))
    first = said.groupBy("conv_id", "said").agg(F.min("place").alias("before")).select(F.col("conv_id").alias("of"), F.col("said").alias("same"), "before")
    again = said.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("same"))).where("place > before")
    marked = cut.join(again.select("place", F.lit(True).alias("again")), "place", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    marked = staged(marked)
    flags = "kind", "blank", "cut_off", "again"
    matrices = _in_order(marked, *flags).mapInArrow(_matrices, "conv_id long, part long, cost array<bigint>")
    after = ", ".join(f"after{s} long" for s in range(4))
    borders = staged(staged(matrices).groupBy("conv_id").applyInArrow(_borders, f"of long, of_part long, {after}, closes boolean"))
    bound = _of_parts(marked, borders).withColumn("start", F.lit(START))
    names = [*(f"after{s}" for s in range(4)), "closes", "start"]
    ends = _in_order(bound, *flags, *names).mapInArrow(_ends, "conv_id long, part long, ends array<int>")
    reached = staged(staged(ends).groupBy("conv_id").applyInArrow(_reached, "of long, of_part long, start int"))
    return _in_order(_of_parts(bound.drop("start"), reached), *flags, "role", "text", *names).mapInArrow(_repaired, REPAIRED)


# --- whole tables ------------------------------------------------------------------------------------


def _order() -> list:
    return [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]


def marked_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, kind, blank, cut_off) for every row."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    bare = F.rtrim("text", F.lit(WHITE))
    kind = F.array_position(F.array(*[F.lit(c) for c in "sua"]), F.substring("role", 1, 1))
    kind = F.when(kind > 0, kind - 1).otherwise(3)
    return rows.select("*", kind.cast("int").alias("kind"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*".!?")).alias("cut_off"))


def repaired_parts(conversations: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(repaired conversations, parts of the long ones or None), with the columns of REPAIRED; parts are numbered in order."""
    rows = marked_turns(conversations)
    per = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = staged(per.where((F.col("n") > STRETCH) | (F.col("chars") > STRETCH_CHARS)).select(F.col("conv_id").alias("of")))
    if long.isEmpty():
        return _whole(rows), None
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    return _whole(rows.join(long, same, "left_anti")), _long(rows.join(long, same, "left_semi"))


def _whole(rows: DataFrame) -> DataFrame:
    columns = "conv_id", F.lit(0).cast("long").alias("part"), "kind", "blank", "cut_off", "role", "text"
    return rows.repartition("conv_id").sortWithinPartitions(*_order()).select(*columns).mapInArrow(_repaired, REPAIRED)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, at, role, text): the turns of all repaired conversations; they are in order of part and at."""
    whole, parts = repaired_parts(conversations)
    both = whole.union(parts) if parts else whole
    return both.select("conv_id", "part", F.posexplode("repaired").alias("at", "turn")).select("conv_id", "part", "at", "turn.role", "turn.text")


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
REPORT = ", ".join(["conv_id long", *(f"{c} long" for c in _COUNTS), "audit string", "repaired_sha256 string"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its parts in order; of their texts one part is held."""
    own: dict | None = None

    def row() -> pa.RecordBatch:
        values = [own["conv_id"], *own["sums"], "".join(own["audit"]), own["hash"].hexdigest()]
        kinds = [pa.int64()] * (1 + len(_COUNTS)) + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in REPORT.split(", ")])

    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1).to_pylist()[0]
            if own is None or own["conv_id"] != part["conv_id"]:
                if own is not None:
                    yield row()
                own = {"conv_id": part["conv_id"], "sums": [0] * 4 + [part["cost"]], "audit": [], "hash": hashlib.sha256(), "last": None, "any": False}
            for k, c in enumerate(_COUNTS[:4]):
                own["sums"][k] += part[c]
            own["sums"][3] += own["last"] is not None and (own["last"], part["first"]) not in _LEGAL
            own["last"] = part["last"]
            own["audit"].append(part["audit"])
            for turn in part["repaired"]:
                own["hash"].update((("\n" if own["any"] else "") + f"{turn['role']}:{turn['text']}").encode())
                own["any"] = True
    if own is not None:
        yield row()


def repair_reports(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: faults, cost, edits and the SHA-256 of the repaired turns (role:text, joined by newlines)."""
    whole, parts = repaired_parts(conversations)
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = whole.select("conv_id", *_COUNTS, "audit", F.sha2(text, 256).alias("repaired_sha256"))
    if parts is None:
        return out
    return out.union(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_joined, REPORT))


def turn_gaps(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps): numbers missing between the least and the largest turn; nulls don't count."""
    per = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).distinct()
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return per.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the faults that the check sum of conv_id:turn gives each."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", own("role").alias("role"), own("text").alias("text"), (F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.where("fault > 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("col")


def structure_rows(conversations: DataFrame) -> DataFrame:
    """A row for every conv_id of the table: its faults after the damage, and the repair."""
    rows = damaged(conversations)
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for name, found in (("gap_of", turn_gaps(rows)), ("repair_of", repair_reports(rows))):
        out = out.join(found.withColumnRenamed("conv_id", name), F.col("conv_id").eqNullSafe(F.col(name)), "left").drop(name)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS)]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
