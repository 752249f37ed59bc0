"""Conversation structure repair: cheapest edits as a shortest path through tight arcs.

A conversation's rows and the four states of its grammar - nothing yet, after the system turn,
after a user turn, after an assistant turn - make an acyclic graph: arcs keep, rerole or delete a row,
or insert a turn. Minimum costs from the front and to the end tell which arcs lie on a
cheapest path: those whose front cost, own cost and end cost add up to the total. The set of
states reached so far then moves along tight arcs by the least letter that any of them allows.

A conversation reaches the search as one letter for each row. Texts are only streamed, in order:
a conversation of any length needs the memory of its letters. Its digest is of all its text in
order, which one task must read, whatever is done before.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_batches, slices

INSERT = REROLE = TRUNCATED = 3
DELETE = 4
#: States, and to which of them a letter leads: a kept role by its initial, a written role alone.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WRITTEN = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
NONE = 1 << 20
#: Letters of a row: x must go; s, u, a and o are its role's initial, in upper case if truncated.
ROWS_OF_BLOCK = 4096
SPACES = " \t\n\x0b\f\r"


@lru_cache(maxsize=1024)
def arcs(code: str) -> tuple:
    """(letter, cost, from, to) of what can be done with a row."""
    out = [("D", DELETE, q, q) for q in range(4)]
    if code != "x":
        more = TRUNCATED if code.isupper() else 0
        out += [("K", more, q, KEPT[q, code.lower()]) for q in range(4) if (q, code.lower()) in KEPT]
        out += [("R", REROLE + more, q, WRITTEN[q]) for q in range(4)]
    return tuple(out)


def relative(costs: list[int]) -> tuple[int, tuple]:
    low = min(costs)
    return low, tuple(c - low if c < NONE else NONE for c in costs)


@lru_cache(maxsize=4096)
def closed(costs: tuple, front: bool) -> tuple[int, tuple]:
    """Costs when turns may be inserted at this point, as a base and what is above it."""
    out = list(costs)
    for _ in range(3):
        for q in range(4):
            a, b = (WRITTEN[q], q) if front else (q, WRITTEN[q])
            out[a] = min(out[a], out[b] + INSERT)
    return relative(out)


@lru_cache(maxsize=4096)
def moved(code: str, costs: tuple, front: bool) -> tuple[int, tuple]:
    """Costs on the other side of a row."""
    out = [NONE] * 4
    for _, cost, a, b in arcs(code):
        if front:
            out[b] = min(out[b], costs[a] + cost)
        else:
            out[a] = min(out[a], costs[b] + cost)
    return closed(tuple(out), front)


def passed(code: str, costs: tuple[int, tuple], front: bool) -> tuple[int, tuple]:
    low, rest = moved(code, costs[1], front)
    return costs[0] + low, rest


def cheapest_edits(codes: str) -> tuple[int, str]:
    """Cost and letters of the cheapest edits; of several the least in ASCII order.

    End costs are kept at the ends of blocks only and made again as the front comes to a block.
    """
    back = closed((0, NONE, NONE, 0), False)
    ends = [back]
    heads = range(0, len(codes), ROWS_OF_BLOCK)
    for at in reversed(heads):
        for code in reversed(codes[at : at + ROWS_OF_BLOCK]):
            back = passed(code, back, False)
        ends.append(back)
    total = back[0] + back[1][START]
    front = closed((0, NONE, NONE, NONE), True)
    states, letters = {START}, []

    def follow(states: set, front: tuple, options, here: tuple, after: tuple | None) -> tuple[str, set] | None:
        """The least letter that a tight arc out of ``states`` has, and all states it leads to."""
        best, reached = None, set()
        for letter, cost, a, b in options:
            back = here if letter == "I" else after
            if a in states and front[0] + front[1][a] + cost + back[0] + back[1][b] == total:
                if best is None or letter < best:
                    best, reached = letter, {b}
                elif letter == best:
                    reached.add(b)
        return (best, reached) if best else None

    inserts = tuple(("I", INSERT, q, WRITTEN[q]) for q in range(4))
    for n, at in enumerate(heads):
        block = codes[at : at + ROWS_OF_BLOCK]
        backs = [ends[len(ends) - 2 - n]]
        for code in reversed(block):
            backs.append(passed(code, backs[-1], False))
        for i, code in enumerate(block):
            here, after = backs[len(block) - i], backs[len(block) - i - 1]
            while True:
                letter, states = follow(states, front, inserts + arcs(code), here, after)
                letters.append(letter)
                if letter != "I":
                    break
            front = passed(code, front, True)
    while step := follow(states, front, inserts, ends[0], None):
        letters.append(step[0])
        states = step[1]
    return total, "".join(letters)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults put in by crc32(``conv_id:turn``) % 20: 0
    drops a row, 1 empties its text, 2 takes its full stops and marks, 3 repeats it, 4 makes it the
    user's. Null roles and texts, and null parts of that key, are one space."""
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(role).alias("role"), F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), fault.alias("fault"))
    return rows.filter("fault <> 0").select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("col")


def part(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def checked_turns(turns: DataFrame) -> DataFrame:
    """Rows in order, each with its place, faults and letter.

    Rows of a conversation are ordered by turn (nulls first), then role and text. Of a row's faults
    the first counts: blank (white space only), duplicate (a row before has its role and text),
    truncated (its last mark is not one of .!?). ``illegal`` is a pair of neighbours whose
    initials can't follow each other, ``counted`` a turn that no row before has.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "seen")
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    blank, seen = last == "", F.col("seen") > 1
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    before = F.lag(initial).over(order)
    rows = rows.repartition("conv_id").withColumn("seen", F.row_number().over(same))
    return rows.select(
        "conv_id", "turn", "role", "text", F.row_number().over(order).cast("long").alias("place"),
        blank.alias("blank"), (~blank & seen).alias("duplicate"), (~blank & ~seen & ~last.isin(".", "!", "?")).alias("truncated"),
        F.coalesce(~F.concat(before, initial).isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))).alias("counted"),
        F.when(blank | seen, "x").when(last.isin(".", "!", "?"), kind).otherwise(F.upper(kind)).alias("code"),
    )


def planned_edits(checked: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation."""
    letters = checked.groupBy("conv_id", F.floor(F.col("place") / ROWS_OF_BLOCK).alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("rows"))
    letters = letters.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", F.array_join("rows.code", "").alias("codes")))).alias("parts"))
    letters = letters.select("conv_id", F.array_join("parts.codes", "").alias("text"))

    def plan(batches):
        for whole in batches:
            for batch in slices(whole):
                found = [cheapest_edits(codes) for codes in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["edited", "cost", "audit"])

    edits = letters.mapInArrow(plan, "edited long, cost long, audit string")
    counts = checked.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("counted"), F.lit(0)).alias("gaps"), *(F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal"))
    )
    return counts.join(edits, F.col("conv_id").eqNullSafe(F.col("edited"))).drop("edited")


def edited_turns(checked: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, edit, role, text): the rows of repaired conversations, in order within a task, each
    conversation in one. The letters of a conversation come before its rows, which are streamed."""
    heads = plans.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = heads.unionByName(checked.select("conv_id", "place", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def edit(batches):
        audit, at, state = "", 0, START
        out: list[list] = [[], [], [], []]

        def write(conv, letter: str, role: str, text: str) -> None:
            for column, value in zip(out, (conv, letter, role, text)):
                column.append(value)

        def inserts(conv) -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = WRITTEN[state]
                write(conv, "I", ROLES[state], "")
                at += 1

        for whole in batches:
            for batch in slices(whole):
                for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                    if place == 0:
                        audit, at, state = text, 0, START
                    else:
                        letter = audit[at]
                        at += 1
                        if letter == "R":
                            state = WRITTEN[state]
                            write(conv, letter, ROLES[state], text)
                        elif letter == "K":
                            state = KEPT[state, role[:1]]
                            write(conv, letter, role, text)
                    inserts(conv)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:])], ["conv_id", "edit", "role", "text"])
                for column in out:
                    column.clear()

    return rows.mapInArrow(edit, "conv_id long, edit string, role string, text string")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The turns of all conversations after the cheapest edits: (conv_id, edit, role, text).

    Null roles and texts are one space; rows of a null conv_id are one conversation; rows without
    a turn come first; repeated rows are duplicates and go; a conversation whose rows all go, and
    an empty table, give no rows; extra columns are not looked at.
    """
    small_batches(turns.sparkSession)
    checked = checkpoint(checked_turns(turns))
    return edited_turns(checked, checkpoint(planned_edits(checked)))


def repair_digests(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation, and for each conv_id of ``ids``: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256 of ``role:text`` lines. One without rows has
    zeros and an empty audit. Nulls, ties and repeats are as in ``repaired_turns``."""
    small_batches(turns.sparkSession)
    checked = checkpoint(checked_turns(turns))
    plans = checkpoint(planned_edits(checked))

    def digest(batches):
        conv, held = None, None
        for whole in batches:
            for batch in slices(whole):
                ids, sums = [], []
                for new, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                    if held is None or new != conv:
                        if held is not None:
                            ids.append(conv)
                            sums.append(held.hexdigest())
                        conv, held = new, hashlib.sha256()
                    else:
                        held.update(b"\n")
                    held.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.string())], ["repaired", "repaired_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([held.hexdigest()], pa.string())], ["repaired", "repaired_sha256"])

    digests = edited_turns(checked, plans).mapInArrow(digest, "repaired long, repaired_sha256 string")
    found = plans.join(digests, F.col("conv_id").eqNullSafe(F.col("repaired")), "left").drop("repaired")
    if ids is not None:
        every = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        found = every.join(found.withColumnRenamed("conv_id", "found"), F.col("conv_id").eqNullSafe(F.col("found")), "left").drop("found")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select("conv_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
