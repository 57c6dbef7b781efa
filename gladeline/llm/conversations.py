"""Repair of conversation structure by depth-first branch-and-bound.

A conversation should read as an optional system turn and then pairs of user and assistant turns. Rows are kept (0),
given the role due (2), deleted (3; blank rows and repeats must go), and empty turns inserted (2); a truncated row
that stays costs 1. Wanted are the cheapest edits and, among those, the ASCII-least string of their initials.

The search walks an explicit stack of prefixes. A prefix ends in a node: rows done and role due. The incumbent (cost,
edits) cuts off a prefix whose cost and suffix bound (what the rows left cost at least from this node) exceed it, and
so does a node that was reached before by a prefix no worse; when the stack is empty, the incumbent is proved best.
Bounds that look at each row alone leave so many prefixes that 400 rows of mixed roles did not end in minutes; these
look at what is due too.

A conversation of any length is searched in blocks of ``BLOCK`` rows, from each role that can be due to each other.
The roles due at block borders are nodes too, and there alone prefixes of different blocks meet, so joining blocks
loses nothing: equally cheap edits of one stretch of rows are never prefixes of each other, so their order decides.
Blocks are joined ``PIECE`` rows at a time inside a task; the pieces of a longer conversation (one slim row per
``PIECE`` rows, without texts and edits) are joined in one task of their own.

Rows are put in order by one range shuffle, which also splits a conversation that holds much of the table; repeats
are found by a grouped digest, not a window. Only the digest of a repaired conversation, a single hash over all of
its text, streams through one task.

Defined cases: null roles and texts are one space; null turns come first; rows of equal turn go by the SHA-256 of
role and text; a null ``conv_id`` is a conversation of its own; roles other than user, assistant and system (by their
initials, case counts) must be replaced or deleted; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gladeline.llm.tables import stored
from gladeline.operators.joins import join_to_unique

#: Rows of one search, and rows whose searches one task joins.
BLOCK, PIECE = 1024, 1 << 16
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
ROLE = {"u": "user", "a": "assistant"}

#: What is due: start (system or user), user after system, assistant after user, user after assistant.
START, FIRST, ANSWER, NEXT = range(4)
#: The role an inserted or replaced turn gets, and what is due after it.
DUE = {START: "u", FIRST: "u", ANSWER: "a", NEXT: "u"}
AFTER = {START: ANSWER, FIRST: ANSWER, ANSWER: NEXT, NEXT: ANSWER}
#: What still has to be inserted where the rows end.
TAIL = {START: "", FIRST: "ua", ANSWER: "a", NEXT: ""}


def damage(said: DataFrame) -> DataFrame:
    """Rows harmed by ``crc32(conv_id:turn) % 20``: 0 drops, 1 empties, 2 loses ``.!?``, 3 repeats, 4 becomes user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return said.filter(kind != 0).select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _steps(code: str, due: int) -> list[tuple[str, int, int]]:
    """The edits of one row where ``due`` is due: initial, cost, what is due next."""
    out = [("D", DELETE, due)]
    if code == "-":
        return out
    more, initial = (TRUNCATED, code.lower()) if code.isupper() else (0, code)
    if initial == DUE[due]:
        out.append(("K", more, AFTER[due]))
    elif initial == "s" and due == START:
        out.append(("K", more, FIRST))
    out.append(("R", REROLE + more, AFTER[due]))
    return out


_NEVER = 1 << 60


def suffix_bounds(codes: str, goal: int | None) -> list[list[int]]:
    """What the rows from each row on cost at least, by what is due before it; the order of edits plays no part."""
    last = [INSERT * len(TAIL[due]) if goal is None else 0 if due == goal else _NEVER for due in range(4)]
    bounds = [last]
    for code in reversed(codes):
        done = [min(more + last[after] for _, more, after in _steps(code, due)) for due in range(4)]
        # one or two insertions before the row bring up every role that can be due
        last = [min(done[due], INSERT + done[AFTER[due]], 2 * INSERT + done[AFTER[AFTER[due]]]) for due in range(4)]
        bounds.append(last)
    return bounds[::-1]


def search(codes: str, start: int, goal: int | None) -> tuple[int, str] | None:
    """The best (cost, edits) from ``start`` through all rows to ``goal`` due, or to a whole conversation if None.

    A row's code is the initial of its role (x: none of s, u, a), in capitals if truncated, or ``-`` if it must go.
    """
    n, bounds = len(codes), suffix_bounds(codes, goal)
    best = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, due, cost, edits = stack.pop()
        least = cost + bounds[i][due]
        if least >= _NEVER or (best is not None and (least, edits) > (best[0], best[1][: len(edits)])):
            continue
        seen = table.get((i, due))
        if seen is not None and seen <= (cost, edits):
            continue
        table[i, due] = cost, edits
        if i == n:
            tail = TAIL[due] if goal is None else ""
            found = cost + INSERT * len(tail), edits + "I" * len(tail)
            best = found if best is None else min(best, found)
            continue
        steps = [(i + 1, after, cost + more, edits + edit) for edit, more, after in _steps(codes[i], due)]
        steps.append((i, AFTER[due], cost + INSERT, edits + "I"))
        # the step with the least bound is taken first, the least initial among equals
        stack.extend(sorted(steps, key=lambda s: (s[2] + bounds[s[0]][s[1]], s[3]), reverse=True))
    return best


Best = dict[int, tuple[int, str]]


def search_piece(codes: str, start: int, last: bool, block: int = BLOCK) -> Best:
    """The best (cost, edits) by what is due after the rows; ``START`` stands for the whole if it is the ``last`` piece."""
    found: Best = {start: (0, "")}
    for at in range(0, max(1, len(codes)), block):
        part = codes[at : at + block]
        ends = last and at + block >= len(codes)
        new: Best = {}
        for due, (cost, edits) in found.items():
            for goal in (None,) if ends else range(4):
                got = search(part, due, goal)
                if got is not None:
                    key, option = START if goal is None else goal, (cost + got[0], edits + got[1])
                    new[key] = min(new.get(key, option), option)
        found = new
    return found


@dataclass
class Structured:
    """``rows``: all rows in order under ``at``; ``pieces``: their codes; ``facts``: counts per conversation."""

    rows: DataFrame
    pieces: DataFrame
    facts: DataFrame


def _key(conv: Column) -> Column:
    """``conv_id`` as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def structure(said: DataFrame) -> Structured:
    """Put rows (``conv_id, turn, role, text``) in order and find their faults."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = said.select("conv_id", _key(F.col("conv_id")).alias("conv"), "turn", role.alias("role"), text.alias("text"))
    spoken = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.withColumn("spoken", F.unhex(F.sha2(spoken.cast("binary"), 256))).withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("spoken"), F.col("tie")]
    # numbers ascend through a partition and from one to the next; rows of a conversation have no gaps inside one
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()))

    kept = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    slim = rows.select(
        "conv", "at", "spoken", "turn",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (kept == "").alias("blank"),
        ((kept != "") & ~F.substring(kept, -1, 1).isin(".", "!", "?")).alias("unended"),
    )
    firsts = slim.groupBy("conv", "spoken").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    slim = join_to_unique(slim, firsts, ["conv", "spoken"], "left")
    repeat = ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    truncated = F.col("unended") & ~repeat
    code = F.when(F.col("blank") | repeat, "-").when(truncated, F.upper("initial")).otherwise(F.col("initial"))
    row = F.struct("at", F.col("initial").alias("i"), code.alias("c"))
    pieces = (
        slim.withColumn("repeat", repeat).withColumn("truncated", truncated)
        .groupBy("conv", F.shiftright("at", PIECE.bit_length() - 1).alias("piece"))
        .agg(
            F.sort_array(F.collect_list(row)).alias("rows"),
            *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "repeat", "truncated")],
        )
    )
    pieces = pieces.select(
        "conv", "piece", F.col("rows")[0]["at"].alias("first_at"), "blank", "repeat", "truncated",
        F.array_join(F.col("rows")["i"], "").alias("initials"), F.array_join(F.col("rows")["c"], "").alias("codes"),
    )
    turns = slim.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    pieces = stored(pieces)
    spans = pieces.groupBy("conv").agg(
        F.min("piece").alias("first_piece"), F.max("piece").alias("last_piece"),
        *[F.sum(c).alias(c) for c in ("blank", "repeat", "truncated")],
    )
    facts = spans.join(gaps, "conv")
    placed = join_to_unique(pieces.drop("blank", "repeat", "truncated"), spans.select("conv", "first_piece", "last_piece"), ["conv"])
    return Structured(rows, placed, facts)


_LEGAL = ("su", "ua", "au")
_SEARCHED = (
    "conv string, piece long, first_at long, initials string, illegal long, "
    "found array<struct<start:int,goal:int,cost:long,order:int,edits:string>>"
)


def _search_batch(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            first, last = r["piece"] == r["first_piece"], r["piece"] == r["last_piece"]
            found, initials = [], r["initials"]
            for start in (START,) if first else range(4):
                got = sorted(search_piece(r["codes"], start, last).items(), key=lambda g: g[1][1])
                found += [{"start": start, "goal": goal, "cost": c, "order": k, "edits": e} for k, (goal, (c, e)) in enumerate(got)]
            illegal = sum(initials[i : i + 2] not in _LEGAL for i in range(len(initials) - 1))
            out.append({
                "conv": r["conv"], "piece": r["piece"], "first_at": r["first_at"], "initials": initials,
                "illegal": illegal, "found": found,
            })
        yield pa.RecordBatch.from_pylist(out, schema=_arrow_schema())


def _arrow_schema() -> pa.Schema:
    option = pa.struct([("start", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()), ("order", pa.int32()), ("edits", pa.string())])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(option)]
    names = ["conv", "piece", "first_at", "initials", "illegal", "found"]
    return pa.schema(list(zip(names, kinds)))


def _join_pieces(pieces: pa.Table) -> pa.Table:
    """For the pieces of one conversation: what is due before and after each on the best way through all of them."""
    rows = sorted(pieces.to_pylist(), key=lambda r: r["piece"])
    # from the back: the least cost from each role due to the end, and the choice; equals go by the order of edits,
    # which differ before either ends
    rest: dict[int, int] = {START: 0}
    choices = []
    for r in reversed(rows):
        options: dict[int, list] = {}
        for f in r["found"]:
            if f["goal"] in rest:
                options.setdefault(f["start"], []).append((f["cost"] + rest[f["goal"]], f["order"], f["goal"]))
        best = {start: min(o) for start, o in options.items()}
        rest = {start: b[0] for start, b in best.items()}
        choices.append({start: b[2] for start, b in best.items()})
    out, due = [], START
    crossed = [rows[i]["ends"][1] + rows[i + 1]["ends"][0] for i in range(len(rows) - 1)] + ["su"]
    for r, choice, pair in zip(rows, reversed(choices), crossed):
        out.append({"conv": r["conv"], "piece": r["piece"], "start": due, "goal": choice[due], "crossed": int(pair not in _LEGAL)})
        due = choice[due]
    kinds = [("conv", pa.string()), ("piece", pa.int64()), ("start", pa.int32()), ("goal", pa.int32()), ("crossed", pa.int64())]
    return pa.Table.from_pylist(out, schema=pa.schema(kinds))


def search_all(found: Structured) -> DataFrame:
    """``conv, piece, first_at, initials, start, illegal, cost, edits``: the chosen edits of every piece, stored."""
    searched = stored(found.pieces.mapInArrow(_search_batch, _SEARCHED))
    bare = F.transform("found", lambda f: f.dropFields("edits"))
    single = F.size("found") == 1
    # the only piece of a conversation has one way from start to end; of the others only slim rows meet in a task
    several = searched.filter(~single).select("conv").distinct()
    some = searched.join(several, "conv", "left_semi").select(
        "conv", "piece", F.concat(F.left("initials", F.lit(1)), F.right("initials", F.lit(1))).alias("ends"), bare.alias("found")
    )
    chosen = some.groupBy("conv").applyInArrow(_join_pieces, "conv string, piece long, start int, goal int, crossed long")
    out = searched.join(chosen, ["conv", "piece"], "left")
    way = F.filter("found", lambda f: F.col("start").isNull() | ((f["start"] == F.col("start")) & (f["goal"] == F.col("goal"))))[0]
    return stored(out.withColumn("way", way).select(
        "conv", "piece", "first_at", "initials", F.coalesce("start", F.lit(START)).alias("start"),
        (F.col("illegal") + F.coalesce("crossed", F.lit(0))).alias("illegal"),
        F.col("way.cost").alias("cost"), F.col("way.edits").alias("edits"),
    ))


def _spell_out(batches):
    """Edits but deletions, as rows: where they stand, the row they concern (none for insertions), the role they give."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            row, place, due = 0, 0, r["start"]
            for edit in r["edits"]:
                at, kept = r["first_at"] + row, r["initials"][row : row + 1]
                if edit != "D":
                    given = None if edit == "K" else ROLE[DUE[due]]
                    out.append({"conv": r["conv"], "at": at, "place": place, "edit": edit, "given": given, "row": None if edit == "I" else at})
                    due = FIRST if edit == "K" and kept == "s" else AFTER[due]
                row, place = (row, place + 1) if edit == "I" else (row + 1, 0)
        kinds = [("conv", pa.string()), ("at", pa.int64()), ("place", pa.int32()), ("edit", pa.string()), ("given", pa.string()), ("row", pa.int64())]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))


def repaired_rows(found: Structured, searched: DataFrame) -> DataFrame:
    """``conv, at, place, edit, role, text``: the rows of the repaired conversations, in order of ``at, place``."""
    edits = searched.mapInArrow(_spell_out, "conv string, at long, place int, edit string, given string, row long")
    texts = found.rows.select(F.col("at").alias("row"), "role", "text")
    return edits.hint("merge").join(texts, "row", "left").select(
        "conv", "at", "place", "edit", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def _digests(batches):
    """Digests of rows that come sorted by conversation; no conversation is held, only its running hash."""
    conv, running = None, None
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if running is not None and r["conv"] == conv:
                running.update(b"\n")
            else:
                if running is not None:
                    done.append({"conv": conv, "repaired_sha256": running.hexdigest()})
                conv, running = r["conv"], hashlib.sha256()
            running.update(f"{r['role']}:{r['text']}".encode())
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if running is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": running.hexdigest()}], schema=schema)


def digests(repaired: DataFrame) -> DataFrame:
    """``conv, repaired_sha256`` over ``role:text`` of all rows, joined by newlines."""
    ordered = repaired.select("conv", "at", "place", "role", "text").repartition("conv").sortWithinPartitions("conv", "at", "place")
    return ordered.select("conv", "role", "text").mapInArrow(_digests, "conv string, repaired_sha256 string")


def report(found: Structured, searched: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` per conversation that has rows."""
    part = F.struct("piece", "edits")
    edits = searched.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.sort_array(F.collect_list(part))["edits"], "").alias("audit"),
    )
    return found.facts.join(edits, "conv").select(
        "conv", "gaps", "blank", F.col("repeat").alias("duplicate"), "truncated", "illegal", "cost", "audit"
    )


def repair_report(original: DataFrame, said: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``original``: faults, cost and edits of its rows in ``said``, digest of the repair."""
    found = structure(said)
    searched = search_all(found)
    known = original.select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    out = known.join(report(found, searched), "conv", "left").join(digests(repaired_rows(found, searched)), "conv", "left")
    return out.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )
