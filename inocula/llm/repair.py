r"""Repair of conversation structure by iterative-deepening A*.

A conversation is in order if the initials of its roles read
``(s?(ua)+)?``: perhaps a system turn, then user and assistant in turn.  Edits
of a turn, with the letters that the audit shows:

K  keep, costs 0                 D  delete, costs 2
R  give it the role user or assistant, costs 1
I  insert an empty turn of user or assistant, costs 5

Blank and duplicate turns must be deleted; a truncated turn that stays costs
5 more.  The cheapest edits win, of equally cheap ones the audit that is least
in ASCII order.

Search.  What matters of the turns already edited is the last role alone, so a
search state is (next turn, last role).  A depth-first search tries the edits in
ASCII order under a cost bound, with what the turns left must cost at least as
heuristic; the bound rises by one until a path is accepted, and the first
accepted path is the answer.  A table holds the budget with which a state has
failed, so no state is searched twice with as little.

Scale.  Turns are sorted by range, so a conversation of any length spreads over
tasks, and are searched in blocks of ``BLOCK`` turns: for each role before the
block and after it the cheapest, least audit.  Per conversation those tables are
combined from the end (costs to go), and read off from the start.  Inserts stand
before a turn of their block, those at the very end are added last; two
different audits of a block are then never one the other's beginning, so
comparing block by block finds the least whole audit.  A block's table has at
most 16 entries, so a conversation of a million turns is combined from 31,250
small rows.  Equal blocks are searched once per task.

Defined results: a null role or text counts as one space, so a null text is
blank; turns are ordered by turn (nulls first), then role, then text; of equal
(role, text) the first is no duplicate; null conversation ids are one
conversation; turns need no numbers and gaps are no fault here; an empty table
gives empty results.  Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, values

BLOCK = 32
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5  # costs
SPACES = "\t\n\x0b\x0c\r "

# last role -> what may follow as it is, and what a made turn becomes (initials)
KEPT = {"": "su", "s": "u", "a": "u", "u": "a"}
MADE = {"": "u", "s": "u", "a": "u", "u": "a"}
ROLE = {"u": "user", "a": "assistant"}
TRAILING = {"": "", "a": "", "u": "I", "s": "II"}  # inserts that end a conversation in order


# ---- one block -----------------------------------------------------------------


def search(turns: str, start: str, end: str) -> tuple[int, str] | None:
    """(cost, audit) from the role ``start`` to the role ``end``, or None.

    Two characters a turn: its initial, and its fault ('x' must go, 't' cut
    off, '-' none).  No inserts after the last turn.
    """
    rows = [(turns[i], turns[i + 1]) for i in range(0, len(turns), 2)]
    n = len(rows)
    if (end == "" and start) or (end == "s" and not (start == "s" or start == "" and any(r == ("s", f) for r in rows for f in "-t"))):
        return None
    least = [0] * (n + 1)  # every turn at fault costs two at least: deleting is the cheapest
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (DELETE if rows[i][1] != "-" else 0)
    failed: dict[tuple[int, str], int] = {}

    def edit(at: int, last: str, budget: int) -> str | None:
        if at == n:
            return "" if last == end else None
        if budget < least[at] or budget <= failed.get((at, last), -1):
            return None
        initial, fault = rows[at]
        rest = edit(at + 1, last, budget - DELETE) if budget >= DELETE else None
        if rest is not None:
            return "D" + rest
        if budget >= INSERT and (rest := edit(at, MADE[last], budget - INSERT)) is not None:
            return "I" + rest
        if fault != "x":
            stays = CUT_OFF if fault == "t" else 0
            if initial in KEPT[last] and budget >= stays and (rest := edit(at + 1, initial, budget - stays)) is not None:
                return "K" + rest
            stays += REROLE
            if budget >= stays and (rest := edit(at + 1, MADE[last], budget - stays)) is not None:
                return "R" + rest
        failed[at, last] = max(budget, failed.get((at, last), -1))
        return None

    for bound in range(least[0], DELETE * n + 2 * INSERT + 1):
        failed.clear()
        audit = edit(0, start, bound)
        if audit is not None:
            return bound, audit
    return None


@lru_cache(maxsize=1 << 16)
def block_table(turns: str) -> tuple[tuple[str, str, int, str], ...]:
    """(role before, role after, cost, audit), by audit for each role before."""
    found = [(a, b, *r) for a in MADE for b in MADE if (r := search(turns, a, b))]
    return tuple(sorted(found, key=lambda e: (e[0], e[3])))


# ---- whole conversations ---------------------------------------------------------


def choose(tables: list[list[tuple[str, str, int, str]]]) -> tuple[int, list[tuple[str, str]]]:
    """Cost, and (role before, audit) for each block, of the best way through a conversation's block tables."""
    to_go: list[dict[str, int]] = [{s: INSERT * len(t) for s, t in TRAILING.items()}]
    for table in reversed(tables):
        best: dict[str, int] = {}
        for a, b, cost, _ in table:
            if b in to_go[-1]:
                best[a] = min(best.get(a, cost + to_go[-1][b]), cost + to_go[-1][b])
        to_go.append(best)
    to_go.reverse()
    last, out = "", []
    for k, table in enumerate(tables):
        # entries come in the order of their audits
        _, after, _, audit = next(e for e in table if e[0] == last and e[1] in to_go[k + 1] and e[2] + to_go[k + 1][e[1]] == to_go[k][last])
        out.append((last, audit))
        last = after
    if out:
        out[-1] = (out[-1][0], out[-1][1] + TRAILING[last])
    return to_go[0][""], out


def faults(text: Column, role: Column, conv: Column, turn: Column) -> tuple[Column, Column]:
    """('blank', 'duplicate', 'truncated' or null; how often role and text were seen up to the turn)."""
    nth = F.row_number().over(Window.partitionBy(conv, role, text).orderBy(turn.asc_nulls_first()))
    bare = F.rtrim(text, F.lit(SPACES))
    whole = F.substring(bare, -1, 1).isin(".", "!", "?")
    return F.when(bare == "", "blank").when(nth > 1, "duplicate").when(~whole, "truncated"), nth


def marked_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, fault, seen) of every turn, stored."""
    plain = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    fault, seen = faults(F.col("text"), F.col("role"), F.col("conv"), F.col("turn"))
    return stored(plain.withColumns({"seen": seen}).withColumn("fault", fault), "turns")


def in_blocks(marked: DataFrame) -> DataFrame:
    """The turns in order with (part, block, nth), and a row per block with its table, stored.

    ``block`` numbers the blocks of a task, so (part, block) names one; blocks
    of a conversation follow each other by it.
    """
    by = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("seen")]
    kinds = {f.name: f.dataType.simpleString() for f in marked.schema}
    entry = pa.struct([("before", pa.string()), ("after", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
    schema = (
        f"conv {kinds['conv']}, role string, text string, part int, block int, nth int, initials string, "
        "table array<struct<before:string,after:string,cost:bigint,audit:string>>"
    )
    names = ["conv", "role", "text", "part", "block", "nth", "initials", "table"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, held, own = TaskContext.get().partitionId(), -1, [], object()
        done: list[tuple] = []  # (conv, block, symbols) of blocks that ended
        conv_type = None

        def tables() -> pa.RecordBatch:
            columns = [
                pa.array([c for c, _, _ in done], conv_type), pa.nulls(len(done), pa.string()), pa.nulls(len(done), pa.string()),
                pa.array([part] * len(done), pa.int32()), pa.array([k for _, k, _ in done], pa.int32()), pa.nulls(len(done), pa.int32()),
                pa.array([s[::2] for _, _, s in done], pa.string()),
                pa.array([[dict(zip(("before", "after", "cost", "audit"), e, strict=True)) for e in block_table(s)] for _, _, s in done], pa.list_(entry)),
            ]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            conv_type = b.column(0).type
            blocks, nths = [], []
            for conv, symbol in zip(values(b.column(0)), values(b.column(3)), strict=True):
                if conv != own or len(held) == BLOCK:
                    if held:
                        done.append((own, block, "".join(held)))
                    held, own, block = [], conv, block + 1
                blocks.append(block)
                nths.append(len(held))
                held.append(symbol)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:3], pa.array([part] * n, pa.int32()), pa.array(blocks, pa.int32()), pa.array(nths, pa.int32()),
                    pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(entry)),
                ],
                names=names,
            )
            if done:
                yield tables()
        if held:
            done.append((own, block, "".join(held)))
            yield tables()

    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("-")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", "t").otherwise("-")
    ordered = marked.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(ordered.select("conv", "role", "text", F.concat(initial, code).alias("symbol")).mapInArrow(run, schema), "blocks")


EDITS = "array<struct<seq:int,edit:string,nth:int,role:string>>"


def plan_edits(blocks: DataFrame) -> DataFrame:
    """(conv, part, block, cost, illegal, audit, edits) of every block.

    ``cost`` is the whole conversation's, on its first block, else 0; ``illegal``
    the pairs of neighbouring roles that are not su, ua or au.
    """
    tables = blocks.filter("table is not null").select("conv", "part", "block", "initials", "table")
    kind = tables.schema["conv"].dataType.simpleString()
    names = ["conv", "part", "block", "cost", "illegal", "audit", "edits"]
    edit = pa.struct([("seq", pa.int32()), ("edit", pa.string()), ("nth", pa.int32()), ("role", pa.string())])

    def combine(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["block"]))
        cost, ways = choose([[(e["before"], e["after"], e["cost"], e["audit"]) for e in r["table"]] for r in rows])
        out, before = [], ""
        for k, (r, (last, audit)) in enumerate(zip(rows, ways, strict=True)):
            pairs = before + r["initials"]
            illegal = sum(pairs[i : i + 2] not in ("su", "ua", "au") for i in range(len(pairs) - 1))
            before = r["initials"][-1:]
            edits, at = [], 0
            for seq, e in enumerate(audit):
                made = MADE[last] if e in "IR" else None
                edits.append({"seq": seq, "edit": e, "nth": None if e == "I" else at, "role": ROLE.get(made)})
                last = made or (r["initials"][at] if e == "K" else last)
                at += e != "I"
            out.append((r["conv"], r["part"], r["block"], 0 if k else cost, illegal, audit, edits))
        types = [group.schema.field("conv").type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(edit)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = f"conv {kind}, part int, block int, cost long, illegal long, audit string, edits {EDITS}"
    return stored(tables.groupBy("conv").applyInArrow(combine, schema), "edits")


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(edited turns, report).

    Edited turns: ``conv_col``, place (orders the turns of a conversation), edit,
    role, text; deleted turns are there with edit D.  Report: ``conv_col``,
    blank, duplicate, truncated, illegal, cost, audit of every conversation.
    """
    marked = marked_turns(turns, conv_col, turn_col, role_col, text_col)
    blocks = in_blocks(marked)
    plan = plan_edits(blocks)
    place = F.shiftleft(F.col("part").cast("long"), 43) + F.shiftleft(F.col("block").cast("long"), 11)
    each = plan.select("conv", "part", "block", F.explode("edits").alias("e")).select("conv", "part", "block", "e.seq", "e.edit", "e.nth", F.col("e.role").alias("made"))
    texts = blocks.filter("nth is not null").select("part", "block", "nth", "role", "text")
    edited = each.join(texts, ["part", "block", "nth"], "left").select(
        F.col("conv").alias(conv_col),
        (place + F.col("seq")).alias("place"),
        "edit",
        F.coalesce("made", "role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    count = lambda kind: F.count(F.when(F.col("fault") == kind, 1))
    seen = marked.groupBy("conv").agg(*[count(k).alias(k) for k in ("blank", "duplicate", "truncated")])
    audits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "block", "audit"))), lambda x: x.audit), "")
    best = plan.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audits.alias("audit"))
    report = seen.join(best.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).drop("c").withColumnRenamed("conv", conv_col)
    return edited, report
