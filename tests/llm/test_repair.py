"""Conversation repair against dynamic programming over all edits, and DuckDB."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest

from inocula.llm import repair
from inocula.llm.common import importable
from inocula.llm.queries import OP13_SQL, op13_conversation_repair


@pytest.fixture(scope="module")
def session(spark):
    importable(spark)
    return spark


def cheapest(rows):
    """(cost, audit, lines) of (role, text, fault): the least over all edits, turn by turn."""
    best = {"": (0, "", [])}

    def inserted(now):
        for _ in range(3):
            for last, (cost, audit, lines) in list(now.items()):
                made = repair.MADE[last]
                new = (cost + 5, audit + "I", [*lines, repair.ROLE[made] + ":"])
                now[made] = min(now.get(made, new), new)
        return now

    for role, text, fault in rows:
        after = {}
        for last, (cost, audit, lines) in inserted(dict(best)).items():
            extra = 5 if fault == "truncated" else 0
            options = [(last, (cost + 2, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                if role[:1] and role[:1] in repair.KEPT[last]:
                    options.append((role[:1], (cost + extra, audit + "K", [*lines, f"{role}:{text}"])))
                made = repair.MADE[last]
                options.append((made, (cost + extra + 1, audit + "R", [*lines, f"{repair.ROLE[made]}:{text}"])))
            for state, new in options:
                after[state] = min(after.get(state, new), new)
        best = after
    return min(way for last, way in inserted(dict(best)).items() if last in ("", "a"))


def fate(rows):
    """Rows after the contract's damage, in order."""
    out = []
    for _, turn, role, text in rows:
        conv = rows[0][0]
        told = lambda v: " " if v is None else str(v)
        f = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if f == 0:
            continue
        role, text = "user" if f == 4 else told(role), told(text)
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(turn, role, text)] * (2 if f == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def wanted(rows):
    rows = fate(rows)
    seen, marked = set(), []
    for _, role, text in rows:
        bare = text.rstrip(repair.SPACES)
        fault = "blank" if not bare.strip(repair.SPACES) else "duplicate" if (role, text) in seen else "none" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    cost, audit, lines = cheapest(marked) if marked else (0, "", [])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
    count = [sum(m[2] == k for m in marked) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def random_turns(seed, conversations, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool"]
    texts = ["Yes.", "no", "  ", "", None, "Why? \n", "a!", "b.\t", "c ", "d. "]
    rows = []
    for c in [*range(conversations), None]:
        for t in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.05 else t + (rng.randint(0, 3) if rng.random() < 0.1 else 0)
            role = ("user", "assistant")[t % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = f"turn {t}." if rng.random() < 0.7 else rng.choice(texts)
            rows.append((c, turn, role, text))
    return rows


def run(session, folder, rows):
    schema = "conv_id long, turn long, role string, text string, conv string, part int, fault string"
    df = session.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)
    df.repartition(3).write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in op13_conversation_repair(session, folder).collect()}


@pytest.mark.parametrize("seed,conversations,longest", [(1, 60, 9), (2, 6, 150)])
def test_equals_the_least_over_all_edits(session, scratch, seed, conversations, longest):
    rows = random_turns(seed, conversations, longest)
    by_conv = defaultdict(list)
    for r in rows:
        by_conv[r[0]].append(r)
    assert run(session, scratch, rows) == {c: wanted(own) for c, own in by_conv.items()}


def test_sql_states_the_same(session, scratch):
    rows = random_turns(3, 40, 12)
    mine = run(session, scratch, rows)
    con = duckdb.connect()
    con.register("conversations", pa.table({n: [r[k] for r in rows] for k, n in enumerate(("conv_id", "turn", "role", "text"))}))
    assert {r[0]: r[1:] for r in con.sql(OP13_SQL).fetchall()} == mine


def test_search_equals_the_table_of_all_edits():
    rng = random.Random(4)
    for _ in range(400):
        rows = [(rng.choice("sua-"), rng.choice("---xt")) for _ in range(rng.randint(0, 7))]
        names = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}
        faults = {"x": "blank", "t": "truncated", "-": "none"}
        cost, audit, _ = cheapest([(names[i], "", faults[f]) for i, f in rows])
        tables = [repair.block_table("".join(i + f for i, f in rows[k : k + 3])) for k in range(0, len(rows), 3)]
        got, ways = repair.choose([list(t) for t in tables])
        assert (got, "".join(a for _, a in ways)) == (cost, audit)


def test_a_conversation_over_many_tasks(session):
    """A third of all turns in one conversation: its blocks lie in several parts."""
    rows = [(7, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(6000)] + [
        (c, t, "user", "hi.") for c in range(100, 3100) for t in range(4)
    ]
    df = session.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        marked = repair.marked_turns(df, "conv_id", "turn", "role", "text")
        blocks = repair.in_blocks(marked)
        assert blocks.filter("conv = 7").select("part").distinct().count() > 1
        _, report = repair.repair_conversations(df)
    finally:
        session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    long = report.filter("conv_id = 7").first()
    assert (long["cost"], long["audit"]) == (0, "K" * 6000)


def test_edited_turns_and_empty_table(session):
    turns = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c")]
    edited, report = repair.repair_conversations(session.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    rows = sorted(edited.collect(), key=lambda r: r["place"])
    assert [(r["edit"], r["role"], r["text"]) for r in rows] == [("K", "user", "a."), ("R", "assistant", "b."), ("D", "assistant", "c")]
    assert report.first()["cost"] == 3
    empty = session.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert [f.count() for f in repair.repair_conversations(empty)] == [0, 0]
