"""Nothing of the work is left out: templates beyond the voted ones, labels beyond a sample."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inocula.llm import linededup, queries, toxicity
from inocula.llm.common import importable

NAMES = [a + b for a in "abcdefghij" for b in "klmnopqrst"]


@pytest.fixture(scope="module")
def session(spark):
    importable(spark)
    return spark


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.execute(queries.OP4_SQL).fetchall())


def told(df):
    cut = linededup.drop_recurring_lines(df)
    md5 = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return sorted(tuple(r) for r in cut.select("doc_id", "n_lines", "n_dropped", md5).collect())


def test_a_leaf_holds_any_number_of_templates(session):
    kinds = ["visit", "friend", "help", "note", "bread", "walk"]  # each with words of its own behind one lead
    texts = [f"we thank you for {' '.join(f'{kind}{j}' for j in range(8))} {NAMES[7 * k + i]}" for k, kind in enumerate(kinds) for i in range(5)]
    rows = [(i, f"{t}\nown {NAMES[i]} line {NAMES[i + 1]} here") for i, t in enumerate(texts)]
    df = session.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.drop_recurring_lines(df).collect()}
    assert got == {i: int(i % 5 != 0) for i in range(len(rows))}
    assert told(df) == oracle(rows)


@pytest.mark.parametrize("fields", [3, 4, 6, 8])
def test_what_the_votes_leave_is_grouped_turn_by_turn(session, fields):
    """Against the turns written out, on lines that share patterns in many ways."""
    rng = random.Random(fields)
    lines = sorted({tuple(rng.choices(NAMES[:4], k=fields)) for _ in range(60)})
    weight = {x: rng.randint(1, 4) for x in lines}
    rows, n = [], 0
    for x in lines:
        for _ in range(weight[x]):
            rows.append((n, f"to all of {' '.join(x)}\nnumber {NAMES[n % 100]} of {NAMES[n // 100]} {'x' * n}"))
            n += 1
    df = session.createDataFrame(rows, "doc_id long, text string")
    parsed = linededup.parse_lines(df, "text", "doc_id", linededup.LEAD).filter("pos = 0")
    f = [f"f{j}" for j in range(linededup.FIELDS)]
    left = parsed.groupBy("line", "leaf", "n_tokens", *f).agg(F.count("*").alias("weight"))
    got = defaultdict(set)
    for r in linededup.group_rest(left, linededup.MIN_EQUAL, linededup.LEAD).collect():
        got[r["template"]].add(r["line"])

    at = {r["line"]: (r["weight"], [r[c] for c in f]) for r in left.collect()}
    cuts = linededup.choices(fields, linededup.MIN_EQUAL)
    own = {line: [",".join(f"{j}:{v[j]}" for j in cut) for cut in cuts] for line, (_, v) in at.items()}
    texts = sorted({p for ps in own.values() for p in ps})
    keys = {r["t"]: r["k"] for r in session.createDataFrame([(t,) for t in texts], "t string").select("t", linededup.key60(F.col("t")).alias("k")).collect()}
    want, rest = [], dict(own)
    while True:
        lines_of, total = Counter(p for ps in rest.values() for p in ps), Counter()
        for line, ps in rest.items():
            total.update(dict.fromkeys(ps, at[line][0]))
        named = defaultdict(set)
        for line, ps in rest.items():
            shared = [(total[p], keys[p], p) for p in ps if lines_of[p] > 1]
            if shared:
                named[max(shared)[2]].add(line)
        taken = [g for g in named.values() if len(g) > 1]
        if not taken:
            break
        want += taken
        rest = {line: ps for line, ps in rest.items() if not any(line in g for g in taken)}
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and (want or fields == 3)
    assert told(df) == oracle(rows)


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & (toxicity.BUCKETS - 2)


def test_every_labelled_text_is_learnt_whole(session):
    """Words that few of many labelled rows hold, and words deep in long texts, get embeddings."""
    rng = random.Random(5)
    rare, deep = [f"{x}rare" for x in NAMES[:20]], [f"{x}deep" for x in NAMES[20:25]]
    rows = []
    for i in range(16_000):
        t = rng.choices(NAMES, k=4)
        if i % 2:
            t.append(rng.choice(["grobian", "schuft", "lump"]))
        if i < 12 * len(rare):
            t.append(rare[i % len(rare)])
        rows.append((i, " ".join(t), "en", i % 2))
    for i in range(12 * len(deep)):
        t = rng.choices(NAMES, k=20_000)
        t[rng.randrange(20_000)] = deep[i % len(deep)]
        rows.append((20_000 + i, " ".join(t), None, 0))
    df = session.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    assert round(0.75 * len(rows) / toxicity.SHARD) > 1  # learnt in several shards
    model = toxicity.fit_toxicity(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert all(model.row[bucket(w)] for w in rare + deep)
    assert "en" in model.by_lang
    right = toxicity.score_toxicity(df, model).filter((F.col("toxicity") >= 0.5) == (F.col("toxic") == 1)).count()
    assert right > 0.99 * len(rows)


def test_the_order_of_tasks_does_not_show(session):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(NAMES[:20], k=5)) + (" lump" if i % 2 else "") + " x" * (i // 100), i % 2) for i in range(600)]
    df = session.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("lang", F.lit("en"))
    weights = []
    for n in (1, 5):
        dealt = df.repartition(n)
        kept = toxicity.labelled_rows(dealt, dealt, "text", "doc_id", "toxic", "lang")
        known = toxicity.known_buckets(kept)
        model = toxicity.start(known)
        for turn in range(2):
            model = toxicity.learn_round(kept, model, {0: 300, 1: 300}, 3, turn)
        weights.append(toxicity.flat(model))
    assert (weights[0] == weights[1]).all()
    assert (toxicity.flat(toxicity.with_weights(model, weights[0])) == weights[0]).all()


def test_the_windows_of_learning_are_those_of_scoring(monkeypatch):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 9, (n, 2), np.int32) for n in (0, 1, 2, 40, 7)]
    model = toxicity.start(np.arange(9))
    for size in (toxicity.SLICE, 3):
        monkeypatch.setattr(toxicity, "SLICE", size)
        h, ids = model.windows(docs)
        x = model.embedding[ids].sum(3)
        at = [(j * toxicity.FILTERS + f, j, w, f) for j, w in enumerate(toxicity.WIDTHS) for f in range(toxicity.FILTERS)]
        under = np.stack([np.einsum("bkd,kd->b", x[:, n, :w], model.filters[j].reshape(w, toxicity.DIM, -1)[:, :, f]) for n, j, w, f in at], 1)
        assert np.allclose(h, under + model.bias, atol=1e-5)
        assert np.allclose(np.maximum(h, 0) @ model.weight + model.offset, model.logits(docs), atol=1e-5)


def shuffle_files(session) -> set[str]:
    disk = session.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f.getName() for f in session._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if "shuffle_" in f.getName()}


def test_toxicity_leaves_no_shuffle_files(session):
    rows = [(i, " ".join(NAMES[i % 20 :]) + f" x{i}" + (" lump" if i % 2 else ""), "en", i % 2) for i in range(400)]
    df = session.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = session.conf.get(name)
    before = shuffle_files(session)
    toxicity.fit_toxicity(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert not shuffle_files(session) - before
    assert session.conf.get(name) == setting


def test_texts_without_label_are_not_shuffled(session):
    """A filter of the labelled ids stands before the join; ids that repeat, null ids and other types lose nothing."""
    docs = session.createDataFrame([(i % 900 if i < 1000 else None, f"w{i % 7}") for i in range(1010)], "doc_id long, text string")
    docs = docs.withColumn("lang", F.lit("en"))
    for kind in ("long", "int", "string"):
        marks = session.createDataFrame([(i, i % 2) for i in (3, 4, 50, 950, 3)], "doc_id long, toxic int")
        marks = marks.withColumn("doc_id", F.col("doc_id").cast(kind))
        kept = toxicity.labelled_rows(docs, marks, "text", "doc_id", "toxic", "lang")
        # ids 3, 4 and 50 twice (as i and i + 900): words of i % 7
        assert kept.count() == len({(i % 7, i % 900 % 2) for i in (3, 4, 50, 903, 904, 950)})
    left = toxicity._maybe_labelled(docs, docs.filter("doc_id < 20").select("doc_id").distinct(), "doc_id")
    assert 40 <= left.count() < 100


def test_a_shard_learns_alike_with_its_own_embeddings_alone():
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 500, (n, 2), np.int32) for n in (0, 3, 30, 80, 11)] * 20
    toxic = np.arange(100, dtype=np.float32) % 2
    whole = toxicity.start(np.arange(3, 5000))
    part, rows = toxicity.part_for(whole, docs)
    assert len(part.embedding) == len(rows) <= 498
    before = toxicity.flat(whole)
    for m in (part, whole):
        toxicity.learn(m, docs, toxic, np.ones(100, np.float32), 0)
    rest = np.delete(whole.embedding, rows, axis=0)
    assert (whole.embedding[rows] == part.embedding).all() and (rest == np.delete(before[: len(whole.embedding)], rows, axis=0)).all()
    assert (toxicity.flat(whole)[len(whole.embedding) :] == toxicity.flat(part)[len(rows) :]).all()
