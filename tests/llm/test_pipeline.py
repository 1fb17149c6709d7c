"""The corpus pipeline on a small corpus with planted cases, each stage against
a plain Python version of its rule on that stage's own input."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import public_tokenizers as vocabularies
import pytest

import corpus_pipeline
from inocula.llm import bpe, linededup
from inocula.llm.common import importable, stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VILE = ["grobian", "schuft", "lump", "wicht"]


def prose(rng, n):
    return " ".join("".join(rng.choices(["ka", "lo", "mi", "tre", "su", "an", "vo", "pel"], k=rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    importable(spark)
    rng = random.Random(21)
    folder = str(tmp_path_factory.mktemp("corpus"))
    passage = prose(rng, 60)
    items = [(f"q{i}", prose(rng, 14)) for i in range(5)]
    texts: list[str | None] = []
    toxic, planted = set(), defaultdict(set)
    for i in range(320):
        lines = [prose(rng, rng.randint(8, 25)) for _ in range(rng.randint(2, 5))]
        if i % 4 == 0:
            toxic.add(i)
            for _ in range(4):
                k = rng.randrange(len(lines))
                lines[k] = f"{lines[k]} {rng.choice(VILE)} {prose(rng, 2)}"
        if i % 16 == 1:
            lines.insert(1, passage)
            planted["passage"].add(i)
        if i % 40 == 3:
            lines.append(f"{prose(rng, 3)} {items[i % 5][1].upper()} {prose(rng, 2)}")
            planted["leak"].add(i)
        texts.append("\n".join(lines))
    long_enough = [i for i in range(2, 320, 4) if i % 16 != 1 and len(texts[i].split()) >= 75]
    for i in long_enough[:6]:  # copies and near copies: one word of 75 changes 5 of 71 shingles
        words = texts[i].split(" ")
        near = list(words)
        near[len(near) // 2] = prose(rng, 1)
        texts += [texts[i], " ".join(near)]
        planted["copies"].add((i, len(texts) - 2, len(texts) - 1))
    texts += [None, "", "  "]
    rows = [(k, t, "en" if k % 3 else None, f"src{k % 2}", len(t) if t is not None else None) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    marks = [(k, 1, int(k in toxic)) for k in range(320)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, toxic, planted, items


def without_recurring_lines(texts: dict[int, str | None]) -> dict[int, str | None]:
    """Exact lines only: the corpus has no lines that vary in a field."""
    places, first = defaultdict(set), {}
    for i, t in sorted(texts.items()):
        lines = (t or "").split("\n") if t is not None else []
        keys = [re.sub("[0-9]+", "#", x.strip(" ")) for x in lines]
        for k, x in enumerate(keys):
            if x:
                places[x].add((keys[k - 1] if k else None, keys[k + 1] if k + 1 < len(keys) else None))
                first.setdefault(x, i)
    out = {}
    for i, t in texts.items():
        if t is None:
            out[i] = None
            continue
        kept = []
        for x in t.split("\n"):
            key = re.sub("[0-9]+", "#", x.strip(" "))
            need = linededup.SHORT_PLACES if len(key.split(" ")) < linededup.SHORT_TOKENS else linededup.MIN_PLACES
            if not key or len(places[key]) < need or first[key] == i:
                kept.append(x)
        if len(kept) == len(t.split("\n")) or "\n".join(kept).strip(" "):
            out[i] = "\n".join(kept)
    return out


def one_of_each(texts: dict[int, str | None]) -> set[int]:
    ids = sorted(texts)
    sets = {}
    for i in ids:
        w = re.findall("[^\x20\x09-\x0D]+", (texts[i] or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in ids}


def leaked(text: str | None, items) -> bool:
    words = WORD.findall((text or "").translate(FOLD))
    windows = set()
    for _, t in items:
        w = WORD.findall(t.translate(FOLD))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    return any(tuple(words[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(words)))


def test_every_stage_on_its_own_input(spark, corpus):
    folder, texts, toxic, planted, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stored(stage(spark, docs, folder), f"test-{name}")
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(rows) == len(after), name
        seen[name] = after
        if name != "byte_bpe":
            assert docs.columns == columns, name
        if name == "toxicity":
            gone = set(before) - set(after)
            assert len(gone & toxic) >= 0.95 * len(toxic)
            assert len(gone - toxic) <= 4
            assert all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            assert after == without_recurring_lines(before)
        elif name == "ngram_jaccard_join":
            assert set(after) == one_of_each(before)
            assert all(after[i] == before[i] for i in after)
        elif name == "decontamination":
            assert set(after) == {i for i, t in before.items() if not leaked(t, items)}
        else:
            import tiktoken

            ranks = bpe.load_ranks(vocabularies.path("byte_bpe_multi_50k.tiktoken"))
            enc = tiktoken.Encoding("t", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert after == before
            for r in rows:
                assert r["ids"] == enc.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(r["ids"]) and r["round_trip"]
    last = set(seen["byte_bpe"])
    for first, copy, near in planted["copies"]:
        assert len(last & {first, copy, near}) <= 1
    assert not last & planted["leak"]
    passage_in = [i for i, t in seen["line_dedup"].items() if t and any(len(x.split(" ")) == 60 for x in t.split("\n"))]
    assert len(passage_in) == 1
    assert {len(texts) - 3, len(texts) - 2, len(texts) - 1} <= last


def test_run_is_the_stages(spark, corpus):
    folder = corpus[0]
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens", "round_trip"} == set(got.columns)
    assert got.filter("not round_trip").count() == 0


def test_empty_corpus(spark, tmp_path):
    importable(spark)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
