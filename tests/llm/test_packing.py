"""Packing: ids of the library, every id once, full windows; the solver against brute force."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from itertools import combinations_with_replacement, product

import numpy as np
import public_tokenizers as vocabularies
import pytest

from inocula.llm import packing
from inocula.llm.common import importable
from inocula.llm.queries import op12_packing

PATH = vocabularies.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def session(spark):
    importable(spark)
    return spark


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def check(pieces, wanted, window):
    """Every document's ids are there once, and sequences are gapless; gives the sequences' lengths."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    got = []
    for doc_id, own in docs.items():
        own.sort(key=lambda p: p["start"])
        at, ids = 0, []
        for p in own:
            if p["start"] == 0 and at:  # the next row of the same id
                got.append((doc_id, tuple(ids)))
                at, ids = 0, []
            ids += np.frombuffer(p["ids"], "<u4").tolist()
            at += 1
        got.append((doc_id, tuple(ids)))
    if wanted is not None:
        assert sorted(got, key=str) == sorted(wanted, key=str)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] * 4 == len(p["ids"]) > 0
            at += p["length"]
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences)))
    return [sum(p["length"] for p in own) for own in sequences.values()]


@pytest.mark.parametrize("window,grid,depth", [(2048, 16, 3), (64, 4, 3), (32, 4, 2)])
def test_every_id_once_in_full_windows(session, library, window, grid, depth):
    rng = random.Random(5)
    texts = [None, "", " ", "  \n x", "<|endoftext|> a", "x" * 5000, "a\n \nb  c.  d", "it's 12.5, no. é. É, 漢字."]
    texts += [" ".join(rng.choices(["alpha", "Beta,", "gam-ma.", "12", "né"], k=rng.randint(1, 90))) for _ in range(300)]
    texts += ["the same text again"] * 150  # a third of all rows alike
    rows = [(i, t, 1, "x", "y", 2) for i, t in enumerate(texts)] + [(None, "no id", 1, "x", "y", 2)]
    df = session.createDataFrame(rows, "doc_id long, text string, n int, ids string, cls string, `row` int").repartition(4)
    pieces = packing.pack(df, PATH, 1, 50_257, window=window, grid=grid, depth=depth).collect()
    wanted = [(i, tuple(library(t) + [1])) for i, t, *_ in rows]
    lengths = check(pieces, wanted, window)
    assert all(n == window or n & (n - 1) == 0 for n in lengths)
    assert {p["doc_id"]: p["doc_tokens"] for p in pieces} == {i: len(t) for i, t in wanted}


def test_most_remainders_stay_whole(session):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randint(1, 60)) for i in range(2000)]
    df = session.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(df, PATH, 1, 50_257, window=64, grid=4).collect()
    by_doc = defaultdict(int)
    for p in pieces:
        by_doc[p["doc_id"]] += 1
    assert sum(n == 1 for n in by_doc.values()) > 0.5 * len(rows)


def test_empty_table(session):
    empty = session.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, PATH, 1, 50_257).count() == 0


def test_equal_ids_are_documents_of_their_own(session, library):
    df = session.createDataFrame([(1, "a b c")] * 3, "doc_id long, text string")
    pieces = packing.pack(df, PATH, 1, 50_257).collect()
    assert sum(p["length"] for p in pieces) == 3 * (len(library("a b c")) + 1)


def test_ids_equal_the_library(library):
    rng = random.Random(7)
    ids = packing.ChunkIds(PATH)
    assert ids.merge.__name__ == "encode_ordinary"
    spaces = list(packing.SPACE) + ["\x1c", "\x1f", "​", "᠎"]
    parts = ["a", "b's", "'S", "'re", ".", ",", "..", "é", "É.", "漢字", "1", "23.", "İ.", "ª,", "!", "😀", "ẋ.", "٠,", "'", "<|", "ǅ,", "\x00"]
    texts = [f"a{x}{y}b {x} {y}" for x, y in product(spaces, spaces)]
    texts += ["".join(rng.choices(spaces + parts + [" "] * 12, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += [f"a{chr(c)}. {chr(c)}, x{chr(c)} {chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for t in texts:
        assert np.frombuffer(ids.encode(t), "<u4").tolist() == library(t), repr(t)


def test_least_squares_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 3, (5, 4)).astype(float), rng.integers(0, 9, 5).astype(float)
        x = packing.nnls(a, b)
        best = np.inf
        for subset in product([False, True], repeat=4):  # the best over all active sets
            s = np.zeros(4)
            if any(subset):
                s[list(subset)] = np.linalg.lstsq(a[:, list(subset)], b, rcond=None)[0]
            if (s >= -1e-9).all():
                best = min(best, ((a @ s - b) ** 2).sum())
        assert (x >= 0).all() and ((a @ x - b) ** 2).sum() == pytest.approx(best, abs=1e-6)


def test_combinations_and_plan():
    want = {w for k in (1, 2, 3) for w in combinations_with_replacement(range(1, 13), k) if sum(w) == 12}
    assert set(packing.combinations(12, 3)) == want
    rng = random.Random(8)
    histogram = {c: rng.randint(0, 1000) for c in range(12)}
    plan = packing.plan_windows(histogram, 12, 3)
    used = defaultdict(int)
    for way, times in plan:
        assert sum(way) == 12 and times > 0
        for c in way:
            used[c] += times
    assert all(used[c] <= histogram[c] for c in used)
    assert sum(c * n for c, n in used.items()) > 0.7 * sum(c * n for c, n in histogram.items())
    taken = defaultdict(list)
    for cls, lo, hi, times, first, slot in packing.places(plan):
        taken[cls].append((lo, hi))
        assert (hi - lo) % times == 0
    for cls, spans in taken.items():
        assert [lo for lo, _ in sorted(spans)] == [0, *(hi for _, hi in sorted(spans))][:-1] and max(hi for _, hi in spans) == used[cls]


def test_registered_query(session, library):
    d = "/root/testdata/sf0.001"
    pieces = op12_packing(session, d).collect()
    texts = {r["doc_id"]: library(r["text"]) + [1] for r in session.read.parquet(f"{d}/documents.parquet").collect()}
    covered, filled = defaultdict(int), defaultdict(int)
    for p in pieces:
        own = texts[p["doc_id"]]
        part = own[p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and p["doc_tokens"] == len(own)
        covered[p["doc_id"]] += p["length"]
        filled[p["sequence_id"]] += p["length"]
    assert covered == {i: len(t) for i, t in texts.items()}
    assert all(n == 2048 or n & (n - 1) == 0 for n in filled.values())
