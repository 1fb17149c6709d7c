"""Cases that went wrong once: stitching at white space, words before stops, lines."""

from __future__ import annotations

import os
import random
import unicodedata
from itertools import product

import duckdb
import numpy as np
import public_tokenizers as vocabularies
import pytest
from pyspark.sql import functions as F

from inocula.llm import bpe, jaccard, langid, linededup, queries, tokenfile
from inocula.llm.common import importable

RANKS = vocabularies.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def session(spark):
    importable(spark)
    return spark


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding(
        "t", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={}
    ).encode_ordinary


def test_chunks_stitch_around_every_pair_of_spaces(session, library):
    texts = []
    for a, b in product(bpe.SPACE, repeat=2):
        texts += [("word " * 8)[: 30 + k] + a + b + "next one" + " and more" * 4 for k in range(0, 12, 3)]
    rng = random.Random(9)
    alphabet = ["a", "b's", "'s", "1", "!", "é", "漢", *bpe.SPACE]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(60, 300))) for _ in range(400)]
    df = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_documents(df, RANKS, vocabularies.PATTERN, chunk=40, overlap=24).collect():
        assert r["ids"] == library(r["text"]), repr(r["text"])


@pytest.mark.parametrize("gap", ["  ", "  ", "\n ", " \u0085 "])
def test_real_chunks_stitch_at_white_space(session, library, gap):
    texts = ["x" * (bpe.CHUNK - k) + gap + "word " * 2000 for k in range(0, 4)]
    df = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_documents(df, RANKS, vocabularies.PATTERN).collect():
        assert r["ids"] == library(r["text"])


def test_other_patterns_are_refused(session):
    df = session.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        bpe.encode_documents(df, RANKS, r"\w+|\W+")


def test_every_letter_before_a_stop_and_after_a_capital():
    w = tokenfile.word_ids(vocabularies.path("word_bpe_49k.json"))
    letters = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM" and c not in range(0x3400, 0x20000)]
    letters += list("İǅ一가")
    words = [f"x{c}." for c in letters] + [f"T{c}," for c in letters]
    for word, want in zip(words, w.tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(tokenfile.encode_text(word, w), np.uint32).tolist() == want.ids, repr(word)


def lines(session, texts, **limits):
    df = session.createDataFrame([(i, t, 1, "g", "d") for i, t in enumerate(texts)], "doc_id long, text string, id int, gone string, doc string")
    rows = linededup.drop_recurring_lines(df, **limits).collect()
    assert {(r["id"], r["gone"], r["doc"]) for r in rows} == {(1, "g", "d")}
    return {r["doc_id"]: r["text"] for r in rows}


def test_blank_lines_of_carriage_returns_stay(session):
    got = lines(session, [f"own text {'abcdefghijklmnop'[i]} stands here\r\n\r\n\r\nmore of it {'qrstuvwxyzabcdef'[i]} alone" for i in range(16)])
    assert all(t.count("\r\n\r\n\r\n") == 1 for t in got.values())


def test_lines_without_a_constant_token_stay(session):
    texts = [f"{1900 + i}\nword{chr(97 + i)} says something else {chr(97 + i) * 3}" for i in range(15)]
    assert lines(session, texts) == dict(enumerate(texts))


def test_a_leaf_holds_several_templates(session):
    words = [a + b for a, b in product("abcdefghij", "klmnopqrst")]
    first = [f"we thank you for a visit to the shop of {words[i]}" for i in range(20)]
    second = [f"we thank you all people that came along with their {words[50 + i]}" for i in range(18)]
    texts = [f"{a}\nown {words[i]} line {words[i + 1]} here" for i, a in enumerate(first + second)]
    got = lines(session, texts)
    assert sum("visit" in t for t in got.values()) == 1
    assert sum("people" in t for t in got.values()) == 1


def test_the_join_of_near_copies_grows_with_their_number(session):
    """One text with copies changed more and more: what leaves the matrix stays in proportion."""

    def candidates(n):
        rng = random.Random(1)
        base = [f"w{k}" for k in range(150)]
        rows = [(0, " ".join(base))]
        for i in range(1, n):
            own = list(base)
            for at in rng.sample(range(150), rng.randint(1, 8)):
                own[at] = f"x{i}-{at}"
            rows.append((i, " ".join(own)))
        df = session.createDataFrame(rows, "doc_id long, text string")
        seen = []
        plain = jaccard.matrix_pairs

        def counted(*a):
            pairs = plain(*a)
            seen.append(pairs.count())
            return pairs

        jaccard.matrix_pairs = counted
        try:
            got = {r["id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
        finally:
            jaccard.matrix_pairs = plain
        sets = [jaccard.shingles(t.encode()) for _, t in rows]
        linked = [i for i in range(n) if jaccard.linked(sets[0], sets[i], 80)]
        assert {got[i] for i in linked} == {0}
        return seen[0]

    few, many = candidates(150), candidates(600)
    assert many <= 8 * max(few, 150)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_registered_queries_equal_their_sql(session, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](session, folder)
    assert sorted(got.columns) == sorted(want.columns)
    told = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert told(got.select(*want.columns).collect()) == told(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_registered_queries_return_every_document(session, name):
    if name.startswith(("op11", "op12")):
        pytest.skip("tested against brute force beside their operators")
    rows = queries.QUERIES[name](session, "/root/testdata/sf0.001")
    ids = [r["doc_id"] for r in rows.select("doc_id").collect()]
    docs = session.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(ids) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert rows.filter(F.lit(True)).columns[0] == "doc_id"


def test_dictionaries_hold_pieces_of_whole_texts(session):
    """Texts that open and end with another language's passage are still learned by what they hold."""
    rng = random.Random(5)
    own = {"aa": ["ketu", "malor", "sivet", "ranu", "polix"], "bb": ["drung", "wheft", "glorb", "skind", "thrum"]}
    license_line = " ".join(["permission", "granted", "without", "charge"] * 60)
    rows = []
    for i in range(24):
        lang = "aa" if i % 2 else "bb"
        body = " ".join(rng.choice(own[lang]) + rng.choice(["", "a", "en"]) for _ in range(4000))
        rows.append((i, f"{license_line} {body}", lang))
    model = langid.fit_languages(session.createDataFrame(rows, "doc_id long, text string, lang string"), dict_bytes=4096)
    for x, content in zip(model.langs, model.contents):
        assert len(content) <= 4096
        words = content.split()
        assert sum(w[:4] in {k[:4].encode() for k in own[x]} for w in words) > 0.6 * len(words)
        assert len(words) > 200
    tests = [(i, " ".join(rng.choice(own[x]) for _ in range(12)), x) for i, x in enumerate(["aa", "bb"] * 10)]
    got = langid.identify(session.createDataFrame(tests, "doc_id long, text string, lang string"), model).collect()
    assert all(r["language"]["best"] == r["lang"] for r in got)


def test_dictionaries_of_short_and_wide_texts(session):
    rows = [(0, "é" * 50 + " ö" * 4000, "x"), (1, "abc", "x"), (2, "я" * 9000, "y"), (3, "abc", "x")]
    model = langid.fit_languages(session.createDataFrame(rows, "doc_id long, text string, lang string"), dict_bytes=600)
    assert model.langs == ["x", "y"]
    assert all(0 < len(c) <= 600 for c in model.contents)
    assert b"abc" in model.contents[0]
