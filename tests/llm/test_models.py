"""The trained operators against naive versions of what they compute."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from inocula.llm import decontaminate, langid, quality, tokenfile, toxicity
from inocula.llm.common import importable


@pytest.fixture(scope="module")
def session(spark):
    importable(spark)
    return spark


def test_convolution_equals_a_naive_one(monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))).encode() for _ in range(200)]
    toxic = np.array([t.split().count(b"w3") > 0 for t in texts], np.float32)
    model = toxicity.train([toxicity.hash_words(t) for t in texts], toxic)

    def embedding(word: bytes) -> np.ndarray:
        whole, stem = zlib.crc32(word) & (toxicity.BUCKETS - 2), zlib.crc32(word[: toxicity.STEM]) & (toxicity.BUCKETS - 2) | 1
        return model.embedding[model.row[whole]] + model.embedding[model.row[stem]]

    def score(text: bytes) -> float:
        words = [embedding(w) for w in text.split()] or [2 * model.embedding[0]]
        z = model.offset
        for j, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = -np.inf
                for at in range(len(words)):  # past the end stands the zero embedding
                    total = 0.0
                    for k in range(w):
                        if at + k < len(words):
                            total += float(words[at + k] @ model.filters[j][k * toxicity.DIM : (k + 1) * toxicity.DIM, f])
                    best = max(best, total)
                n = j * toxicity.FILTERS + f
                z += max(0.0, best + float(model.bias[n])) * float(model.weight[n])
        return 1 / (1 + np.exp(-z))

    want = [score(t) for t in texts]
    assert np.allclose(model.scores([toxicity.hash_words(t) for t in texts]), want, atol=1e-4)
    for size in (1, 7):  # whatever is scored beside a text, and where it is cut
        monkeypatch.setattr(toxicity, "SLICE", size)
        assert np.allclose(model.scores([toxicity.hash_words(t) for t in texts]), want, atol=1e-4)


def test_pieces_of_a_long_sample_text_cover_it():
    rows = np.arange(20_000).reshape(-1, 2)
    assert toxicity.spread(rows, 10_000) is rows
    got = toxicity.spread(rows, 640)
    assert len(got) == 640 and (got[0] == rows[0]).all() and (got[-1] == rows[-1]).all()
    gaps = np.diff(got[:, 0])
    assert gaps.min() > 0 and gaps.max() < 2 * 2 * len(rows) // 10


def test_blocks_are_compressed_with_every_dictionary():
    import zstandard as z

    contents = [b"the cat sat on the mat and then the dog ran away", b"der hund und die katze sitzen auf der matte"]
    model = langid.LanguageModel(["en", "de"], contents)
    settings = z.ZstdCompressionParameters(
        window_log=17, hash_log=16, chain_log=16, search_log=3, min_match=3, strategy=z.STRATEGY_GREEDY,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    rng = random.Random(6)
    for source in contents:
        words = [rng.choice(source.split()) for _ in range(2500)]
        sizes = []
        for c in contents:
            # a new compressor for every block: nothing of one block is left for the next
            one = lambda b: z.ZstdCompressor(
                dict_data=z.ZstdCompressionDict(c, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=settings
            ).compress(b)
            sizes.append(sum(len(one(b" ".join(words[at : at + 1024]))) for at in range(0, len(words), 1024)))
        got = langid.classify(b" ".join(words), langid.Compressors(model), 0.004)
        assert got["best"] == model.langs[sizes.index(min(sizes))]
        assert got["margin"] == pytest.approx((max(sizes) - min(sizes)) / max(sizes))


def samples(share: float, n: int = 3000):
    """Positives, and web text with ``share`` of them, three features apart."""
    rng = np.random.default_rng(2)
    shape = (n, quality.N_FEATURES)
    positive, web = rng.normal(0, 1, shape).astype(np.float32), rng.normal(0, 1, shape).astype(np.float32)
    positive[:, :3] += 2
    good = rng.random(n) < share
    web[good, :3] += 2
    web[~good, :3] -= 2
    return positive, web, good


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_needs_no_negatives(share):
    positive, web, good = samples(share)
    prior = quality.estimate_prior(positive, web)
    assert abs(prior - share) < 0.08
    told, known = (((quality.train(positive, web, p).scores(web) >= 0.5) == good).mean() for p in (prior, share))
    assert told > 0.9 and known - told < 0.05


def test_step_follows_the_non_negative_risk():
    rng = np.random.default_rng(8)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    grad = lambda a, g: np.append(a.T @ g, g.sum()) / len(a)
    a, b = rng.normal(1, 1, (40, 3)), rng.normal(-1, 1, (50, 3))
    for w, prior in ((np.array([0.3, -0.2, 0.1, 0.2]), 0.3), (np.array([3.0, 3.0, 3.0, 1.0]), 0.9)):

        def parts(v):
            za, zb = a @ v[:-1] + v[-1], b @ v[:-1] + v[-1]
            loss = lambda m: np.mean([np.log(1 + np.exp(-x)) for x in m])
            return prior * loss(za), loss(-zb) - prior * loss(-za)

        negative = parts(w)[1] < 0
        risk = (lambda v: -parts(v)[1]) if negative else (lambda v: sum(parts(v)))
        numeric = [(risk(w + h) - risk(w - h)) / 2e-5 for h in np.eye(4) * 1e-5]
        got = quality._bounded_step(a, b, a @ w[:-1] + w[-1], b @ w[:-1] + w[-1], prior, grad, sigmoid)
        assert np.allclose(got, numeric, atol=1e-6)
    assert negative  # the second case climbs out


def test_blocks_of_windows_give_the_same_marks_with_clashing_names(session):
    rng = random.Random(12)
    vocabulary = [f"v{i}é" for i in range(6)]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=3))) for k in range(40)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(50)] * 2 + [None, ""]
    df = session.createDataFrame([(i, t, "k", "h") for i, t in enumerate(texts)], "doc_id long, text string, tkey string, h string")
    bench = session.createDataFrame(items, "item_id string, text string")
    whole, parts = (
        sorted(decontaminate.mark_contamination(df, bench, block_bytes=size).collect()) for size in (64 << 20, 300)
    )
    assert whole == parts and len(whole) == len(texts) and any(r["contamination"]["n_hit"] for r in whole)


def test_files_follow_the_bytes(session, monkeypatch):
    df = session.createDataFrame([(i, "x" * 1000) for i in range(100)] + [(None, None)], "doc_id long, text string")
    cores = session.sparkContext.defaultParallelism
    assert tokenfile._files(df, "text") == cores == tokenfile._files(df.limit(0), "text")
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 1000)
    assert tokenfile._files(df, "text") == max(cores, 100)
