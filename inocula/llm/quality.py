"""Quality by positive-unlabelled learning with the non-negative risk.

Trusted positives and unlabelled web text are enough: the classifier
minimises  pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)])  with the
logistic loss l, where pi is the share of positives in the web text.  Where
the second part turns negative (over-fitting) the step climbs out of it
instead.  pi is estimated from the same two samples (``estimate_prior``):
a classifier of positives against web text is learnt from one half of each; on
the other half the web's share above a cut, divided by the positives' share
above it, bounds pi from above, and is closest where the ratio with its
confidence margin is least.  Negatives are never used, nor known.

Features are those of the whole text: how often each pair of adjacent byte
classes occurs, and how much the words and lines repeat.  The model reads a
bounded sample (``max_rows`` positives and ``max_rows`` web texts).

Defined results: null text counts as empty and is scored; without positives
every score is 0; without web text every score is 1; an existing column named
``out`` is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_ids, sampled_rows, utf8, values, words

MAX_ROWS = 4000
STEPS = 600
BATCH = 1024

# Byte classes, in order; any other byte is of class 15.
_CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?",
    b"'\"-", b"|", b"#$%&*@", b"()[]{}<>", b"/\\:_=+;~^`", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0)),
]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
N_CLASS = len(_CLASSES) + 1
N_FEATURES = N_CLASS * N_CLASS + 7


def features(text: bytes) -> np.ndarray:
    kinds = _CLASS[np.frombuffer(text, np.uint8)]
    pairs = np.bincount(kinds[:-1] * N_CLASS + kinds[1:], minlength=N_CLASS * N_CLASS)
    own = words(text)
    count = Counter(own)
    lines = text.split(b"\n")
    n = len(own)
    rest = [
        np.log1p(len(text)),
        np.log1p(n),
        len(count) / n if n else 0.0,
        max(count.values()) / n if n else 0.0,
        len(set(lines)) / len(lines),
        len(text) / n / 10 if n else 0.0,
        sum(map(eq, own, own[1:])) / n if n else 0.0,
    ]
    return np.concatenate([np.sqrt(pairs / max(1, len(text) - 1)), rest]).astype(np.float32)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    offset: float
    prior: float
    constant: float | None = None

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.offset

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.margins(x)
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def _bounded_step(a, b, za, zb, prior: float, grad, sigmoid) -> np.ndarray:
    """Gradient of the non-negative risk, or the way out of a negative part."""
    negative = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
    on_negative = grad(b, sigmoid(zb)) - prior * grad(a, sigmoid(za))
    return prior * grad(a, -sigmoid(-za)) + on_negative if negative >= 0 else -on_negative


def train(positive: np.ndarray, web: np.ndarray, prior: float, seed: int = 5, bounded: bool = True) -> QualityModel:
    """Adam on the non-negative risk; not ``bounded``: positives against web text, both halves alike."""
    rng = np.random.default_rng(seed)
    mean, scale = web.mean(0), web.std(0) + 1e-3
    p, u = (np.clip((a - mean) / scale, -8, 8) for a in (positive, web))
    w = np.zeros(N_FEATURES + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    grad = lambda a, g: np.append(a.T @ g, g.sum()) / len(a)
    for step in range(1, STEPS + 1):
        a, b = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        za, zb = a @ w[:-1] + w[-1], b @ w[:-1] + w[-1]
        if not bounded:
            g = prior * grad(a, -sigmoid(-za)) + (1 - prior) * grad(b, sigmoid(zb))
        else:
            g = _bounded_step(a, b, za, zb, prior, grad, sigmoid)
        g[:-1] += 1e-4 * w[:-1]
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        w -= 0.02 * (1 - step / (STEPS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, scale, w[:-1].astype(np.float32), float(w[-1]), prior)


def estimate_prior(positive: np.ndarray, web: np.ndarray, seed: int = 7, doubt: float = 0.1) -> float:
    """Share of positives in the web text, from features of both, kept off 0 and 1."""
    rng = np.random.default_rng(seed)
    halves = [np.array_split(a[rng.permutation(len(a))], 2) for a in (positive, web)]
    if min(len(h) for pair in halves for h in pair) == 0:
        return 0.5
    (p_fit, p_held), (u_fit, u_held) = halves
    # with prior 1/2 and no bound on the risk this is plain positives against web text
    model = train(p_fit, u_fit, 0.5, seed, bounded=False)
    at_p, at_u = np.sort(model.margins(p_held)), np.sort(model.margins(u_held))
    cuts = np.unique(at_p)
    share_p = 1 - np.searchsorted(at_p, cuts) / len(at_p)
    share_u = 1 - np.searchsorted(at_u, cuts) / len(at_u)
    margin = np.sqrt(np.log(4 / doubt) / 2) * (len(at_p) ** -0.5 + len(at_u) ** -0.5)
    best = int(((share_u + margin) / share_p).argmin())
    return float(min(0.99, max(0.01, share_u[best] / share_p[best])))


def _features(texts):
    @F.arrow_udf("binary")
    def compute(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([features(t).tobytes() for t in values(a)], pa.binary())

    return compute(texts)


def fit_quality(
    docs: DataFrame,
    positives: DataFrame,
    prior: float | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
    max_rows: int = MAX_ROWS,
) -> QualityModel:
    """Learn from trusted ``positives`` (ids) against the web text ``docs``.

    ``prior`` is estimated from the two where it is not given.
    """
    texts = docs.select(id_col, F.col(text_col).alias("text")).filter(F.col(id_col).isNotNull())
    found = []
    for ids in (positives.filter(F.col(id_col).isNotNull()), texts):
        rows = sampled_rows(texts, least_ids(ids, id_col, max_rows), id_col, _features(utf8("text")), [], 2 * max_rows)
        found.append(np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float32).reshape(-1, N_FEATURES))
    p, u = found
    if not len(p) or not len(u):
        z = np.zeros(N_FEATURES, np.float32)
        return QualityModel(z, z + 1, z, 0.0, prior if prior is not None else 0.5, constant=1.0 if len(p) else 0.0)
    return train(p, u, estimate_prior(p, u) if prior is None else prior)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with the double column ``out``, from the whole text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            x = np.array([features(t) for t in values(a)], np.float32).reshape(-1, N_FEATURES)
            yield pa.array(shipped.value.scores(x), pa.float64())

    return docs.withColumn(out, score.asNondeterministic()(utf8(text_col)))
