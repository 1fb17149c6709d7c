"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words (A-Z lower-cased, see ``common.words``) are hashed to embeddings, each
by itself and by its first ``STEM`` bytes, which inflected forms share, and
the two are added; filters of several widths slide over the whole text, each filter keeps its
largest value (max pooling), and a logistic unit reads those.  Buckets seen in fewer
than ``MIN_DOCS`` texts learnt from share the zero embedding, so a word that was
never learned says nothing.

It learns from the whole texts of all labelled rows, in ``EPOCHS`` rounds on Spark.
The rows are dealt by a hash of their text into shards of about ``SHARD`` rows.  In a
round every shard learns from the same weights, in numpy inside its task; the next
weights are the mean of theirs (of an embedding, over the shards that changed it).
The changes are added as whole numbers, so no order of tasks shows in the result.
Both labels count the same in the loss, whatever their share.  The driver holds the
weights alone, bounded by ``BUCKETS``.

A quarter of the labelled rows, by hash and not learnt from, calibrates the
decision: the threshold with the best F1 overall, which the score's bias is shifted
by so that it lies at 0.5, and one per language with at least ``MIN_TOXIC`` toxic
calibration rows.  They are counted by score, to a hundredth of a logit.  The
language decides nothing but the threshold; the score sees text only.

Defined results: null or word-less text scores like one unknown word; without
labelled rows of both kinds every score is 0 (or 1 where all are toxic); an
unknown or null language uses the overall threshold; an existing column named
``out`` is replaced; labelled rows of equal text, language and label count once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bloom import key_filter, possibly_in
from .common import discard, give_back, let_go, map_texts, release, short_lived_shuffles, stored, utf8, values, words

BUCKETS = 1 << 18
STEM = 5
DIM = 16
FILTERS = 8
WIDTHS = (1, 2, 3)
SHARD = 4096  # rows that learn together
MIN_DOCS = 4
MIN_TOXIC = 25
EPOCHS = 4  # rounds
MIN_STEPS = 1000  # of a shard; few rows are gone through more often in a round
BATCH = 32
RATE = 0.01
SLICE = 16384  # words scored at once
STEPS_OF_LOGIT = 100  # scores told apart in calibration

_GAP = max(WIDTHS) - 1


def hash_words(text: bytes) -> np.ndarray:
    """Two buckets a word, (n, 2): of the word (even) and of its stem (odd)."""
    mask, own = BUCKETS - 2, words(text)
    out = np.empty((len(own), 2), np.int32)
    out[:, 0] = [zlib.crc32(w) & mask for w in own]
    out[:, 1] = [zlib.crc32(w[:STEM]) & mask for w in own]
    out[:, 1] |= 1
    return out


def _times(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """x @ f in blocks small enough for one thread: a task has one core."""
    out = np.empty((len(x), f.shape[1]), np.float32)
    for at in range(0, len(x), 1024):
        np.matmul(x[at : at + 1024], f, out=out[at : at + 1024])
    return out


@dataclass
class ToxicityModel:
    """row: bucket -> embedding row (0: unknown); thresholds on the score."""

    row: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]  # per width: (width * DIM, FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    constant: float | None = None
    threshold: float = 0.5
    by_lang: dict[str, float] = field(default_factory=dict)

    def pooled(self, docs: list[np.ndarray], most: int | None = None) -> tuple[np.ndarray, list]:
        """Largest filter values per document, and what training needs.

        A window starts at a word (one of the first ``most``), never in the gap
        behind a document, from where it would reach into the next one.
        """
        padded, starts, ends, at = [], [], [], 0
        gap = np.zeros((_GAP, 2), np.int32)
        for d in docs:
            own = d if len(d) else np.zeros((1, 2), np.int32)
            padded += [own, gap]
            starts.append(at)
            ends.append(at + min(len(own), most or len(own)))
            at += len(own) + _GAP
        ids = np.concatenate([*padded, gap])
        x = self.embedding[ids[:, 0]] + self.embedding[ids[:, 1]]
        spans = np.ravel([starts, ends], order="F")
        out, trace = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            n = at
            conv = _times(x[:n], f[:DIM])
            for k in range(1, w):
                conv += _times(x[k : n + k], f[k * DIM : (k + 1) * DIM])
            out.append(np.maximum.reduceat(conv, spans, axis=0)[::2])
            trace.append(conv)
        return np.concatenate(out, axis=1) + self.bias, [ids, x, starts, ends, trace]

    def _slices(self, docs: list[np.ndarray]) -> Iterator[tuple[list[int], list[int], np.ndarray, list]]:
        """Whole documents of any length, a bounded number of words at once: owner and
        first word of every slice (they overlap by the widest filter), and what pools."""
        owner, first, held, n = [], [], [], 0
        for i, d in enumerate(docs):
            for at in range(0, max(1, len(d)), SLICE):
                own = self.row[d[at : at + SLICE + _GAP]]
                if held and n + len(own) > SLICE:
                    yield owner, first, *self.pooled(held, SLICE)
                    owner, first, held, n = [], [], [], 0
                owner.append(i)
                first.append(at)
                held.append(own)
                n += len(own) + _GAP
        if held:
            yield owner, first, *self.pooled(held, SLICE)

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        best = np.full((len(docs), len(self.bias)), -np.inf, np.float32)
        for owner, _, top, _ in self._slices(docs):
            np.maximum.at(best, owner, top)
        return np.maximum(best, 0) @ self.weight + self.offset

    def windows(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of every document and filter the largest value, and the embedding rows under it:
        (docs, filters, widest, 2), 0 behind the document and where a filter does not reach."""
        n, each = len(self.bias), np.arange(FILTERS)
        best, at = np.full((len(docs), n), -np.inf, np.float32), np.zeros((len(docs), n), np.int64)
        for owner, first, _, (_, _, starts, ends, trace) in self._slices(docs):
            for i, offset, lo, hi in zip(owner, first, starts, ends, strict=True):
                where = [conv[lo:hi].argmax(0) for conv in trace]
                top = np.concatenate([conv[lo + x, each] for conv, x in zip(trace, where, strict=True)])
                more = top > best[i]
                best[i][more] = top[more]
                at[i][more] = (offset + np.concatenate(where))[more]
        taps = np.arange(max(WIDTHS))
        reach = taps < np.repeat(WIDTHS, FILTERS)[:, None]
        ids = np.zeros((len(docs), n, len(taps), 2), np.int32)
        for i, d in enumerate(docs):
            if len(d):
                under = at[i][:, None] + taps
                ids[i] = self.row[d[np.minimum(under, len(d) - 1)]] * (reach & (under < len(d)))[:, :, None]
        return best + self.bias, ids

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None or not docs:
            return np.full(len(docs), self.constant or 0.0)
        return 1 / (1 + np.exp(-np.clip(self.logits(docs).astype(float), -30, 30)))


def start(known: np.ndarray, seed: int = 7) -> ToxicityModel:
    """Weights to learn from, with embeddings for the buckets ``known``."""
    rng = np.random.default_rng(seed)
    row = np.zeros(BUCKETS, np.int32)
    row[known] = np.arange(1, len(known) + 1)
    e = rng.normal(0, 0.05, (len(known) + 1, DIM)).astype(np.float32)
    e[0] = 0
    fs = [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    n = FILTERS * len(WIDTHS)
    return ToxicityModel(row, e, fs, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0)


def flat(m: ToxicityModel) -> np.ndarray:
    """All weights in rows of ``DIM``: the embeddings, then the others end to end."""
    rest = np.concatenate([*(f.ravel() for f in m.filters), m.bias, m.weight, [m.offset]]).astype(np.float32)
    return np.concatenate([m.embedding, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])


def with_weights(m: ToxicityModel, weights: np.ndarray) -> ToxicityModel:
    """The model with weights as ``flat`` gives them."""
    known, rest, n = len(m.embedding), weights[len(m.embedding) :].ravel(), len(m.bias)
    cut = np.split(rest, np.cumsum([*(f.size for f in m.filters), n, n, 1]))
    fs = [c.reshape(f.shape).copy() for c, f in zip(cut, m.filters, strict=False)]
    bias, weight, offset = cut[len(fs) : len(fs) + 3]
    return ToxicityModel(m.row, weights[:known].copy(), fs, bias.copy(), weight.copy(), float(offset[0]))


def part_for(m: ToxicityModel, docs: list[np.ndarray]) -> tuple[ToxicityModel, np.ndarray]:
    """A copy of the model with the embeddings alone that ``docs`` use, and their rows in ``m``.

    What it learns from ``docs`` is what ``m`` would learn, in the memory of their own words.
    """
    used = np.zeros(len(m.embedding), bool)
    used[0] = True
    for d in docs:
        used[m.row[d]] = True
    rows = np.flatnonzero(used)
    place = np.zeros(len(used), np.int32)
    place[rows] = np.arange(len(rows))
    fs = [f.copy() for f in m.filters]
    return ToxicityModel(place[m.row], m.embedding[rows], fs, m.bias.copy(), m.weight.copy(), m.offset), rows


def learn(m: ToxicityModel, docs: list[np.ndarray], toxic: np.ndarray, cost: np.ndarray, turn: int) -> None:
    """Round ``turn`` over hashed documents: Adam on the logistic loss, weighted by ``cost``.

    Only the largest window of a filter learns, and only the embeddings under it move.
    """
    rng = np.random.default_rng([7, turn])
    offset = np.array([m.offset], np.float32)
    params = [*m.filters, m.bias, m.weight, offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    e1, e2 = np.zeros_like(m.embedding), np.zeros_like(m.embedding)
    epochs = max(1, -(-MIN_STEPS * BATCH // (EPOCHS * max(1, len(docs)))))
    step = 0
    for epoch in range(epochs):
        rate = RATE * 0.25 ** ((turn + epoch / epochs) / EPOCHS)
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            h, ids = m.windows([docs[i] for i in pick])
            x = m.embedding[ids].sum(3)
            a = np.maximum(h, 0)
            z = a @ m.weight + offset[0]
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - toxic[pick]).astype(np.float32) * cost[pick] / len(pick)
            gh = (g[:, None] * m.weight) * (h > 0)
            grads, moved, by = [], [], []
            for j, w in enumerate(WIDTHS):
                own = slice(j * FILTERS, (j + 1) * FILTERS)
                grads.append(np.einsum("bfkd,bf->kdf", x[:, own, :w], gh[:, own]).reshape(w * DIM, FILTERS))
                back = m.filters[j].reshape(w, DIM, FILTERS).transpose(2, 0, 1) * gh[:, own, None, None]
                for side in (0, 1):
                    moved.append(ids[:, own, :w, side].ravel())
                    by.append(back.reshape(-1, DIM))
            grads += [gh.sum(0), a.T @ g, g.sum(keepdims=True)]
            rows, place = np.unique(np.concatenate(moved), return_inverse=True)
            ge = np.zeros((len(rows), DIM), np.float32)
            np.add.at(ge, place, np.concatenate(by))
            if len(rows) and rows[0] == 0:  # unknown words and gaps stay zero
                rows, ge = rows[1:], ge[1:]
            step += 1
            long, short = 1 - 0.9**step, 1 - 0.999**step
            for p, gr, v1, v2 in zip(params, grads, first, second, strict=True):
                gr = gr + 1e-4 * p
                v1 += 0.1 * (gr - v1)
                v2 += 0.001 * (gr * gr - v2)
                p -= rate * (v1 / long) / (np.sqrt(v2 / short) + 1e-8)
            ge += 1e-4 * m.embedding[rows]
            e1[rows] += 0.1 * (ge - e1[rows])
            e2[rows] += 0.001 * (ge * ge - e2[rows])
            m.embedding[rows] -= rate * (e1[rows] / long) / (np.sqrt(e2[rows] / short) + 1e-8)
    m.offset = float(offset[0])


def costs(toxic: np.ndarray, count: dict[int, int]) -> np.ndarray:
    """Both labels weigh the same over all rows."""
    n = sum(count.values())
    each = np.array([n / (2 * max(1, count.get(y, 0))) for y in (0, 1)], np.float32)
    return each[toxic.astype(int)]


def train(docs: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> ToxicityModel:
    """All rounds over one shard."""
    seen = np.bincount(np.concatenate([np.unique(d) for d in docs] or [np.zeros(0, int)]), minlength=BUCKETS)
    m = start(np.flatnonzero(seen >= MIN_DOCS), seed)
    cost = costs(toxic, {y: int((toxic == y).sum()) for y in (0, 1)})
    for turn in range(EPOCHS):
        learn(m, docs, toxic, cost, turn)
    return m


def best_threshold(scores: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the cut with the best weighted F1."""
    order = np.argsort(-scores)
    s, y, w = scores[order], toxic[order], weight[order]
    hit, told = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hit / (told + (w * y).sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores are cut together
    i = int(f1.argmax())
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0.0)) / 2)


def spread(rows: np.ndarray, most: int, piece: int = 64) -> np.ndarray:
    """``rows``, or where there are more than ``most`` of them, even pieces from start to end."""
    if len(rows) <= most:
        return rows
    piece = min(piece, most)
    starts = np.linspace(0, len(rows) - piece, most // piece).astype(np.int64)
    return np.concatenate([rows[x : x + piece] for x in starts])


def _hashed(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Views of the column's own bytes."""
    return [np.frombuffer(v.as_buffer(), np.int32).reshape(-1, 2) for v in column]


def _maybe_labelled(texts: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """``texts`` without most rows that have no label, so those are not shuffled for the join."""
    kind = texts.schema[on].dataType
    if kind != labels.schema[on].dataType or not (kind == T.StringType() or isinstance(kind, T.IntegralType)):
        return texts  # equal keys might differ in their hashes
    bits = key_filter(labels, [on])
    return texts if bits is None else possibly_in(texts, [on], bits)


def labelled_rows(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, lang_col: str) -> DataFrame:
    """(label, lang, h, x): the hashed words of every labelled text, equal rows once."""

    def hashed(texts: list[bytes]) -> list[pa.Array]:
        let_go()
        return [pa.array([hash_words(t).tobytes() for t in texts], pa.binary())]

    labels = labels.select(id_col, F.col(label_col).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col(id_col).isNotNull()
    ).distinct()
    texts = docs.select(id_col, F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = _maybe_labelled(texts, labels, id_col).join(labels, id_col).select("label", "lang", "text")
    return (
        map_texts(known, "text", "x binary", hashed, drop=("text",))
        .withColumn("h", F.xxhash64("x", "lang"))
        .dropDuplicates(["h", "label"])
    )


def known_buckets(rows: DataFrame) -> np.ndarray:
    """Buckets in at least ``MIN_DOCS`` rows; a task adds up its own rows first."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for d in _hashed(b.column(0)):
                total[np.unique(d)] += 1
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], names=["bucket", "n"])

    counts = rows.select("x").mapInArrow(seen, "bucket int, n long")
    known = counts.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_DOCS)
    return np.sort(known.select("bucket").toArrow().column(0).to_numpy())  # at most BUCKETS


_UNIT = float(1 << 32)  # changes of weights are added as whole numbers of 1 / _UNIT


def learn_round(rows: DataFrame, model: ToxicityModel, count: dict[int, int], shards: int, turn: int) -> ToxicityModel:
    """The mean of what the shards learn from ``model``."""
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    fields = [f"d{i}" for i in range(DIM)]

    def shard(table: pa.Table) -> pa.Table:
        let_go()
        toxic = table.column("label").to_numpy().astype(np.float32)
        order = np.lexsort([toxic, table.column("h").to_numpy()])
        docs, toxic = _hashed(table.column("x")), toxic[order]
        docs = [docs[i] for i in order]
        own, at = part_for(shipped.value, docs)
        before = flat(own)
        learn(own, docs, toxic, costs(toxic, count), turn)
        change = np.rint((flat(own).astype(np.float64) - before) * _UNIT).astype(np.int64)
        moved = np.flatnonzero(change.any(1))
        known = len(shipped.value.embedding)
        at = np.concatenate([at, np.arange(known, known + len(change) - len(at))])[moved]
        arrays = [pa.array(at.astype(np.int32)), *(pa.array(change[moved, i]) for i in range(DIM))]
        del docs, own, before, change
        give_back()
        return pa.Table.from_arrays(arrays, names=["k", *fields])

    changes = (
        rows.select("label", "h", "x", F.pmod("h", F.lit(shards)).alias("shard"))
        .groupBy("shard")
        .applyInArrow(shard, "k int, " + ", ".join(f"{f} long" for f in fields))
    )
    mean = changes.groupBy("k").agg(F.count("*").alias("n"), *[F.sum(f).alias(f) for f in fields]).toArrow()  # a row per weight row
    weights = flat(model).astype(np.float64)
    total = np.stack([mean.column(f).to_numpy() for f in fields], axis=1)
    weights[mean.column("k").to_numpy()] += total / mean.column("n").to_numpy()[:, None] / _UNIT
    release(spark, shipped)
    return with_weights(model, weights.astype(np.float32))


def _told(model: ToxicityModel, rows: DataFrame) -> DataFrame:
    """(lang, label, bin, n): rows counted by their logit."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("int")
    def bins(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            z = np.clip(shipped.value.logits(_hashed(a)).astype(float), -30, 30)
            yield pa.array(np.floor(z * STEPS_OF_LOGIT).astype(np.int32))

    return stored(rows.withColumn("bin", bins("x")).groupBy("lang", "label", "bin").agg(F.count("*").alias("n")), "calibration")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def calibrate(model: ToxicityModel, rows: DataFrame) -> None:
    """Shift the bias so that the best cut lies at 0.5, and set the languages' thresholds."""
    told = _told(model, rows)
    logit = lambda b: (b.astype(float) + 0.5) / STEPS_OF_LOGIT
    columns = lambda df, *names: [df.column(c).to_numpy(zero_copy_only=False) for c in names]
    # a row for each label and step of the score, 12,000 at most
    b, y, n = columns(told.groupBy("bin", "label").agg(F.sum("n").alias("n")).toArrow(), "bin", "label", "n")
    cut = min(max(best_threshold(_sigmoid(logit(b)), y, n), 1e-6), 1 - 1e-6)
    shift = float(np.log(cut / (1 - cut)))
    model.offset -= shift
    langs = told.filter("label = 1 AND lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_TOXIC)
    table = told.join(langs.select("lang"), "lang").select("lang", "bin", "label", "n").toArrow()
    of, b, y, n = columns(table, "lang", "bin", "label", "n")
    for lang in sorted(set(of)):
        own = of == lang
        model.by_lang[lang] = best_threshold(_sigmoid(logit(b[own]) - shift), y[own], n[own])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "toxic",
    lang_col: str = "lang",
) -> ToxicityModel:
    """Learn from all rows of ``labels`` (id, 0/1); everything else is unlabelled."""
    with short_lived_shuffles(docs.sparkSession):
        return _fit(labelled_rows(docs, labels, text_col, id_col, label_col, lang_col))


def _fit(labelled: DataFrame) -> ToxicityModel:
    rows = stored(labelled, "labelled")
    apart = F.pmod(F.shiftrightunsigned("h", 32), F.lit(4)) == 0
    count = {(r["label"], r["apart"]): r["count"] for r in rows.groupBy("label", apart.alias("apart")).count().collect()}
    kinds = {y for y, _ in count}
    if len(kinds) < 2:
        z = np.zeros(0, np.float32)
        return ToxicityModel(z, z, [], z, z, 0.0, constant=float(1 in kinds))
    if len(count) < 4:  # too few rows to set some apart
        own, held = rows, rows
        count = {y: sum(n for (k, _), n in count.items() if k == y) for y in (0, 1)}
    else:
        own, held = rows.filter(~apart), rows.filter(apart)
        count = {y: count[y, False] for y in (0, 1)}
    model = start(known_buckets(own))
    for turn in range(EPOCHS):
        model = learn_round(own, model, count, max(1, round(sum(count.values()) / SHARD)), turn)
    calibrate(model, held)
    discard(rows)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the double column ``out``, from the whole text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS

    @F.arrow_udf("double")
    def score(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            out: list[float] = []
            held: list[np.ndarray] = []
            n = 0
            for t in values(a):
                held.append(hash_words(t))
                n += len(held[-1])
                if n >= 4 * SLICE:
                    out += shipped.value.scores(held).tolist()
                    held, n = [], 0
            yield pa.array(out + shipped.value.scores(held).tolist(), pa.float64())

    return docs.withColumn(out, score.asNondeterministic()(utf8(text_col)))


def is_toxic(model: ToxicityModel, score_col: str, lang_col: str):
    """The calibrated decision: the score against its language's threshold."""
    cut = F.lit(model.threshold)
    for lang, at in sorted(model.by_lang.items()):
        cut = F.when(F.col(lang_col) == lang, at).otherwise(cut)
    return F.col(score_col) >= cut
