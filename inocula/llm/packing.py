"""Packing of documents into fixed windows of ids, by non-negative least squares.

A document is its ids and an end id.  Its full windows are sequences of their
own; what is left, fewer ids than a window, is its remainder.

1. Histogram.  Remainders fall into classes of ``grid`` lengths; Spark counts
   them (at most window / grid rows reach the driver, whatever the input).
2. Plan.  All combinations of at most ``depth`` classes that fill a window are
   enumerated; non-negative least squares finds how often to repeat each so
   that the combinations use up the histogram.  Counts are rounded, never
   above what is left of a class, and the rest is solved again.
3. Windows.  The k-th remainder of a class takes the class's k-th place in the
   plan.  A class is named by its least length, so a combination fills its
   window or runs over by less than ``depth * grid`` ids: the last and longest
   remainder is cut where the window ends.
4. Residuals.  Remainders without a place and the ids cut off are laid end to
   end and packed greedily: a window takes what comes next, and is cut where it
   is full.  The last, partly filled window is cut at the powers of two of its
   length, so that no sequence needs padding.

Ranks and positions are sums in two steps (inside the rows of one task, then
over tasks), so no class, window or stream passes through one task.  Ids are
computed once, stored, and joined with the plan by row.

Defined results: null text counts as empty and has the end id alone; rows with
equal ids (or a null id) are documents of their own; columns but the id are
left out; an empty table gives no pieces.
"""

from __future__ import annotations

import array
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPACE
from .common import held, stored, utf8, values

WINDOW = 2048
GRID = 16
DEPTH = 3
CACHE = 3 << 18
ROWS = 256  # documents, or pieces, that leave a task at once

# a space between other white space need not start a pre-token
_UNSURE = re.compile(f"[{SPACE}] (?:[{SPACE}]|\\Z)")


# ---- ids ---------------------------------------------------------------------


class ChunkIds(dict):
    """Text between two spaces -> ids of it with a space before it, as little-endian uint32 bytes.

    Where a space follows or precedes a character that is no white space, a
    pre-token of the byte-level pre-tokenizer starts with it, so the chunks of
    a text at its spaces can be encoded apart and looked up again.  The merge
    loop is tiktoken's, on the tokenizer's own vocabulary: its ids are the order
    of its merges (checked on loading, otherwise the tokenizer itself is asked).
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = _merge_loop(path) or (lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids)
        self.stops = {c: self.whole(c) for c in ".,"}

    def whole(self, text: str) -> bytes:
        return array.array("I", self.merge(text)).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        # a full stop or comma after an ASCII letter is a pre-token of its own
        if len(chunk) > 1 and chunk[-1] in ".," and chunk[-2].isascii() and chunk[-2].isalpha():
            ids = self[chunk[:-1]] + self.stops[chunk[-1]]
        else:
            ids = self.whole(" " + chunk)
        if len(chunk) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if _UNSURE.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


def _merge_loop(path: str):
    """tiktoken's encoder over a byte-level BPE file, or None where ids are not the merges' order."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import pre_tokenizers

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model["normalizer"] or any(model["pre_tokenizer"].get(k) != v for k, v in plain.items()):
        return None
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    # how the file writes each byte, seen from characters that begin with every lead byte of UTF-8
    seen = [*range(0x100), *range(0x100, 0x800, 64), 0x800, *range(0x1000, 0x10000, 0x1000), *range(0x10000, 0x110000, 0x40000)]
    byte_of = {}
    for c in seen:
        for b, s in zip(chr(c).encode(), shown(chr(c))[0][0], strict=True):
            byte_of[s] = b
    for b in set(range(256)) - set(byte_of.values()):  # no byte of UTF-8
        byte_of[chr(b)] = b
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    added = {t["content"] for t in model["added_tokens"]}
    ranks = {bytes(map(byte_of.__getitem__, s)): i for s, i in vocab.items() if s not in added}
    if [vocab[a + b] for a, b in pairs] != list(range(256, 256 + len(pairs))) or len(ranks) != 256 + len(pairs):
        return None
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def chunk_ids(path: str) -> ChunkIds:
    """One per Python worker: kept over the tasks it runs."""
    return held(("chunk ids", path), lambda: ChunkIds(path))


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int, text_col: str, id_col: str, window: int, grid: int) -> DataFrame:
    """(row, id, n, cls, nth, full_before, ids) of every document, stored.

    ``cls`` is the remainder's class (null: no remainder), ``nth`` its number
    among the task's remainders of that class, ``full_before`` the full windows
    of the task's earlier documents.
    """
    kind = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
    made = [("n", pa.int64()), ("cls", pa.int32()), ("nth", pa.int64()), ("full_before", pa.int64()), ("ids", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = None, np.array([end_id], "<u4").tobytes()
        seen, full = Counter(), 0
        for batch in batches:
            ids = ids or chunk_ids(tokenizer_path)
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = []
                for text in values(part.column(2)):
                    flat = np.frombuffer(ids.encode(text.decode("utf-8", "replace")) + end, "<u4")
                    rest = len(flat) % window
                    cls = rest // grid if rest else None
                    out.append((len(flat), cls, seen[cls], full, flat.astype(kind).tobytes()))
                    seen[cls] += 1
                    full += len(flat) // window
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), made, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *columns], names=["row", "id", *(name for name, _ in made)]
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return stored(
        rows.mapInArrow(run, f"row long, id {id_type}, n long, cls int, nth long, full_before long, ids binary"), "token-rows"
    )


# ---- the plan ------------------------------------------------------------------


def combinations(total: int, depth: int, least: int = 1) -> list[tuple[int, ...]]:
    """Ascending tuples of at most ``depth`` classes from ``least`` on that add up to ``total``."""
    out = [(total,)] if total >= least else []
    if depth > 1:
        for c in range(least, total // 2 + 1):
            out += [(c, *rest) for rest in combinations(total - c, depth - 1, c)]
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least ||a x - b||: Lawson and Hanson's active sets."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(10 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[passive] = -np.inf
        best = int(np.argmax(slope)) if n else 0
        if not n or slope[best] <= tolerance:
            break
        passive[best] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (s <= tolerance)
            if not low.any():
                x = s
                break
            step = np.where(x[low] - s[low] > 0, x[low] / np.maximum(x[low] - s[low], 1e-300), 0).min()
            x = x + step * (s - x)
            passive &= x > tolerance
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan_windows(histogram: dict[int, int], total: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, times) whose classes are all there; the rest is too little to fill windows."""
    left = np.array([histogram.get(c, 0) for c in range(total + 1)], np.int64)
    left[0] = 0
    ways = [w for w in combinations(total, depth) if len(w) > 1]
    uses = np.zeros((total + 1, len(ways)))
    for k, way in enumerate(ways):
        for c in way:
            uses[c, k] += 1
    plan: Counter = Counter()
    while True:
        possible = (uses <= left[:, None]).all(axis=0)
        which = np.flatnonzero(possible)
        x = nnls(uses[:, which], left.astype(float))
        placed = 0
        for k in which[np.argsort(-x, kind="stable")]:
            need = uses[:, k].astype(np.int64)
            times = int(min(np.floor(x[np.searchsorted(which, k)] + 0.5), (left[need > 0] // need[need > 0]).min()))
            if times > 0:
                plan[ways[k]] += times
                left -= times * need
                placed += times
        if placed * 100 <= sum(plan.values()):
            return sorted(plan.items())


def places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(cls, lo, hi, times, first, slot): ranks lo..hi-1 of a class stand in windows from ``first`` on,
    ``times`` of them in each, from place ``slot`` on."""
    out, used, first = [], Counter(), 0
    for way, windows in plan:
        for cls, times in sorted(Counter(way).items()):
            lo = used[cls]
            used[cls] += windows * times
            out.append((cls, lo, used[cls], times, first, way.index(cls)))
        first += windows
    return out


def _before(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(part, *by, before): what the parts of less number hold of ``value``.  One row a task and class."""
    order = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part", *by).agg(F.sum(value).alias("s"))
    return sums.select("part", *by, F.coalesce(F.sum("s").over(order), F.lit(0)).alias("before"))


def _last_bins(length: int, window: int) -> list[tuple[int, int]]:
    """(start, end) of the powers of two that add up to ``length``, largest first."""
    out, at = [], 0
    for size in (1 << k for k in reversed(range(window.bit_length()))):
        if length & size:
            out.append((at, at + size))
            at += size
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    vocabulary: int,
    text_col: str = "text",
    id_col: str = "doc_id",
    window: int = WINDOW,
    grid: int = GRID,
    depth: int = DEPTH,
) -> DataFrame:
    """A row per piece: ``id_col``, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the piece's ids as little-endian uint32 bytes, ``start`` the
    ids of its document before it, ``offset`` those of its sequence before it.
    """
    if window % grid or window < depth * depth * grid:
        raise ValueError("a window is whole grid steps, and at least depth * depth of them")
    spark = docs.sparkSession
    rows = token_rows(docs, tokenizer_path, end_id, vocabulary, text_col, id_col, window, grid)
    sizes = rows.select(
        "row", F.shiftright("row", 33).alias("part"), "n", F.expr(f"n div {window}").alias("full"), F.expr(f"n % {window}").alias("rest"), "cls", "nth"
    )
    left = sizes.filter("cls is not null")

    # ranks inside a class, and the plan
    earlier = stored(_before(left.withColumn("one", F.lit(1)), "one", ["cls"]), "class-ranks")
    histogram = {r["cls"]: r["count"] for r in left.groupBy("cls").count().collect()}
    plan = plan_windows(histogram, window // grid, depth)
    n_planned = sum(times for _, times in plan)
    table = spark.createDataFrame(places(plan), "c int, lo long, hi long, times int, first long, slot int")
    rank = F.col("before") + F.col("nth")
    inside = (F.col("cls") == F.col("c")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    ranked = left.join(earlier, ["part", "cls"]).withColumn("rank", rank)
    nth = F.col("rank") - F.col("lo")
    # the table has a row per class and combination of the plan, bounded by grid and depth
    seated = ranked.join(F.broadcast(table), inside, "left").select(
        "row", "part", (F.col("full") * window).alias("start"), "rest",
        (F.col("first") + F.floor(nth / F.col("times"))).alias("seq"), (F.col("slot") + nth % F.col("times")).alias("slot"),
    )
    seated = stored(seated, "seats")
    by_place = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        seated.filter("seq is not null")
        .withColumn("offset", F.coalesce(F.sum("rest").over(by_place), F.lit(0)))
        .withColumn("length", F.least("rest", F.lit(window) - F.col("offset")))
    )

    # what has no place, end to end
    over = heads.filter("rest > length").select("row", "part", (F.col("start") + F.col("length")).alias("start"), (F.col("rest") - F.col("length")).alias("length"))
    stream = seated.filter("seq is null").select("row", "part", "start", F.col("rest").alias("length")).union(over)
    in_part = Window.partitionBy("part").orderBy("row", "start").rowsBetween(Window.unboundedPreceding, -1)
    stream = stored(stream, "stream")
    at = F.col("before") + F.coalesce(F.sum("length").over(in_part), F.lit(0))
    laid = stream.join(_before(stream, "length", []), "part").select("row", "start", "length", at.alias("at"))
    n_stream = stream.agg(F.sum("length")).first()[0] or 0
    n_whole = n_stream // window
    bins = _last_bins(n_stream % window, window)
    one = F.array(F.struct(F.lit(0).alias("lo"), F.lit(window).alias("hi"), F.lit(0).alias("no")))
    last = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(k).alias("no")) for k, (a, b) in enumerate(bins)]) if bins else one
    ends = F.expr(f"sequence(at div {window}, (at + length - 1) div {window})")
    lo = F.greatest("at", F.col("k") * window + F.col("b.lo"))
    hi = F.least(F.col("at") + F.col("length"), F.col("k") * window + F.col("b.hi"))
    tails = (
        laid.withColumn("k", F.explode(ends))
        .withColumn("b", F.explode(F.when(F.col("k") < n_whole, one).otherwise(last)))
        .withColumns({"from": lo, "to": hi})
        .filter("`from` < `to`")
        .select(
            "row",
            (F.col("start") + F.col("from") - F.col("at")).alias("start"),
            (F.col("to") - F.col("from")).alias("length"),
            (F.lit(n_planned) + F.col("k") + F.col("b.no")).alias("seq"),
            (F.col("from") - F.col("k") * window - F.col("b.lo")).alias("offset"),
        )
    )
    pieces = heads.select("row", "start", "length", "seq", "offset").union(tails)
    # a remainder, shorter than a window, has few pieces: its place, and the stream's cuts
    cuts = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "seq", "offset"))).alias("cuts"))

    first_full = F.col("before") + n_planned + n_whole + len(bins)
    fulls = _before(sizes, "full", [])
    # small rows first: the ids are shuffled once
    told = sizes.select("row", "part").join(fulls, "part").select("row", first_full.alias("first")).join(cuts, "row", "left")
    return _cut(rows.join(told, "row"), id_col, docs.schema[id_col].dataType.simpleString(), vocabulary, window)


def _cut(rows: DataFrame, id_col: str, id_type: str, vocabulary: int, window: int) -> DataFrame:
    """The pieces with their ids, from documents with their cuts."""
    kind = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_type, out = b.column(0).type, []

            def batch(out, id_type=id_type):
                types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                return pa.RecordBatch.from_arrays(columns, names=names)

            for doc, n, first, raw, cuts in zip(*map(values, b.columns), strict=True):
                ids = np.frombuffer(raw, kind)
                full = [{"start": k * window, "length": window, "seq": first + k, "offset": 0} for k in range(n // window)]
                for c in full + (cuts or []):
                    own = ids[c["start"] : c["start"] + c["length"]].astype("<u4").tobytes()
                    out.append((doc, c["start"], c["length"], own, n, c["seq"], c["offset"]))
                    if len(out) >= ROWS:
                        yield batch(out)
                        out.clear()
            if out:
                yield batch(out)

    schema = f"`{id_col}` {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    source = rows.select("id", "n", (F.col("first") + F.col("full_before")).alias("first"), "ids", "cuts")
    return source.mapInArrow(run, schema)
