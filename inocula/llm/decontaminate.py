r"""Benchmark decontamination: one Aho-Corasick automaton over normalised items.

Texts are normalised to their words: A-Z lower-cased, runs of characters
outside ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``.  Each item gives its windows of
``window`` consecutive words (an item of fewer, but not none, is one window).
Every distinct window, framed by spaces, is one pattern of the automaton, so
a pattern only matches whole words.  Each document is normalised and scanned
once; a hit marks the document words it covers, and runs of marked words are
mapped back to character offsets of the original text.

The automaton is broadcast.  Its size follows the items, not the documents,
and is checked: above ``block_bytes`` of pattern text the windows are dealt
into blocks by hash, and one block at a time is read, broadcast, scanned for
and given back; each scan's hits are stored by the text's SHA-256 and united
at the end.

Defined results: null or word-less text has no words and no hits; null item
text is no item; an item_id may repeat (its windows are united); a null
item_id is the item ''; an empty item table marks nothing; an existing column
named ``out`` is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored, utf8, values, words

WINDOW = 10
BLOCK_BYTES = 64 << 20

HITS = "struct<items:array<string>,runs:array<struct<first:long,end:long>>>"  # runs of words
RESULT = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:long,end:long>>>"
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _window_keys(text: bytes, window: int) -> list[bytes]:
    w = words(text)
    if not w:
        return []
    if len(w) < window:
        return [b" ".join(w)]
    return [b" ".join(w[i : i + window]) for i in range(len(w) - window + 1)]


def item_windows(items: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(win, item_ids): every distinct window with the sorted items that have it."""

    @F.arrow_udf("array<binary>")
    def cut(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([_window_keys(t, window) for t in values(a)], pa.list_(pa.binary()))

    return (
        items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), utf8(text_col).alias("t"))
        .select("item", F.explode(cut("t")).alias("win"))
        .groupBy("win")
        .agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    )


def _shipped(windows: DataFrame):
    """Broadcast of a block of windows, read one partition at a time."""
    rows = [(bytes(r["win"]), list(r["item_ids"])) for r in windows.toLocalIterator()]
    return windows.sparkSession.sparkContext.broadcast(pickle.dumps(rows))


def _automaton(block):
    import ahocorasick

    a = ahocorasick.Automaton()
    for win, ids in block:
        a.add_word(" " + win.decode("latin-1") + " ", (win.count(b" ") + 1, len(win) + 2, ids))
    a.make_automaton()
    return a


def _covered(line: bytes, hits: list[tuple[int, tuple]]) -> np.ndarray:
    """Marks per word of the normalised text: inside some occurrence or not."""
    n = line.count(b" ") - 1
    word_at = np.cumsum(np.frombuffer(line, np.uint8) == 32) - 1  # index of the word after each space
    edge = np.zeros(n + 1, np.int64)
    for end, (n_words, size, _) in hits:
        first = word_at[end - size + 1]
        edge[first] += 1
        edge[first + n_words] -= 1
    return np.cumsum(edge[:-1]) > 0


def _spans(text: bytes, marked: np.ndarray) -> list[dict]:
    """Runs of marked words as character offsets [start, end) of the original."""
    from .common import WORD_TABLE

    inside = np.frombuffer(text.translate(WORD_TABLE), np.uint8) != 32
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    run = np.diff(marked.astype(np.int8), prepend=0, append=0)
    chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # characters up to and with each byte
    return [
        {"start": int(chars[starts[a]]) - 1, "end": int(chars[ends[b - 1] - 1])}
        for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1), strict=True)
    ]


def _line(w: list[bytes]) -> bytes:
    return b" " + b" ".join(w) + b" " if w else b""


def _hits(auto, line: bytes) -> tuple[list[str], np.ndarray]:
    """Items with an occurring window, and the marks of the words."""
    hits = list(auto.iter(line.decode("latin-1"))) if len(auto) else []  # no windows: nothing to search for
    if not hits:
        return [], np.zeros(0, bool)
    return sorted({x for _, (_, _, ids) in hits for x in ids}), _covered(line, hits)


def _results(n_words: list[int], n_hit: list[int], items: list[list[str]], spans: list[list[dict]]) -> pa.Array:
    return pa.StructArray.from_arrays(
        [
            pa.array(n_words, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array(items, pa.list_(pa.string())),
            pa.array(spans, _SPANS),
        ],
        names=["n_words", "n_hit", "items", "spans"],
    )


def _scan_whole(block):
    """The result of a text when all windows are in one block."""

    def scan(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto = _automaton(pickle.loads(block.value))
        for a in it:
            n_words, n_hit, items, spans = [], [], [], []
            for t in values(a):
                w = words(t)
                found, marked = _hits(auto, _line(w))
                n_words.append(len(w))
                n_hit.append(int(marked.sum()))
                items.append(found)
                spans.append(_spans(t, marked) if found else [])
            yield _results(n_words, n_hit, items, spans)

    return F.arrow_udf(_typed(scan), RESULT).asNondeterministic()  # scanned once: not copied into filters


def _scan_block(block):
    """Items and runs of words that one block's windows hit in a text."""

    def scan(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto = _automaton(pickle.loads(block.value))
        for a in it:
            items, runs = [], []
            for t in values(a):
                found, marked = _hits(auto, _line(words(t)))
                step = np.diff(marked.astype(np.int8), prepend=0, append=0)
                items.append(found)
                runs.append(
                    [{"first": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
                )
            yield pa.StructArray.from_arrays([pa.array(items, pa.list_(pa.string())), pa.array(runs, _RUNS)], names=["items", "runs"])

    return F.arrow_udf(_typed(scan), HITS).asNondeterministic()


def _united(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """The result of a text from the hits of all blocks."""
    for texts, items, runs in it:
        n_words, n_hit, items_of, spans = [], [], [], []
        for t, found, parts in zip(values(texts), values(items), values(runs), strict=True):
            marked = np.zeros(len(words(t)), bool)
            for r in parts or []:
                marked[r["first"] : r["end"]] = True
            n_words.append(len(marked))
            n_hit.append(int(marked.sum()))
            items_of.append(sorted(set(found or [])))
            spans.append(_spans(t, marked) if found else [])
        yield _results(n_words, n_hit, items_of, spans)


def mark_contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    out: str = "contamination",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, items, spans."""
    windows = stored(item_windows(items, window, item_col, item_text_col), "windows")
    size = windows.agg(F.sum(F.octet_length("win") + F.octet_length(F.concat_ws("", "item_ids")))).first()[0] or 0
    blocks = -(-size // block_bytes)
    if blocks <= 1:
        return docs.withColumn(out, _scan_whole(_shipped(windows))(utf8(text_col)))
    key = F.sha2(utf8(text_col), 256)
    hits = []
    for k in range(blocks):
        block = _shipped(windows.filter(F.pmod(F.xxhash64("win"), F.lit(blocks)) == k))
        found = docs.select(key.alias("tkey"), _scan_block(block)(utf8(text_col)).alias("h")).filter(F.size("h.items") > 0)
        hits.append(stored(found.groupBy("tkey").agg(F.first("h").alias("h")), "block-hits"))
        release(docs.sparkSession, block)
    per_text = (
        reduce(DataFrame.union, hits)
        .groupBy("tkey")
        .agg(F.flatten(F.collect_list("h.items")).alias("__inocula_items"), F.flatten(F.collect_list("h.runs")).alias("__inocula_runs"))
        .withColumnRenamed("tkey", "__inocula_key")
    )
    finish = F.arrow_udf(_typed(_united, Iterator[tuple[pa.Array, ...]]), RESULT).asNondeterministic()
    joined = docs.join(per_text, key == F.col("__inocula_key"), "left")
    return joined.withColumn(out, finish(utf8(text_col), "__inocula_items", "__inocula_runs")).drop(
        "__inocula_key", "__inocula_items", "__inocula_runs"
    )


def _typed(f, source=Iterator[pa.Array]):
    f.__annotations__ = {"it": source, "return": Iterator[pa.Array]}
    return f
