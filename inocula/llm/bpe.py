r"""Byte-level BPE encoding and decoding with overlapping chunks.

The ids of a text are the ids of each match of the public pattern, encoded by
the ranks.  A text of up to ``chunk`` bytes is one chunk.  A longer one is
cut into chunks that overlap by ``overlap`` bytes; chunks are rows, so the
pieces of one very long text are worked on by many tasks:

1. every chunk is pre-tokenised on its own, and reports the pre-token
   boundaries inside the zones it shares with its neighbours;
2. two neighbours resynchronise at the first boundary that both report and
   that no white space comes before.  The pattern looks at nothing before a
   match, and past its end only after white space, so both sides give the same
   pre-tokens there: the chunks are stitched at that point.  Where no boundary
   is shared (one pre-token, or white space, longer than the overlap) they stay
   one piece;
3. the pieces are encoded in parallel and their ids put in order.

Decoding joins the raw bytes of the ids.

Pre-tokenisation works in two steps with the same result: runs of non-space
characters with the space before them never share a pre-token, so each
distinct run is split by the pattern and encoded once and then looked up.

Defined results: null text counts as empty and has no ids; equal long texts
are encoded once; an existing column named ``out`` is replaced.
"""

from __future__ import annotations

import array
import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, map_texts, stored, utf8, values

CHUNK = 32768
OVERLAP = 2048
CACHE = 1 << 17

# Unicode White_Space, as \s of the pattern reads it (fixed values).
SPACE = "".join(
    map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
_RUN = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def check_pattern(pattern: str) -> None:
    """Runs, and the places where chunks are stitched, are those of one pattern."""
    if pattern != PATTERN:
        raise ValueError("the pattern of public_tokenizers is the one that texts can be cut for")


class RunIds(dict):
    """Run of text -> its ids as little-endian int32 bytes; forgets all when full."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        check_pattern(pattern)

        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={}
        )

    def __missing__(self, run: str) -> bytes:
        ids = array.array("i", self.encoding.encode_ordinary(run)).tobytes()
        if len(run) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[run] = ids
        return ids


def run_ids(ranks_path: str, pattern: str) -> RunIds:
    """One per Python worker: kept over the tasks it runs."""
    return held(("run ids", ranks_path, pattern), lambda: RunIds(ranks_path, pattern))


def encode_text(text: str, ids: RunIds) -> bytes:
    return b"".join(map(ids.__getitem__, _RUN.findall(text)))


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _list_array(rows: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _encode_udf(ranks_path: str, pattern: str):
    @F.arrow_udf("array<int>")
    def encode(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = run_ids(ranks_path, pattern)
        for a in it:
            yield _list_array([encode_text(_text(t), ids) for t in values(a)])

    return encode.asNondeterministic()


def cut_chunks(text: bytes, chunk: int, overlap: int) -> list[dict]:
    """Chunks at character boundaries: [k * chunk, (k + 1) * chunk + overlap)."""

    def whole(at: int) -> int:
        at = min(at, len(text))
        while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
            at -= 1
        return at

    out = []
    for no, at in enumerate(range(0, max(1, len(text)), chunk)):
        lo, hi = whole(at), whole(at + chunk + overlap)
        out.append({"no": no, "start": lo, "body": text[lo:hi], "last": hi == len(text)})
        if hi == len(text):
            break
    return out


def zone_boundaries(body: bytes, start: int, last: bool, pattern, chunk: int, overlap: int) -> tuple[list, list]:
    """Pre-token ends inside the zones shared with the chunk before and after.

    The end of a chunk that is not the text's end cuts a pre-token and hides
    what follows it, so the last two boundaries there do not count.  A boundary
    after white space does not count either: the pattern looks at what follows
    white space, which a piece that ends there would not show.
    """
    text, at, ends = _text(body), start, []
    done = 0
    for m in pattern.finditer(text):
        at += len(text[done : m.end()].encode())
        done = m.end()
        ends.append((at, text[done - 1] in SPACE))
    if not last:
        ends = ends[:-2]
    head = [e for e, space in ends if not space and e <= start + overlap]
    # a chunk that starts inside a pre-token agrees with its text after at most two runs
    tail = [] if last else [e for e, space in (ends[3:] if start else ends) if not space and e >= start + chunk - 4]
    return head, tail


def _long_ids(texts: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(h, ids) for (h, t) with every t longer than a chunk."""

    @F.arrow_udf("array<struct<no:int,start:long,body:binary,last:boolean>>")
    def chunks(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(
            pa.struct([("no", pa.int32()), ("start", pa.int64()), ("body", pa.binary()), ("last", pa.bool_())])
        )
        for a in it:
            yield pa.array([cut_chunks(t, chunk, overlap) for t in values(a)], kind)

    @F.arrow_udf("struct<head:array<long>,tail:array<long>>")
    def zones(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        import regex

        compiled = regex.compile(pattern)
        kind = pa.struct([("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
        for body, start, last in it:
            found = [
                zone_boundaries(b, s, e, compiled, chunk, overlap)
                for b, s, e in zip(values(body), values(start), values(last), strict=True)
            ]
            yield pa.array([{"head": h, "tail": t} for h, t in found], kind)

    encode = _encode_udf(ranks_path, pattern)
    by_text = Window.partitionBy("h").orderBy("no")
    cut_up = (
        texts.select("h", F.explode(chunks("t")).alias("c"))
        .select("h", "c.*")
        .repartition("h", "no")  # the chunks of one text spread over the tasks
        .withColumn("z", zones.asNondeterministic()("body", "start", "last"))
    )
    cut_up = stored(cut_up, "chunks")
    # boundaries alone go through the rows of one text; bodies are met again by chunk
    bounds = (
        cut_up.select("h", "no", "start", "z", F.octet_length("body").alias("size"))
        # where this chunk takes over from the one before; null: they stay one piece
        .withColumn("cut", F.array_min(F.array_intersect("z.head", F.lag("z.tail").over(by_text))))
        .withColumn("next_cut", F.lead("cut").over(by_text))
        .withColumn("next_start", F.lead("start").over(by_text))
        .withColumn("from", F.when(F.col("no") == 0, F.lit(0)).otherwise(F.coalesce("cut", "start")))
        .withColumn("to", F.coalesce("next_cut", "next_start", F.col("start") + F.col("size")))
        .withColumn("piece", F.sum(F.when((F.col("no") == 0) | F.col("cut").isNotNull(), 1).otherwise(0)).over(by_text))
        .select("h", "no", "piece", "from", "to")
    )
    pieces = (
        cut_up.select("h", "no", "start", "body")
        .join(bounds, ["h", "no"])
        .select("h", "piece", "no", F.expr("substring(body, int(`from` - start) + 1, int(`to` - `from`))").alias("body"))
        .groupBy("h", "piece")
        .agg(F.sort_array(F.collect_list(F.struct("no", "body"))).alias("parts"))
        .select("h", "piece", encode(F.expr("aggregate(parts, cast('' as binary), (s, p) -> concat(s, p.body))")).alias("ids"))
    )
    return pieces.groupBy("h").agg(F.flatten(F.sort_array(F.collect_list(F.struct("piece", "ids"))).ids).alias("ids"))


def _decoder(ranks_path: str):
    """Ids -> the bytes that they stand for."""
    encoding = run_ids(ranks_path, PATTERN).encoding
    return lambda ids: encoding.decode_bytes(ids)


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    text_col: str = "text",
    out: str = "ids",
    decoded: str | None = None,
    drop: tuple[str, ...] = (),
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``docs`` without ``drop``, with the array<int> column ``out`` of each whole text's ids.

    ``decoded`` names a column for the bytes that the ids decode to; short
    texts' ids are then decoded by the task that encoded them.
    """
    check_pattern(pattern)
    docs = docs.drop(*(c for c in (out, decoded) if c))
    size = F.octet_length(utf8(text_col))
    fields = f"`{out}` array<int>" + (f", `{decoded}` binary" if decoded else "")

    def compute(texts: list[bytes]) -> list[pa.Array]:
        ids = run_ids(ranks_path, pattern)
        rows = [encode_text(_text(t), ids) for t in texts]
        got = [_list_array(rows)]
        if decoded:
            decode = _decoder(ranks_path)
            got.append(pa.array([decode(np.frombuffer(r, np.int32).tolist()) for r in rows], pa.binary()))
        return got

    short = map_texts(docs.filter(size <= chunk), text_col, fields, compute, drop)
    key = "__inocula_text_key"
    long = docs.filter(size > chunk).withColumn(key, F.sha2(utf8(text_col), 256))
    texts = long.groupBy(F.col(key).alias("h")).agg(F.first(utf8(text_col)).alias("t"))
    ids = _long_ids(texts, ranks_path, pattern, chunk, overlap).select(F.col("h").alias(key), F.col("ids").alias(out))
    if decoded:
        ids = decode_ids(ids, ranks_path, out, decoded)
    return short.unionByName(long.drop(*drop).join(ids, key).select(*short.columns))


def decode_ids(docs: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the binary column ``out``: the raw bytes of the ids joined."""

    @F.arrow_udf("binary")
    def decode(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        join = _decoder(ranks_path)
        for a in it:
            yield pa.array([join(v or ()) for v in values(a)], pa.binary())

    return docs.withColumn(out, decode(F.col(ids_col)))
