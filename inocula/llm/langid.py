"""Language ID by compression: one raw-content zstandard dictionary per language.

A text is reduced to its lower-cased words (case, digits and punctuation say
little about the language) and cut into blocks of words; every block of the
whole text is compressed with each language's dictionary, and the language
with the smallest total wins.  A dictionary is text of a bounded sample of
labelled rows.

``best`` is always the smallest; ``lang`` is 'und' where the margin to the
second smallest is under ``min_margin`` of its size: rejected.  A text with
no letter, or null, has best = lang = 'und' and score 0.  Equal sizes go to
the language with more labelled rows, then by name.

The sample: rows are dealt into ``buckets`` by the hash of their text, and
each language keeps the least hash of each bucket, so it is at most
``buckets`` texts a language whatever the size of the table, and copies of a
text count once.  More than ``max_langs`` labels are an error, as each text
is compressed once per language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8, values

BUCKETS = 64  # texts per language at most
DICT_BYTES = 32 << 10
PIECES = 4  # of a text in a dictionary
MAX_LANGS = 256
BLOCK_WORDS = 1024
MIN_MARGIN = 0.004
SCALE = 4.0  # bytes of difference that count as one step of the score

RESULT = "struct<best:string,lang:string,score:double,margin:double>"
_TYPE = pa.struct([("best", pa.string()), ("lang", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])


@dataclass(frozen=True)
class LanguageModel:
    """Languages by falling number of rows, with the content of each dictionary."""

    langs: list[str]
    contents: list[bytes]


def fit_languages(
    rows: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    buckets: int = BUCKETS,
    dict_bytes: int = DICT_BYTES,
    max_langs: int = MAX_LANGS,
) -> LanguageModel:
    """Learn from the labelled rows (non-null language and text)."""
    rows = (
        rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
        .filter("lang is not null and text rlike '\\\\p{L}'")
        .withColumn("h", F.xxhash64("text"))
    )
    least = (
        rows.groupBy("lang", F.pmod("h", F.lit(buckets)).alias("b"))
        .agg(F.min("h").alias("h"), F.count("*").alias("n"))
        .select("lang", "h", F.sum("n").over(_by_lang()).alias("n"))
    )
    least = least.limit(max_langs * buckets + 1).collect()
    count = {r["lang"]: r["n"] for r in least}
    if len(count) > max_langs or len(least) > max_langs * buckets:
        raise ValueError(f"more than {max_langs} language labels")
    langs = sorted(count, key=lambda x: (-count[x], x))
    own = Counter(r["lang"] for r in least)
    chosen = rows.sparkSession.createDataFrame(
        [(r["lang"], r["h"], dict_bytes // own[r["lang"]]) for r in least], "lang string, h long, share long"
    )
    texts = (
        rows.join(F.broadcast(chosen), ["lang", "h"])
        .groupBy("lang", "h")
        .agg(F.max(_spread("text", "share")).alias("text"))
        .collect()
    )
    contents = []
    for x in langs:
        parts = [b" ".join(normalise(r["text"].encode())) for r in sorted(texts, key=lambda r: r["h"]) if r["lang"] == x]
        contents.append(b"\n".join(parts)[-dict_bytes:])
    return LanguageModel(langs, contents)


def _spread(text: str, share: str) -> Column:
    """About ``share`` bytes of a text: all of a shorter one, else pieces of every part of it."""
    length = F.char_length(text)
    # in characters, which may have several bytes
    most = F.greatest(F.lit(1), F.floor(F.col(share) * length / F.octet_length(text)))
    size, stretch = F.ceil(most / PIECES), F.floor(length / PIECES)
    room = F.greatest(F.lit(0), stretch - size) + 1
    pieces = [
        F.substr(text, (i * stretch + F.pmod(F.xxhash64(text, F.lit(i)), room) + 1).cast("int"), size.cast("int")) for i in range(PIECES)
    ]
    return F.when(length <= most, F.col(text)).otherwise(F.concat_ws(" ", *pieces))


def _by_lang():
    from pyspark.sql import Window

    return Window.partitionBy("lang")


_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def normalise(text: bytes) -> list[bytes]:
    """Lower-cased words: letters and other non-ASCII characters only."""
    return text.decode("utf-8", "replace").lower().encode().translate(_LETTERS).split()


class Compressors:
    """One compressor per language, with its dictionary."""

    def __init__(self, model: LanguageModel):
        import zstandard as z

        settings = z.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=16, search_log=3, min_match=3, strategy=z.STRATEGY_GREEDY,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        self.langs = model.langs
        self.compress = [
            z.ZstdCompressor(
                dict_data=z.ZstdCompressionDict(c, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=settings
            ).compress
            for c in model.contents
        ]

    def sizes(self, text: bytes) -> list[int]:
        total = [0] * len(self.langs)
        own = normalise(text)
        for at in range(0, len(own), BLOCK_WORDS):
            block = b" ".join(own[at : at + BLOCK_WORDS])
            for i, f in enumerate(self.compress):
                total[i] += len(f(block))
        return total


def classify(text: bytes, by: Compressors, min_margin: float) -> dict:
    if not by.langs or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
        return {"best": "und", "lang": "und", "score": 0.0, "margin": 0.0}
    sizes = by.sizes(text)
    least = min(sizes)
    first = sizes.index(least)
    rest = sizes[:first] + sizes[first + 1 :]
    margin = (min(rest) - least) / max(1, min(rest)) if rest else 1.0
    score = 1.0 / sum(2.0 ** (-(s - least) / SCALE) for s in sizes)
    best = by.langs[first]
    return {"best": best, "lang": best if margin >= min_margin else "und", "score": score, "margin": margin}


def identify(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language", min_margin: float = MIN_MARGIN
) -> DataFrame:
    """``docs`` with the struct column ``out`` (replaced if it exists)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # languages x DICT_BYTES at most

    @F.arrow_udf(RESULT)
    def predict(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by = Compressors(shipped.value)
        for a in it:
            yield pa.array([classify(t, by, min_margin) for t in values(a)], _TYPE)

    return docs.withColumn(out, predict.asNondeterministic()(utf8(text_col)))
