"""N-gram Jaccard join over a token-group matrix.

A document's set is its distinct word shingles, as 64-bit hashes.  Two
documents link when their sets' Jaccard similarity reaches ``percent``; the
result is each document's connected component.  Every link is checked on the
two whole sets.  Only what cannot change the components is skipped: a pair
inside one component.

1. Documents with equal sets collapse to one node.
2. Grouping.  Nodes that share a min-hash value are likely similar.  Each
   such group compares its members with two of its nodes only
   (two links a member, never all pairs), where their sizes fit and
   ``STAR_HASHES`` values agree; step 3 finds whatever this leaves out.  The
   components found are the groups: similar documents together, all others
   alone.  A second round compares groups that still share a value.
3. Token-group matrix.  A set of n tokens reaches the threshold only with a
   set that has ceil(0.8 n) of its tokens, so in any fixed order of all
   tokens the first n - ceil(0.8 n) + 3 tokens of both share three.  The
   matrix holds, per group, the union of its members' first tokens; tokens
   of one group only are dropped.  A query's overlap with a group's union
   bounds its overlap with every member: where even the size that asks least
   of the group's range asks for more (``_least_shared``), the group stays
   closed.  A query or a group whose members have too few first tokens in
   common with anyone is left out before tokens are paired.  Qualifying groups are opened, and the members that share enough
   first tokens and fit in size are compared with the query.
4. Components of all links; a component's id is its least document id.

The order puts tokens that many documents have last, so a passage in
thousands of documents does not make candidates of them.  It only has to be
the same everywhere, not exact, and comes from the documents whose text hash
is 0 modulo ``ORDER_SAMPLE`` as a bitmap of 2**CELL_BITS bits.  The bitmaps
are the only broadcasts and of that fixed size; where they fill up, more
candidates are checked, with the same result.

Defined results: null, empty and blank texts have n_shingles 0 and link with
nothing (component_id is the own id); a text of fewer words than a shingle
has one, the whole sequence; null ids are never the component's id unless it
has no other; rows with equal id and text are in one component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, held, release, stored, utf8, values

WORDS = 5
PERCENT = 80
SHARED = 3  # tokens that two prefixes must share
HASHES = 4  # min-hash values of a node
STAR_HASHES = 1  # of them that must agree before two nodes are compared for grouping
ORDER_SAMPLE = 16
CELL_BITS = 26
CACHE = 1 << 16  # words whose hashes a worker keeps

_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class WordHashes(dict):
    """Word -> 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE:
            self.clear()
        self[word] = h
        return h


def word_hashes() -> WordHashes:
    """One per Python worker."""
    return held("word hashes", WordHashes)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(text: bytes, n_words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    size = min(n_words, len(own))
    a = np.fromiter(map(word_hashes().__getitem__, own), np.uint64, len(own))
    h = np.full(len(own) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mixed(h + a[k : len(own) - size + 1 + k] * _ODD[k % 4])
    return np.unique(h)


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares at least with any set it links with."""
    return -(-n * percent // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


# ---- bitmaps of a fixed size -------------------------------------------------


def cell(token: Column) -> Column:
    return token.bitwiseAND(F.lit((1 << CELL_BITS) - 1))


def bitmap(cells: DataFrame, col: str):
    """Broadcast bitmap (2**CELL_BITS bits) of the values of ``col``."""
    at = F.col(col) + 1  # bitmap buckets count from 1
    rows = (
        cells.groupBy(F.bitmap_bucket_number(at).alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        .toLocalIterator()
    )
    out = np.zeros((1 << CELL_BITS) // 8, np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return cells.sparkSession.sparkContext.broadcast(out)


def in_bitmap(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = tokens & _U((1 << CELL_BITS) - 1)
    return (bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def _longs(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


# ---- steps ---------------------------------------------------------------------

# Functions whose result is exploded or joined on are called non-deterministic: Spark
# would copy the call into the filters that it infers from the explode or the join, and
# run it twice, each time in Python workers of its own.


def common_tokens(docs: DataFrame, text_col: str, n_words: int):
    """Bitmap of the tokens that many documents have."""

    @F.arrow_udf("array<long>")
    def tokens(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield _longs([shingles(t, n_words) for t in values(a)])

    counts = (
        docs.filter(F.pmod(F.xxhash64(text_col), F.lit(ORDER_SAMPLE)) == 0)
        .select(tokens.asNondeterministic()(utf8(text_col)).alias("tokens"))
        .select(F.explode("tokens").alias("token"))
        .groupBy(cell(F.col("token")).alias("cell"))
        .count()
    )
    counts = stored(counts.filter("count > 1"), "token-counts")
    mean = counts.agg(F.sum("count")).first()[0] or 0
    common = bitmap(counts.filter(F.col("count") >= 3 + 4 * mean / (1 << CELL_BITS)), "cell")
    discard(counts)
    return common


def describe(docs: DataFrame, text_col: str, id_col: str, common, n_words: int, percent: int) -> DataFrame:
    """(id, tkey, n, rare, digest, hashes, prefix) of every row; ``rare`` tokens are those that few documents have."""
    kind = pa.struct(
        [("n", pa.int64()), ("rare", pa.int64()), ("digest", pa.binary()), ("hashes", pa.list_(pa.int64())), ("prefix", pa.binary())]
    )

    @F.arrow_udf("struct<n:long,rare:long,digest:binary,hashes:array<long>,prefix:binary>")
    def look(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            ns, rares, digests, hashes, prefixes = [], [], [], [], []
            for t in values(a):
                s = shingles(t, n_words)
                n = len(s)
                ns.append(n)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else b"")
                hashes.append(np.array([(s * m).min() for m in _ODD[:HASHES]], np.uint64) if n else s)
                often = in_bitmap(common.value, s)
                rares.append(n - int(often.sum()))
                take = n - least_overlap(n, percent) + SHARED if n > SHARED else 0
                prefixes.append(np.concatenate([s[~often], s[often]])[:take].tobytes())
            yield pa.StructArray.from_arrays(
                [pa.array(ns, pa.int64()), pa.array(rares, pa.int64()), pa.array(digests, pa.binary()), _longs(hashes), pa.array(prefixes, pa.binary())],
                fields=list(kind),
            )

    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tkey"), look.asNondeterministic()(utf8(text_col)).alias("s")
    ).select("id", "tkey", "s.*")


def links_of(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, id_col: str, n_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of node digests whose sets link, from their whole texts."""
    need = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
    need = stored(need.join(nodes.select("digest", "rep", "tkey"), "digest"), "needed")
    wanted = bitmap(need.select(cell(F.col("tkey")).alias("cell")), "cell")

    @F.arrow_udf("boolean")
    def may_be_needed(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array(in_bitmap(wanted.value, a.to_numpy().view(np.uint64)))

    @F.arrow_udf("boolean")
    def check(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        seen: dict[bytes, np.ndarray] = {}

        def of(digest: bytes, text) -> np.ndarray:
            if digest not in seen:
                if len(seen) >= 64:
                    seen.clear()
                seen[digest] = shingles(text.as_py(), n_words)
            return seen[digest]

        for a, ta, b, tb in it:
            yield pa.array(
                [linked(of(x, tx), of(y, ty), percent) for x, tx, y, ty in zip(values(a), ta, values(b), tb, strict=True)],
                pa.bool_(),
            )

    # one key for id and text, null ids too, that joins and groups: texts are dealt once
    source = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"), F.xxhash64(text_col).alias("tkey"))
    source = source.filter(may_be_needed.asNondeterministic()("tkey")).withColumn("row", F.xxhash64("tkey", "id"))
    asked = need.select("digest", "rep", F.col("tkey").alias("t"), F.xxhash64("tkey", "rep").alias("row"))
    texts = stored(
        source.join(asked, "row")
        .filter((F.col("tkey") == F.col("t")) & F.col("id").eqNullSafe(F.col("rep")))
        .groupBy("row", "digest")
        .agg(F.first("text").alias("text"))
        .select("digest", "text"),
        "texts",
    )
    release(docs.sparkSession, wanted)
    both = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    links = stored(both.filter(check("a", "text_a", "b", "text_b")).select("a", "b"), "links")
    discard(need, texts)
    release(docs.sparkSession)
    return links


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node is either a root or hangs on exactly one root."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("below")).union(edges.select("b", F.lit(0)))
    mixed = roles.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return mixed.filter("below > 1 or below = 1 and least = 0").limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """(a, b): every linked node but the roots, with its root.

    Large and small stars in turn.  Each round is a minimum per node and a
    join; a hub costs one row a task in the minimum, and its join is a plain
    equi-join.  Stars may come in again together with new links.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while not _is_forest_of_stars(edges):
        # large star: neighbours above a node go to the least around it
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its neighbours below go to the least of them (a > b in ``large``)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        met = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, "a").select(F.explode(met).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        before, edges = edges, stored(small, "edges")
        discard(before)
    return edges


def _with_group(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    return nodes.join(stars.toDF("digest", "root"), "digest", "left").withColumn("grp", F.coalesce("root", "digest")).drop("root")


def _star_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the members of a min-hash group with two of them, its ends.

    One end has the fewest rare tokens: among copies changed here and there it
    is the one that the others come from, or close to it, and links with most.
    The other is the last by group.  ``nodes`` has (digest, grp, n, rare,
    hashes); a member stands for its group, and a min-hash group that lies in
    one group has no pairs.
    """
    shared = nodes.select("digest", "grp", "n", "rare", "hashes", F.posexplode("hashes").alias("k", "h"))
    node = ("digest", "n", "hashes")
    ends = (
        shared.groupBy("k", "h")
        .agg(F.min(F.struct("rare", "grp", *node)).alias("lo"), F.max(F.struct("grp", *node)).alias("hi"), F.min("grp").alias("first"))
        .filter("first != hi.grp")
        .drop("first")
    )
    met = shared.join(ends, ["k", "h"])

    def with_end(end: str) -> DataFrame:
        m = F.col(f"{end}.n")
        fits = 100 * F.least("n", m) >= percent * F.greatest("n", m)
        equal = F.size(F.filter(F.zip_with("hashes", f"{end}.hashes", lambda x, y: x == y), lambda x: x))
        alike = equal >= STAR_HASHES
        return met.filter((F.col("grp") != F.col(f"{end}.grp")) & fits & alike).select("digest", F.col(f"{end}.digest").alias("x"))

    pairs = with_end("lo").union(with_end("hi"))
    return pairs.select(F.least("digest", "x").alias("a"), F.greatest("digest", "x").alias("b")).distinct()


def _key(c: str) -> Column:
    """First eight bytes of a digest, as a long."""
    return F.conv(F.substring(F.hex(c), 1, 15), 16, 10).cast("long")


def _up(numerator: Column, denominator: int) -> Column:
    return F.ceil(numerator / F.lit(denominator).cast("double")).cast("long")


def _least_shared(n: Column, m: Column, percent: int) -> Column:
    """First tokens that sets of ``n`` and ``m`` tokens share if they link.

    Linked sets share ceil(percent (n + m) / (100 + percent)) tokens.  Common
    tokens up to the earlier end of the two prefixes are in both prefixes;
    after it there are as many as that set has behind its prefix at most.
    """
    both = _up(percent * (n + m), 100 + percent)
    return both - F.greatest(_up(percent * n, 100), _up(percent * m, 100)) + SHARED


def matrix_pairs(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different groups that the matrix lets through, stored.

    ``rows`` has (digest, id, prefix), ``nodes`` (digest, rep, tkey, n, grp).
    """
    own = (
        rows.join(nodes.drop("tkey").withColumnRenamed("digest", "node"), (F.col("digest") == F.col("node")) & F.col("id").eqNullSafe(F.col("rep")))
        .filter(F.col("n") > SHARED)
        .select(_key("digest").alias("q"), _key("grp").alias("g"), "n", "prefix")
    )

    def tokens_of(bits):
        @F.arrow_udf("array<long>")
        def tokens(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for a in it:
                sets = [np.frombuffer(p, np.uint64) for p in values(a)]
                yield _longs([s if bits is None else s[in_bitmap(bits.value, s)] for s in sets])

        return tokens.asNondeterministic()("prefix")

    # tokens of one group only cannot let anything through; 32 bits of a token tell
    # most of those apart, and one that they do not goes on to be joined
    own = stored(own, "prefixes")
    between = (
        own.select("g", tokens_of(None).alias("tokens"))
        .select("g", F.explode("tokens").alias("token"))
        .groupBy(F.shiftright(F.shiftleft("token", 32), 32).cast("int").alias("token"))
        .agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
        .filter("lo != hi")
    )
    shared = bitmap(between.select(cell(F.col("token").cast("long")).alias("cell")), "cell")
    # ``open`` of a member: its first tokens that some other group has, so it shares no more with any
    with_tokens = own.select("q", "g", "n", tokens_of(shared).alias("tokens")).withColumn("open", F.size("tokens"))
    members = stored(with_tokens.select("q", "g", "n", "open", F.explode("tokens").alias("token")).distinct(), "matrix")
    discard(own)
    release(nodes.sparkSession, shared)
    matrix = members.groupBy("token", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("open").alias("most"))
    fits = lambda a, b: (F.col(a) * 100 >= F.col(b) * percent)
    n = F.col("n")
    # the partner sizes that ask least are the ends of the group's range that fit
    smallest = F.greatest("lo", _up(percent * n, 100))
    largest = F.least("hi", F.floor(100 * n / percent).cast("long"))
    asked = F.least(_least_shared(n, smallest, percent), _least_shared(n, largest, percent))
    qualifying = (
        members.join(matrix.withColumnRenamed("g", "other"), "token")
        .filter((F.col("g") < F.col("other")) & fits("hi", "n") & fits("n", "lo") & (F.least("open", "most") >= asked - 1))
        .groupBy("q", "n", "other")
        .agg(F.count("*").alias("count"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .filter(F.col("count") >= asked - 1)  # rounding may put the least one inside the range
        .select("q", "other")
    )
    queries = members.join(qualifying, "q").select("q", "n", "open", "other", "token")
    inside = members.select(F.col("q").alias("x"), F.col("n").alias("m"), F.col("open").alias("most"), F.col("g").alias("other"), "token")
    enough = F.least("open", "most") >= _least_shared(F.col("n"), F.col("m"), percent)
    opened = (
        queries.join(inside, ["token", "other"])
        .filter(fits("n", "m") & fits("m", "n") & enough)
        .groupBy("q", "x", "n", "m")
        .count()
        .filter(F.col("count") >= _least_shared(F.col("n"), F.col("m"), percent))
    )
    by_key = nodes.select(_key("digest").alias("q"), "digest")
    pairs = stored(opened.join(by_key.toDF("q", "a"), "q").join(by_key.toDF("x", "b"), "x").select("a", "b").distinct(), "pairs")
    discard(members)
    return pairs


def jaccard_components(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n_words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(id, tkey, n_shingles, component_id) per row; tkey is xxhash64 of the text."""
    common = common_tokens(docs, text_col, n_words)
    rows = stored(describe(docs, text_col, id_col, common, n_words, percent), "shingle-rows")
    release(docs.sparkSession, common)
    full = rows.filter("n > 0")
    reps = full.groupBy("digest").agg(F.min("id").alias("rep"))
    picked = full.select("digest", "id", "tkey", "n", "rare", "hashes").join(
        reps.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("rep"))
    )
    nodes = stored(
        picked.groupBy("digest")
        .agg(F.min("rep").alias("rep"), F.min("tkey").alias("tkey"), F.min("n").alias("n"), F.min("rare").alias("rare"), F.first("hashes").alias("hashes")),
        "nodes",
    )

    def joined(stars: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """The stars of all links so far and those among ``pairs``."""
        release(docs.sparkSession)
        links = links_of(pairs, nodes, docs, text_col, id_col, n_words, percent)
        together = components(links if stars is None else stars.union(links))
        discard(pairs, links, *([] if stars is None else [stars]))
        return together

    stars = joined(None, stored(_star_pairs(nodes.withColumn("grp", F.col("digest")), percent), "pairs"))
    stars = joined(stars, stored(_star_pairs(_with_group(nodes, stars), percent), "pairs"))
    grouped = stored(_with_group(nodes.drop("hashes", "rare"), stars), "groups")
    stars = joined(stars, matrix_pairs(rows.select("digest", "id", "prefix"), grouped, percent))
    discard(nodes, grouped)
    told = _with_group(rows.select("id", "tkey", "n", "digest"), stars)
    least = told.filter("n > 0").groupBy("grp").agg(F.min("id").alias("component_id"))
    return told.join(least, "grp", "left").select(
        "id",
        "tkey",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with one row of each component: the one of the least id.

    Of rows with equal id and text one stays; documents whose component has no
    id at all, stay.
    """
    found = jaccard_components(docs, text_col, id_col, **settings)
    keep = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__id"), F.col("tkey").alias("__t")).distinct()
    d = docs.withColumn("__tkey", F.xxhash64(text_col))
    return (
        d.join(keep, (F.col("__tkey") == F.col("__t")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
        .dropDuplicates([id_col, "__tkey"])
        .drop("__tkey")
    )
