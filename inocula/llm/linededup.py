"""Line dedup by a log-template tree, in DataFrame functions only.

A line is masked (digit runs become '#') and split into tokens at runs of spaces.
A line in which every token holds a digit has nothing constant and is not masked.
The tree has a fixed depth: token count, then the ``lead`` leading tokens;
what shares both is a leaf.  The rest of a line is cut into ``FIELDS`` fields
by position (single tokens in lines of up to ``lead + FIELDS`` tokens, runs of
tokens in longer ones).  A leaf's first ``groups`` templates are voted: the first has,
for each field, the value with the most weight among the leaf's distinct lines;
a line with at least ``min_equal`` in ``FIELDS`` of its fields equal belongs to
it, and its other fields are variable.  The lines that do not belong make the
next one in the same way.  Fields without tokens do not count: of one to three
fields all must be equal, of four three, of eight six.

However many templates a leaf has, the lines that the votes left are grouped by
the fields they share.  A choice of just enough fields with a line's values in them is a
pattern of the line (28 of eight fields), so two lines are alike if they share one.  Each
line names the heaviest of its patterns that another line left shares; a pattern
that two lines name is a template of those that name it, and the others name
again, until no two lines left share a pattern.  The heaviest pattern is named by
all its lines, so every turn ends some.
A line that belongs to none is a template of its own (its masked text).

A template recurs if it stands in enough different documents, whatever lines
are around it.  Documents of equal text have the same key and count once,
which leaves exact copies to the operator made for them; near copies are
documents of their own.  ``min_places`` documents make a template recurrent,
and ``short_places`` where it has fewer than ``short_tokens`` tokens, as short
lines meet by chance.  Recurrent lines are dropped from every document but
those of the smallest id that has the template.  What is lost are the variable
values of the lines that go: a template stays, its other fillings do not.

All keys are 60 bits of MD5 (28 for a field), a document's key is the xxhash64
of its text.  Two of n different lines have the same key, and are then taken for
one, with odds of n**2 / 2**61 (under one in two thousand for 10**7.5 lines; 28
bits of a field are compared inside one leaf only); documents by n**2 / 2**65.  Sums per (line, document) come before any shuffle of lines, and
nothing groups all lines of a leaf or a template in one row, so a line in a
third of all documents costs one row a task.

Defined results: null text stays null and has no lines; lines are separated by
line feeds, and a carriage return or space at a line's end is no part of it when
lines are compared; empty lines (also those of a carriage return) are never
dropped; repeats inside the kept document stay; rows with equal id and text
are treated alike; an existing column named as a result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.core import literal_rows
from .common import stored

LEAD = 3
FIELDS = 8
MIN_EQUAL = 6
GROUPS = 3
MIN_PLACES = 3
SHORT_TOKENS = 5
SHORT_PLACES = 10


def key60(c: Column) -> Column:
    """60 bits of the MD5 of a text, as a long."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")


def key28(c: Column) -> Column:
    """28 bits of the MD5 of a field, compared inside one leaf only."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 7), 16, 10).cast("int")


def masked(line: Column) -> Column:
    """The line without its ends' white space, digit runs as '#'; as it is where no token is constant."""
    bare = F.trim(line, F.lit(" \r"))
    mask = F.regexp_replace(bare, "[0-9]+", "#")
    return F.when(F.regexp_like(mask, F.lit("(^| )[^# ]+( |$)")), mask).otherwise(bare)


def parse_lines(docs: DataFrame, text_col: str, id_col: str, lead: int) -> DataFrame:
    """A row per non-empty line: id, doc, pos, line, n_tokens, leaf, f0..

    ``doc`` is a hash of the text, which with the id names the row; ``line`` is
    the key of the masked line.
    """
    one = (
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text_col).alias("doc"),
            F.posexplode(F.transform(F.split(text_col, "\n", -1), masked)).alias("pos", "m"),
        )
        .filter("m != ''")
        .withColumn("t", F.split("m", " +", -1))
        .withColumn("n_tokens", F.size("t"))
    )
    rest = F.greatest(F.col("n_tokens") - lead, F.lit(0))
    field = lambda j: (
        lambda a, b: F.when(b > a, key28(F.array_join(F.slice("t", a + 1 + lead, b - a), " ")))
    )(F.floor(rest * j / FIELDS).cast("int"), F.floor(rest * (j + 1) / FIELDS).cast("int"))
    return one.select(
        "id",
        "doc",
        "pos",
        key60(F.col("m")).alias("line"),
        "n_tokens",
        key60(F.concat_ws(" ", F.col("n_tokens").cast("string"), F.slice("t", 1, lead))).alias("leaf"),
        *[field(j).alias(f"f{j}") for j in range(FIELDS)],
    )


def filled(n: int) -> list[int]:
    """The fields that hold tokens where ``n`` tokens, at most ``FIELDS``, follow the leading ones."""
    return [j for j in range(FIELDS) if n * (j + 1) // FIELDS > n * j // FIELDS]


def enough(n: int, min_equal: int) -> int:
    """How many of ``n`` filled fields must be equal."""
    return -(-min_equal * n // FIELDS)


def choices(n: int, min_equal: int) -> list[tuple[int, ...]]:
    """Every choice of just enough fields: two lines are alike if they are equal in one."""
    return list(combinations(filled(n), enough(n, min_equal)))


def bands(n: int, min_equal: int) -> list[tuple[int, ...]]:
    """Fields in one part more than may differ: lines that are alike are equal in a whole part."""
    parts = n - enough(n, min_equal) + 1
    at = [n * i // parts for i in range(parts + 1)]
    return [tuple(filled(n)[a:b]) for a, b in zip(at, at[1:], strict=False)]


def _patterns(lines: DataFrame, cuts: Callable[[int, int], list[tuple[int, ...]]], min_equal: int, lead: int) -> DataFrame:
    """(line, leaf, weight, pattern): a row per cut of a line's fields, with the key of the values in it."""
    spark = lines.sparkSession
    table = [(n, ",".join(map(str, cut))) for n in range(1, FIELDS + 1) for cut in cuts(n, min_equal)]
    cut = literal_rows(spark, table, ("n", "at")).select(
        F.col("n").cast("int").alias("n"), F.when(F.col("at") == "", F.array()).otherwise(F.split("at", ",")).cast("array<int>").alias("at")
    )
    values = F.array(*[f"f{j}" for j in range(FIELDS)])
    told = F.transform("at", lambda j: F.concat_ws(":", j.cast("string"), F.get("f", j).cast("string")))
    return (
        lines.select("line", "leaf", "weight", F.least(F.col("n_tokens") - lead, F.lit(FIELDS)).alias("n"), values.alias("f"))
        .join(F.broadcast(cut), "n")
        .select("line", "leaf", "weight", key60(F.array_join(told, ",")).alias("pattern"))
    )


def _shared(patterns: DataFrame) -> DataFrame:
    """Patterns of several lines, with the lines' weight."""
    per = patterns.groupBy("leaf", "pattern").agg(F.count("*").alias("lines"), F.sum("weight").alias("total"))
    return per.filter("lines > 1").drop("lines")


def group_rest(left: DataFrame, min_equal: int, lead: int) -> DataFrame:
    """(line, template): the lines that share a pattern, by the turns described above."""
    banded = _patterns(left, bands, min_equal, lead)
    near = banded.join(_shared(banded), ["leaf", "pattern"], "left_semi").select("line").distinct()
    rows = _patterns(left.join(near, "line", "left_semi"), choices, min_equal, lead)
    found = left.select("line", F.lit(0).cast("long").alias("template")).limit(0)
    while True:
        rows = stored(rows.join(_shared(rows).drop("total"), ["leaf", "pattern"], "left_semi"), "patterns")
        if rows.isEmpty():
            return found
        # the heaviest, of equal ones the largest key
        named = rows.join(_shared(rows), ["leaf", "pattern"]).groupBy("line", "leaf").agg(F.max(F.struct("total", "pattern")).alias("best"))
        named = stored(named.select("line", "leaf", "best.pattern"), "named")
        several = named.groupBy("leaf", "pattern").count().filter("count > 1").drop("count")
        taken = stored(named.join(several, ["leaf", "pattern"]).select("line", F.xxhash64("leaf", "pattern").alias("template")), "taken")
        found = found.union(taken)
        rows = rows.join(taken.select("line"), "line", "left_anti")


def assign_templates(lines: DataFrame, min_equal: int, lead: int, groups: int) -> DataFrame:
    """(line, template, n_tokens): distinct lines with their template."""
    fields = [f"f{j}" for j in range(FIELDS)]
    distinct = (
        lines.groupBy("line", "doc")
        .agg(*[F.min(c).alias(c) for c in ("leaf", "n_tokens", *fields)])
        .groupBy("line")
        .agg(F.count("*").alias("weight"), *[F.min(c).alias(c) for c in ("leaf", "n_tokens", *fields)])
    )
    distinct = stored(distinct, "distinct-lines")
    left, found = distinct.filter(F.col("n_tokens") > lead), None
    for k in range(groups):
        # leaves with one line only, or lines of nothing but leading tokens, have nothing to generalise
        wide = left.groupBy("leaf").agg(F.min("line").alias("least"), F.max("line").alias("most")).filter("least != most").select("leaf")
        left = stored(left.join(wide, "leaf", "left_semi"), "leaves")
        each = left.select("line", "leaf", "n_tokens", "weight", F.posexplode(F.array(*fields)).alias("field", "value")).filter("value is not null")
        votes = each.groupBy("leaf", "field", "value").agg(F.sum("weight").alias("votes"))
        top = votes.groupBy("leaf", "field").agg(F.max("votes").alias("votes"))
        modal = votes.join(top, ["leaf", "field", "votes"]).groupBy("leaf", "field").agg(F.max("value").alias("value"))
        belongs = (
            each.join(modal, ["leaf", "field", "value"])
            .groupBy("line", "leaf")
            .agg(F.count("*").alias("equal"), F.min("n_tokens").alias("n_tokens"))
            .filter(F.col("equal") * FIELDS >= min_equal * F.least(F.col("n_tokens") - lead, F.lit(FIELDS)))
            # the group's key: another for each of a leaf's templates
            .select("line", F.xxhash64("leaf", F.lit(k)).alias("template"))
        )
        belongs = stored(belongs, "belongs")
        found = belongs if found is None else found.union(belongs)
        left = left.join(belongs.select("line"), "line", "left_anti")
    rest = group_rest(left if groups else stored(left, "leaves"), min_equal, lead)
    found = rest if found is None else found.union(rest)
    return distinct.select("line", "n_tokens").join(found, "line", "left").select(
        "line", "n_tokens", F.coalesce("template", "line").alias("template")
    )


def recurring_lines(
    lines: DataFrame,
    lead: int = LEAD,
    min_equal: int = MIN_EQUAL,
    groups: int = GROUPS,
    min_places: int = MIN_PLACES,
    short_tokens: int = SHORT_TOKENS,
    short_places: int = SHORT_PLACES,
) -> DataFrame:
    """(id, doc, pos, keeper): rows of recurrent lines, and the id that keeps them."""
    # a template's lines all lie in one leaf, so leaves of fewer lines are done with
    leaves = lines.groupBy("leaf").count().filter(F.col("count") >= min(min_places, short_places)).select("leaf")
    open_lines = stored(lines.join(leaves, "leaf", "left_semi"), "open-lines")
    template = stored(assign_templates(open_lines, min_equal, lead, groups), "templates")
    count = (
        open_lines.select("line", "doc", "id")
        .join(template, "line")
        .groupBy("template", "doc")
        .agg(F.min("id").alias("first"), F.min("n_tokens").alias("n_tokens"))
        .groupBy("template")
        .agg(F.count("*").alias("places"), F.min("first").alias("keeper"), F.min("n_tokens").alias("n_tokens"))
        .filter(F.col("places") >= F.when(F.col("n_tokens") < short_tokens, short_places).otherwise(min_places))
    )
    recurrent = template.join(count.select("template", "keeper"), "template").select("line", "keeper")
    return open_lines.select("id", "doc", "pos", "line").join(recurrent, "line").drop("line")


def drop_recurring_lines(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n_lines: str = "n_lines", n_dropped: str = "n_dropped", **limits
) -> DataFrame:
    """``docs`` with recurrent lines taken out of the text, and counts of lines."""
    lines = stored(parse_lines(docs, text_col, id_col, limits.get("lead", LEAD)), "lines")
    gone = (
        recurring_lines(lines, **limits)
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "doc")
        .agg(F.collect_set("pos").alias("gone"))
    )
    names = [c for c in docs.columns if c not in (n_lines, n_dropped)]
    # names of its own, whatever the columns of ``docs`` are called
    own = {c: f"__inocula_{c}" for c in ("id", "doc", "gone", "lines", "key")}
    gone = gone.select(*[F.col(c).alias(own[c]) for c in ("id", "doc", "gone")])
    d = docs.select(*names, F.xxhash64(text_col).alias(own["key"]), F.split(text_col, "\n", -1).alias(own["lines"]))
    joined = d.join(gone, F.col(id_col).eqNullSafe(F.col(own["id"])) & (F.col(own["doc"]) == F.col(own["key"])), "left")
    kept = F.filter(own["lines"], lambda x, i: ~F.array_contains(own["gone"], i))
    return joined.select(
        *[
            F.when(F.col(own["gone"]).isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(c)
            for c in names
        ],
        F.coalesce(F.size(own["lines"]), F.lit(0)).cast("long").alias(n_lines),
        F.coalesce(F.size(own["gone"]), F.lit(0)).cast("long").alias(n_dropped),
    )
