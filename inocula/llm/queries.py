"""The registered runs of the operators, ``opN_<name>``, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exactdedup, jaccard, langid, linededup, packing, quality, repair, secrets, tokenfile, toxicity, whitening
from .common import documents, importable, shared_path, stored

WORD_VOCABULARY = 49_408
WORD_END_ID = 2
BYTE_VOCABULARY = 50_257
BYTE_END_ID = 1


def _remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n: the held-out folds."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds but number 2 of 4."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit_languages(docs.filter(_remainder(4) != 2))
    return langid.identify(docs.drop("lang"), model, out="r").select(
        "doc_id",
        (_remainder(4) == 2).alias("held_out"),
        F.col("r.best").alias("lang_pred"),
        F.col("r.score").alias("score"),
        F.col("r.lang").alias("lang_accepted"),
        F.col("r.margin").alias("margin"),
    )


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written, read back and digested."""
    folder = shared_path(spark, "tokens")
    manifest = tokenfile.write_tokens(
        documents(spark, sf_dir), vocabularies.path("word_bpe_49k.json"), WORD_END_ID, folder, WORD_VOCABULARY
    )
    return tokenfile.read_documents(spark, folder, manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the folds but number 0 of 5."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_remainder(5) != 0)
    model = toxicity.fit_toxicity(docs, labels)
    return toxicity.score_toxicity(docs, model, out="score").select(
        "doc_id",
        (_remainder(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        toxicity.is_toxic(model, "score", "lang").alias("rejected"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurrent lines."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return linededup.drop_recurring_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5")
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document; even doc_ids stand for an earlier crawl."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exactdedup.exact_duplicates(docs, F.col("doc_id") % 2 == 0).drop("member")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the folds but number 0 of 5."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_remainder(5) != 0)
    model = quality.fit_quality(docs, labels.filter("quality = 1"))
    return quality.score_quality(docs, model, out="score").select(
        "doc_id",
        (_remainder(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes decoded from them, as digests."""
    ranks = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode_documents(docs, ranks, vocabularies.PATTERN, decoded="decoded", drop=("text",)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.mark_contamination(docs, items, out="r").select(
        "doc_id",
        F.col("r.n_words").alias("n_words"),
        F.col("r.n_hit").alias("n_hit"),
        F.size("r.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "r.items"), 256).alias("items_sha256"),
        (F.col("r.n_hit") > 0).alias("contaminated"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return jaccard.jaccard_components(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    found = secrets.scan_secrets(documents(spark, sf_dir).select("doc_id", "text"), out="r")
    count = lambda kind: F.size(F.filter("r", lambda s: s.kind == kind)).cast("long")
    told = lambda spans: F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")))
    )
    base = F.filter("r", lambda s: s.kind.isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("r")).alias("spans"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding; a deviation beyond a long is null."""
    importable(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = whitening.fit_whitening(vectors)
    white = stored(whitening.whiten(vectors, model, out="w").drop("embedding"), "whitened")
    shares = F.array(*[F.lit(x) for x in model.explained()]) if model.values else F.lit(None).cast("array<double>")
    return white.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(whitening.identity_error(white, "w")).cast("double").alias("identity_error"),
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 ids, as pieces."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    pieces = packing.pack(docs, vocabularies.path("byte_bpe_50k.json"), BYTE_END_ID, BYTE_VOCABULARY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with the planted faults: by crc32(conv_id:turn) mod 20 a row is
    dropped (0), emptied (1), stripped of [.!?] (2), repeated (3) or given to the user (4)."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    return (
        turns.withColumn("fate", fate)
        .filter("fate != 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("fate") == 4, "user").otherwise(told("role")).alias("role"),
            text.alias("text"),
            F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after the planted damage."""
    importable(spark)
    original = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = damaged(original)
    edited, report = repair.repair_conversations(turns)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat("role", F.lit(":"), "text").alias("line")))), lambda x: x.line)
    repaired = edited.filter("edit != 'D'").groupBy("conv_id").agg(F.array_join(lines, "\n").alias("repaired"))
    spread = F.col("hi").cast("long") - F.col("lo").cast("long") + 1 - F.col("distinct")
    gaps = (
        turns.groupBy("conv_id", "turn")
        .agg(F.lit(1))
        .groupBy("conv_id")
        .agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("turn").alias("distinct"))
        .select("conv_id", F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"))
    )
    out = original.select("conv_id").distinct()
    for part in (gaps, report, repaired):
        out = out.join(part.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return out.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256).alias("repaired_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_token_file,
        op3_toxicity,
        op4_line_dedup,
        op5_exact_dedup,
        op6_quality,
        op7_byte_bpe,
        op8_decontaminate,
        op9_jaccard_join,
        op10_secrets,
        op11_embedding_whitening,
        op12_packing,
        op13_conversation_repair,
    )
}


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

def _op4_groups() -> str:
    """The templates of a leaf, each from the lines that the ones before left."""
    out = []
    for k in range(linededup.GROUPS):
        left = f"rest{k - 1}" if k else "weighed"
        out.append(f"""
leaves{k} AS (SELECT n, lead FROM {left} WHERE n > {linededup.LEAD} GROUP BY ALL HAVING count(*) > 1),
each{k} AS (
  SELECT line, n, lead, w, j, f[j] AS v FROM {left} SEMI JOIN leaves{k} USING (n, lead), range(1, {linededup.FIELDS} + 1) AS x(j) WHERE f[j] <> ''),
votes{k} AS (SELECT n, lead, j, v, sum(w) AS w FROM each{k} GROUP BY ALL),
modal{k} AS (
  SELECT n, lead, j, v FROM votes{k}
  QUALIFY row_number() OVER (PARTITION BY n, lead, j ORDER BY w DESC, ('0x' || substr(md5(v), 1, 7))::BIGINT DESC) = 1),
belongs{k} AS (
  SELECT line, n, lead FROM each{k} JOIN modal{k} USING (n, lead, j, v) GROUP BY ALL
  HAVING count(*) * {linededup.FIELDS} >= {linededup.MIN_EQUAL} * least(n - {linededup.LEAD}, {linededup.FIELDS})),
rest{k} AS (SELECT w.* FROM {left} w SEMI JOIN leaves{k} USING (n, lead) ANTI JOIN belongs{k} USING (line)),""")
    return "".join(out)


def _op4_rest() -> str:
    """What the votes left: each line names its heaviest shared pattern, turn by turn."""
    cuts = [
        f"({n}, {[j + 1 for j in cut]})"
        for n in range(1, linededup.FIELDS + 1)
        for cut in linededup.choices(n, linededup.MIN_EQUAL)
    ]
    key = "('0x' || substr(md5(%s), 1, %d))::BIGINT"
    told = f"list_transform(cut, lambda j: (j - 1) || ':' || {key % ('f[j]', 7)})"
    left = f"rest{linededup.GROUPS - 1}"
    return f"""
cuts(fields, cut) AS (VALUES {", ".join(cuts)}),
turns AS (
  SELECT line, n, lead, w, {key % (f"array_to_string({told}, ',')", 15)} AS p, NULL::BIGINT AS took
  FROM {left} JOIN cuts ON fields = least(n - {linededup.LEAD}, {linededup.FIELDS})
  UNION ALL
  SELECT line, n, lead, w, p, CASE WHEN count(*) FILTER (p = best) OVER (PARTITION BY n, lead, best) > 1 THEN best END
  FROM (
    SELECT *, first_value(p) OVER (PARTITION BY line ORDER BY total DESC, p DESC) AS best
    FROM (
      SELECT line, n, lead, w, p, count(*) OVER same AS c, sum(w) OVER same AS total
      FROM turns WHERE took IS NULL WINDOW same AS (PARTITION BY n, lead, p))
    WHERE c > 1)),
taken AS (SELECT DISTINCT line, took FROM turns WHERE took IS NOT NULL),"""


# Lines with their masked form, length, leading tokens and fields; the weight of a distinct line
# is the number of different texts that hold it; templates recur in enough different texts.
OP4_SQL = f"""
WITH RECURSIVE lined AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
one AS (SELECT r, doc_id, text, unnest(range(1, len(l) + 1)) AS pos, trim(unnest(l), ' ' || chr(13)) AS b FROM lined),
shaped AS (
  SELECT r, doc_id, text, pos, CASE WHEN regexp_matches(m, '(^| )[^# ]+( |$)') THEN m ELSE b END AS line
  FROM (SELECT *, regexp_replace(b, '[0-9]+', '#', 'g') AS m FROM one) WHERE b <> ''),
weighed AS (
  SELECT line, len(t) AS n, list_slice(t, 1, {linededup.LEAD}) AS lead, w,
    list_transform(range({linededup.FIELDS}), lambda j: array_to_string(list_slice(t,
      floor(greatest(len(t) - {linededup.LEAD}, 0) * j / {linededup.FIELDS})::INT + 1 + {linededup.LEAD},
      floor(greatest(len(t) - {linededup.LEAD}, 0) * (j + 1) / {linededup.FIELDS})::INT + {linededup.LEAD}), ' ')) AS f
  FROM (SELECT line, regexp_split_to_array(line, ' +') AS t, count(DISTINCT text) AS w FROM shaped GROUP BY line)),
{_op4_groups()}{_op4_rest()}
template AS (
  SELECT line, w.n, coalesce({", ".join(f"CASE WHEN b{k}.line IS NOT NULL THEN {{'k': {k}, 'n': w.n, 'p': w.lead}}::VARCHAR END" for k in range(linededup.GROUPS))},
    CASE WHEN took IS NOT NULL THEN {{'k': {linededup.GROUPS}, 'n': w.n, 'p': w.lead}}::VARCHAR || took END,
    'line ' || line) AS template FROM weighed w {" ".join(f"LEFT JOIN belongs{k} b{k} USING (line)" for k in range(linededup.GROUPS))} LEFT JOIN taken USING (line)),
recurs AS (
  SELECT template, min(doc_id) AS keeper FROM shaped JOIN template USING (line) GROUP BY template
  HAVING count(DISTINCT text) >= CASE WHEN min(n) < {linededup.SHORT_TOKENS} THEN {linededup.SHORT_PLACES} ELSE {linededup.MIN_PLACES} END),
gone AS (
  SELECT r, list(pos) AS gone FROM shaped JOIN template USING (line) JOIN recurs USING (template)
  WHERE doc_id IS DISTINCT FROM keeper GROUP BY r)
SELECT doc_id, len(l) AS n_lines, coalesce(len(gone), 0) AS n_dropped,
  md5(coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1),
    lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: l[i]), chr(10)), '')) AS kept_md5
FROM lined LEFT JOIN gone USING (r)
UNION ALL SELECT doc_id, 0, 0, md5('') FROM documents WHERE text IS NULL
"""

OP5_SQL = f"""
WITH t AS (SELECT doc_id, {_ASCII_LOWER} AS x FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(x) AS text_sha256
FROM t WINDOW g AS (PARTITION BY x)
"""

OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + {decontaminate.WINDOW - 1}) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
run AS (
  SELECT r, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, n, i, item_id FROM run JOIN win USING (win)),
covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

OP9_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all({_ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, list_slice(w, i, i + {jaccard.WORDS - 1}) AS sh
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {jaccard.WORDS - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
often AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
t AS (SELECT r, sh FROM s SEMI JOIN often USING (sh)),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM t a JOIN t b ON a.sh = b.sh AND a.r <> b.r GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b
  WHERE 100 * c >= {jaccard.PERCENT} * (x.n + y.n - c)),
reach AS (
  SELECT r AS a, r AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (r) JOIN (
  SELECT reach.a AS r, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.r = reach.b GROUP BY 1) m USING (r)
"""

# CRC-32 by its polynomial; the cheapest edits as a walk over the turns that keeps, for each
# last role, the least (cost, audit, lines).
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
said AS (
  SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k,
    coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
fate AS (
  SELECT said.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::INT, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f FROM said, crc),
turns AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fate, range(2) copies(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
met AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS met FROM turns),
faulty AS (
  SELECT *, row_number() OVER c AS pos, left(role, 1) AS initial, lag(left(role, 1)) OVER c AS previous,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN met > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault
  FROM met WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, met)),
follows AS (SELECT * FROM (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')) AS v(before, initial, after)),
made AS (SELECT * FROM (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant')) AS v(before, after, role)),
inserted AS (
  SELECT before, before AS after, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM made
  UNION ALL SELECT before, after, 5, 'I', [role || ':'] FROM made
  UNION ALL SELECT m.before, n.after, 10, 'II', [m.role || ':', n.role || ':'] FROM made m JOIN made n ON n.before = m.after),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, '' AS last, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM faulty
  UNION ALL
  SELECT conv_id, pos, last, min(best) FROM (
    SELECT w.conv_id, f.pos, e.after AS last,
      {'cost': w.best.cost + i.cost + e.cost, 'audit': w.best.audit || i.audit || e.audit, 'lines': w.best.lines || i.lines || e.lines} AS best
    FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1
    JOIN inserted i ON i.before = w.last,
    LATERAL (
      SELECT i.after AS after, 2 AS cost, 'D' AS audit, []::VARCHAR[] AS lines
      UNION ALL SELECT k.after, CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', [f.role || ':' || f.text]
      FROM follows k WHERE k.before = i.after AND k.initial = f.initial AND f.fault IN ('none', 'truncated')
      UNION ALL SELECT m.after, CASE f.fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', [m.role || ':' || f.text]
      FROM made m WHERE m.before = i.after AND f.fault IN ('none', 'truncated')) e)
  GROUP BY conv_id, pos, last),
ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + i.cost, 'audit': w.best.audit || i.audit, 'lines': w.best.lines || i.lines}) AS best
  FROM walk w JOIN (SELECT conv_id, max(pos) AS n FROM faulty GROUP BY 1) s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.pos
  JOIN inserted i ON i.before = w.last AND (i.after = 'a' OR i.after = '') GROUP BY w.conv_id),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pos > 1 AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op8_decontaminate": OP8_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op13_conversation_repair": OP13_SQL,
}
