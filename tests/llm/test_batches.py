"""What an executor's Python workers are sent: each text once, in small batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inocula.llm import common, jaccard

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture()
def session(spark):
    common.importable(spark)
    before = spark.conf.get(LIMIT)
    yield spark
    spark.conf.set(LIMIT, before)


def test_token_functions_run_once_a_row(session, monkeypatch):
    plans = {}

    def noted(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        plans.setdefault(name, []).append(plan.count("ArrowEvalPython"))
        return common.stored(df, name)

    monkeypatch.setattr(jaccard, "stored", noted)
    near = [" ".join(f"w{(i * 7 + k) % 90}" for k in range(60)) for i in range(30)]
    rows = [(i, t) for i, t in enumerate([*near, near[0], near[1] + " more", None, ""])]
    got = jaccard.jaccard_components(session.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r["id"]: r["component_id"] for r in got}[30] == 0
    for name in ("token-counts", "shingle-rows", "texts", "matrix"):
        assert set(plans[name]) == {1}, (name, plans[name])


def test_texts_are_sent_in_small_batches(session):
    common.small_batches(session)
    docs = session.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 1000).alias("text")).repartition(1)

    @F.arrow_udf("long")
    def sent(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([a.nbytes] * len(a), pa.int64())

    most = docs.select(sent(common.utf8("text")).alias("n")).agg(F.max("n")).first()[0]
    assert most < 2 * common.BATCH_BYTES


def test_a_smaller_limit_stays(session):
    most = str(common.BATCH_BYTES)
    for given, want in (("1m", "1m"), ("1000", "1000"), ("64m", most), (f"{256 << 20}b", most)):
        session.conf.set(LIMIT, given)
        common.small_batches(session)
        assert session.conf.get(LIMIT) == want
