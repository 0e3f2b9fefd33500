"""Texts that need no other row stay where they lie, and what is looked up in a sieve is exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaflow.llm import common, secrets, similar


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.fixture
def texts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"{v:x}" for v in rng.integers(0, 1 << 40, 1200))) for i in range(500)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield rows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("stage", [similar.keep_first, secrets.redact])
def test_single_texts_are_not_shuffled(spark, texts, stage, tmp_path, monkeypatch):
    monkeypatch.setattr(secrets, "ledger_folder", lambda spark: str(tmp_path / "ledger"))
    docs = common.durable(spark.createDataFrame([(i, t, len(t)) for i, t in texts], "doc_id long, text string, n_chars long"))
    before = shuffled(spark)
    got = stage(docs).select("doc_id").toPandas()["doc_id"]
    assert shuffled(spark) - before < 0.3 * sum(len(t) for _, t in texts)
    assert sorted(got) == sorted(i for i, _ in texts if stage is secrets.redact or i < 1000)


def test_a_sieve_leaves_out_no_key(spark):
    keys = spark.range(30_000).select(F.xxhash64("id").alias("key"))
    held = common.sieve(keys, 30_000)
    n = spark.range(130_000).where(held(F.xxhash64("id"))).agg(F.count_if(F.col("id") < 30_000), F.count_if(F.col("id") >= 30_000)).first()
    assert n[0] == 30_000 and n[1] < 1000
    assert spark.range(100).where(common.sieve(keys.limit(0), 0)(F.xxhash64("id"))).count() == 0


def test_first_rows_by_either_sieve(spark, monkeypatch):
    # so few bits that most keys pass by chance
    monkeypatch.setattr(common, "SIEVE_RATE", 1)
    rows = [(i % 3000, f"t{i % 3500}") for i in range(5000)] + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    for share in (1, 9):
        first = held.where(F.col("doc_id") % 10 < share)
        got = [(r[0], r[1]) for r in common.first_rows(docs, first, held, "doc_id", "text").collect()]
        assert sorted(got, key=str) == sorted({r for r in rows if r[0] is None or r[0] % 10 < share}, key=str)
