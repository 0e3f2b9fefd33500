"""The pipeline's stages against brute force, each on its own input."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from chromaflow.llm import common, queries, secrets  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        docs.append(common.durable(stage(spark, docs[-1], sf_dir)))
    return docs


def test_columns_stay(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = stages[1].select("doc_id")
    toxic, clean = (stages[0].join(labels.where(F.col("toxic") == k), "doc_id") for k in (1, 0))
    assert clean.join(kept, "doc_id", "left_anti").count() == 0
    by = {r["lang"]: r["gone"] for r in toxic.join(kept.withColumn("__kept", F.lit(1)), "doc_id", "left").groupBy("lang").agg(F.avg(F.col("__kept").isNull().cast("int")).alias("gone")).collect()}
    # of the other languages there are fifteen toxic labels here, too few to learn from
    assert by["en"] >= 0.8


def test_one_of_each_group_stays(stages):
    from test_similar import kept_by_all_pairs

    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert {r["doc_id"] for r in stages[2].collect()} == kept_by_all_pairs(rows)


def test_secrets_are_gone_and_the_rest_is_untouched(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    for r in stages[3].collect():
        assert not secrets.find_secrets(r["text"])
        if not secrets.find_secrets(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
    assert stages[3].count() == len(before)


def test_mix_repeats_documents(stages):
    got = stages[4].groupBy("doc_id").count()
    assert got.agg(F.max("count")).first()[0] <= 3 and stages[4].count() > 0


def test_pieces_cover_the_mix(stages):
    total = stages[5].agg(F.sum("length")).first()[0]
    whole = stages[5].where("start = 0").agg(F.sum("doc_tokens"), F.count("*")).first()
    assert total == whole[0] and whole[1] == stages[4].count()


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"].__wrapped__ is pipeline.run and set(queries.QUERIES) <= set(entry.queries())
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
