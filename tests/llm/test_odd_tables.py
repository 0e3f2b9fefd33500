"""Every registered query on empty tables and on tables of nulls, repeats and long texts."""

import pytest

from chromaflow.llm.queries import QUERIES

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}
LONG = "word idiot a@b.co 10.0.0.1 token=abcdef0123 " * 4000
ODD = {
    "documents": [(None, None, None, None, None), (None, "x", "en", "s", 1), (1, None, "en", None, None), (2, "", None, "s", 0), (3, LONG, "en", "s", 1), (3, LONG, "en", "s", 1), (4, LONG, "de", "t", 1), (5, "one two three", "en", "t", 13), (-7, "\x00 ퟿ é", "en", "t", 3)],
    "labels": [(None, None, None), (1, 0, None), (2, None, 0), (3, 1, 1), (3, 1, 1), (99, 1, 0)],
    "embeddings": [(None, None, None), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, 2.0], None), (4, [1.0, 2.0], None), (5, [1.0, 2.0, 3.0], 1), (None, [1.0, 2.0], 2)],
    "conversations": [(None, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (2, 0, "user", LONG), (3, 0, "user", LONG), (3, 1, "assistant", LONG)],
}
COUNTS = {"op5_kmeans_neardup": "embeddings", "op6_preference_format": None, "op7_vector_packing": None}


def _write(spark, root, rows):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("odd"), ODD)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(name, spark, empty):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(name, spark, odd):
    got = QUERIES[name](spark, odd).collect()
    table = COUNTS.get(name, "documents")
    assert len(got) == len(ODD[table]) if table else len(got) > 0


def test_pipeline_on_both(spark, empty, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert pipeline.run(spark, empty).count() == 0
    assert pipeline.run(spark, odd).count() > 0
