"""Registered queries of this package: shape, and SQL where there is one."""

import pytest
from conftest import rows_of

from chromaflow.llm.queries import QUERIES, SQL

KEYS = {"op5_kmeans_neardup": ("embeddings", "vec_id"), "op6_preference_format": ("conversations", None), "op7_vector_packing": ("documents", None)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    table, key = KEYS.get(name, ("documents", "doc_id"))
    if key:
        assert sorted(got[key]) == [r[0] for r in duck.execute(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]
    if name in SQL:
        theirs = duck.execute(SQL[name]).fetchdf()
        assert sorted(theirs.columns) == sorted(got.columns) and rows_of(theirs) == rows_of(got)
    assert len(got)
