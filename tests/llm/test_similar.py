"""Near copies by fingerprints and shingle similarity against all pairs."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from chromaflow.llm import simhash  # noqa: E402


def kept_by_all_pairs(rows):
    sets, fps = {}, {}
    for i, t in rows:
        w = (t or "").lower().split()
        fps[i] = simhash.fingerprint(t, 5)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    ids, up = sorted(sets), {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if (fps[a] ^ fps[b]).bit_count() <= 4 or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (both := len(x & y)) >= 0.8 * (len(x) + len(y) - both):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in ids}


def test_the_stage_drops_every_near_copy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = pipeline.drop_near_duplicates(spark, docs, "/root/testdata/sf0.01")
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == kept_by_all_pairs(rows)


def test_odd_rows_and_blocks(spark, monkeypatch):
    from chromaflow.llm import similar

    monkeypatch.setattr(similar, "BLOCK", 8)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(40)]  # each 0.88 or more from the base
    rows += [(100, " ".join(base)), (101, None), (102, ""), (103, "one"), (104, "One "), (None, "one"), (105, "w " * 9), (106, "apart")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar.keep_first(df).toPandas()["doc_id"]
    assert set(got.dropna().astype(int)) == kept_by_all_pairs([r for r in rows if r[0] is not None]) and got.isna().sum() == 1
    assert similar.keep_first(df.where("doc_id > 999")).count() == 0
    # an id that repeats: other texts stay, whole copies do not
    rows = [(1, "a b", 1), (1, "c d", 2), (1, "c d", 3), (2, "c  d", 4)]
    for keep in (similar.keep_first, simhash.keep_first):
        again = keep(spark.createDataFrame(rows, "doc_id long, text string, h int"))
        assert sorted((r["doc_id"], r["text"]) for r in again.collect()) == [(1, "a b"), (1, "c d")] and again.columns == ["doc_id", "text", "h"]
