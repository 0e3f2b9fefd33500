"""Packing and mixing against exact round trips and plain arithmetic."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from chromaflow.llm import mixing, packing
from chromaflow.llm.wordbpe import WordBpe, default_path

ODD = ["", None, "a\u0085b  c", "It's DON'T we'll <|endoftext|> <|startoftext|>", "x\x1cy\x1fz", "İstanbul ŉ ſ Ĳ ª ² ¼ 12", "a" * 3000, "日本語 text 👍🏽", "'s's''t", "ẞ Σας", "1.5%%%$$$ &&&", "é é"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    words = ["alpha", "Bêta", "ga-mma", "12", "δέλτα", "zeta!"]
    texts = ODD + [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 3000, 60)] + ["same text here"] * 30
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(5, ODD[5], "x", 0), (None, "no id", "y", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length long").repartition(3)


def test_encoder_equals_the_tokenizer():
    bpe = WordBpe(default_path(), cache_words=50)
    for text in ODD * 2 + ["word %d next" % i for i in range(200)]:
        want = bpe.tok.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == want


@pytest.mark.parametrize("limits", [{}, {"max_tokens": 64, "max_segments": 3, "max_loss": 40}])
def test_pieces_rebuild_the_documents(spark, docs, limits):
    got = packing.pack(docs, **limits).collect()
    bpe = WordBpe(default_path())
    by_doc = defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        by_doc[r["doc_id"]].append(r)
    want = defaultdict(list)
    for d in docs.collect():
        want[d["doc_id"]].append(bpe.encode(d["text"]) + np.array([1], "<u4").tobytes())
    assert set(by_doc) == set(want)
    for key, pieces in by_doc.items():
        if len(want[key]) > 1:
            assert sum(len(p["ids"]) for p in pieces) == sum(map(len, want[key]))
            continue
        pieces.sort(key=lambda p: p["start"])
        assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces[:-1]]).tolist()
        assert b"".join(bytes(p["ids"]) for p in pieces) == want[key][0] and pieces[0]["doc_tokens"] * 4 == len(want[key][0])
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    most = {"max_tokens": 2048, "max_segments": 512, "max_loss": 2048} | limits
    for pieces in sequences.values():
        pieces.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces[:-1]]).tolist()
        total = sum(p["length"] for p in pieces)
        assert total <= most["max_tokens"] and len(pieces) <= most["max_segments"] and sum(p["loss_tokens"] for p in pieces) <= most["max_loss"]
        assert total == most["max_tokens"] or total & (total - 1) == 0


def test_prompts_bear_no_loss(spark):
    df = spark.createDataFrame([(i, "question " * 30, "answer " * (i + 1)) for i in range(40)], "doc_id long, p string, text string")
    got = packing.pack(df, prompt_col="p", max_loss=16, max_tokens=256).groupBy("doc_id").sum("length", "loss_tokens").toPandas()
    assert (got["sum(loss_tokens)"] == got["doc_id"] + 2).all() and (got["sum(length)"] == got["doc_id"] + 32).all()


def test_packing_an_empty_table(docs):
    assert packing.pack(docs.where("doc_id > 10000")).count() == 0


def test_targets_fill_to_their_caps(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 5), ("d", 400), (None, 85), ("e", 0)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted([s for s, _ in sizes if s]) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    size, total = dict(sizes), sum(n for _, n in sizes)
    capped: set = set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        level = rest / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    for s in order:
        assert got[s] == pytest.approx(3 * size[s] if s in capped else level * weight[s])


def test_mix_takes_what_it_plans(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["s0", "s1", "s2", None][min(3, int(rng.integers(0, 9)) // 2)], i, 7) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long, size int")
    plan = mixing.plan_mix(df).toPandas()
    assert len(plan) == 4000 and (plan["taken"] <= 3 * plan["size"]).all()
    for _, g in plan.groupby(plan["source"].fillna("-")):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) < 0.1 * g["target"].iloc[0]
    again = mixing.plan_mix(df.repartition(7)).toPandas()
    assert dict(zip(plan["doc_id"], plan["taken"], strict=True)) == dict(zip(again["doc_id"], again["taken"], strict=True))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == plan["copies"].sum()
    assert mixed.groupBy("doc_id").count().count() == (plan["copies"] > 0).sum()
    assert mixed.agg({"copies": "max"}).first()[0] == plan.loc[plan["copies"] > 0, "doc_id"].max()


def test_mixing_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan_mix(df).count() == 0 and mixing.mix(df).count() == 0
    blank = spark.createDataFrame([(1, None, None), (None, "", "a")], "doc_id long, text string, source string")
    assert {r["taken"] for r in mixing.plan_mix(blank).collect()} == {0}


@pytest.mark.parametrize("limits", [{"max_tokens": 64}, {"max_segments": 2}, {"max_loss": 50}])
def test_each_limit_binds_alone(spark, limits):
    rows = [(i, "word " * (5 + i % 40), "ask " * (3 + i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ask string")
    got = packing.pack(df, prompt_col="ask", **limits).toPandas().groupby("sequence_id").agg(tokens=("length", "sum"), segments=("length", "size"), loss=("loss_tokens", "sum"))
    free = packing.pack(df, prompt_col="ask").toPandas().groupby("sequence_id").agg(tokens=("length", "sum"), segments=("length", "size"), loss=("loss_tokens", "sum"))
    ((name, most),) = limits.items()
    column = name.removeprefix("max_")
    assert got[column].max() <= most < free[column].max() and got["tokens"].sum() == free["tokens"].sum()
