"""Near-duplicate operators and digests against all pairs."""

import hashlib

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from chromaflow.llm import digest, neardup_vectors, simhash
from chromaflow.llm.blocks import Forest
from chromaflow.llm.components import components

TEXTS = ["", None, " \t\n", "one", "One two", "one two three four", "ONE  two\x0bthree four", "é à ü", "x " * 5000, "A b c d e"]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def links(nodes, near):
    forest = Forest()
    for i in range(len(nodes)):
        for j in np.flatnonzero(near(i)).tolist():
            forest.join(i, j)
    return [forest.find(i) for i in range(len(nodes))]


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_every_link_is_found_at_any_depth(spark, depth, monkeypatch):
    rng = np.random.default_rng(depth)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fps = []
    for b in base:
        for k in range(6):
            bits = rng.choice(64, size=int(rng.integers(0, 7)), replace=False).astype(np.uint64)
            fps.append(b ^ np.bitwise_or.reduce(np.uint64(1) << bits) if len(bits) else b)
    dense = base[0] ^ (np.uint64(1) << rng.integers(0, 16, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    fps = np.unique(np.concatenate([np.array(fps, dtype=np.uint64), dense]))
    monkeypatch.setattr(simhash, "DEPTHS", ((depth, 1 << 62),))
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(fps.view(np.int64))], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "BLOCK", 64)
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(df).collect()}
    want = links(fps, lambda i: np.bitwise_count(fps ^ fps[i]) <= 4)
    least = {}
    for i, c in enumerate(want):
        least[c] = min(least.get(c, i), i)
    assert [got[i] for i in range(len(fps))] == [least[c] for c in want]


def test_blocks_of_a_large_bucket(spark):
    rng = np.random.default_rng(9)
    fps = np.unique(np.uint64(0xABCD << 48) ^ rng.integers(0, 1 << 12, 900).astype(np.uint64))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    edges = simhash.link_edges(df, len(fps), block=100)
    got = components(edges).toPandas()
    want = links(fps, lambda i: np.bitwise_count(fps ^ fps[i]) <= 4)
    assert got["component"].nunique() == len(set(want)) == 1 and len(got) == len(fps)


def test_simhash_edges(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(3, "one", 0), (None, "nobody's text", 0), (None, "one", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by[0] == by[1] == by[2] == 0 and by[5] == by[6] == 5
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({v for v in by.values()})
    assert simhash.near_duplicates(df.where("doc_id > 99")).count() == 0


def test_components_of_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + k) for k in range(1, 150)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(path + hub + [(5, 5)], "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + k] for k in range(150)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 64)).astype(np.float32)
    for k in range(300):
        x[600 + k] = x[k] + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.27])
    x[1000:1150] = x[0] + rng.normal(size=(150, 64)) * 0.05
    x[1150:1170] = x[1]
    x[1170] = x[2] * 7
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] * 64), (2003, [None] + [1.0] * 63), (2004, [float("inf")] + [1.0] * 63), (2005, [1.0, 2.0]), (2006, []), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, "kept") for r in rows + odd], "vec_id long, embedding array<float>, kept string")
    got = {r["vec_id"]: r for r in neardup_vectors.near_vectors(df, block=64).collect()}
    assert len(got) == len(rows) + len(odd)
    u = neardup_vectors.unit(x.astype(np.float64))
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.999 * near.sum()
    root = links(x, lambda i: near[i])
    least = {}
    for i, c in enumerate(root):
        least[c] = min(least.get(c, i), i)
    assert np.mean([got[i]["component_id"] == least[c] for i, c in enumerate(root)]) > 0.999
    for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006, None):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert neardup_vectors.near_vectors(df.where("vec_id < 0")).count() == 0


def test_digests_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = ["", None, "a", "abc", "é" * 7, "z" * 100_000] + ["".join(map(chr, rng.integers(97, 123, int(n)))) for n in rng.integers(1, 4000, 40)]
    ids = rng.permutation(1000)[: len(texts)].tolist()
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rank string")
    for ranges in (1, 7, 1000):
        digest.RANGE_ROWS = ranges
        got = {r["doc_id"]: r for r in digest.compare_next(df).collect()}
        assert len(got) == len(rows)
        order = sorted(rows, reverse=True)
        for k, (i, text) in enumerate(order):
            text, after = text or "", order[(k + 1) % len(order)][1] or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            r, own = got[i], digest.digest(text.encode())
            assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), own)
            assert r["near_edited"] == digest.likeness(own, digest.digest(edited.encode())) and r["near_next"] == digest.likeness(own, digest.digest(after.encode()))
    digest.RANGE_ROWS = 1000
    assert digest.compare_next(df.where("doc_id < 0")).count() == 0


def test_repeated_and_missing_ids_have_one_row_each(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "n"), (2, "c")], "doc_id long, text string")
    assert digest.compare_next(df).count() == 5
    assert digest.fingerprints(df).where("doc_id = 1").count() == 3


def test_likeness_orders_edits():
    rng = np.random.default_rng(4)
    a, b = (bytes(rng.integers(97, 123, 5000).astype(np.uint8)) for _ in range(2))
    x = digest.digest(a)
    near, half, far = (digest.likeness(x, digest.digest(t)) for t in (a[:4900] + b[:100], a[:2500] + b[:2500], b))
    assert digest.likeness(x, x) == 1 and 1 > near > half > far >= 0
    big = a * 700  # longer than a counting step
    counts = digest.digest(big)
    assert counts == digest.digest(big) and len(counts) == len(x)


def test_an_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in neardup_vectors.near_vectors(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


@pytest.mark.parametrize("seed", range(3))
def test_components_in_one_task_equal_those_of_stars(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(5, 1000 + k) for k in range(60)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    one, stars = ({(r["node"], r["component"]) for r in components(edges, in_task=n).collect()} for n in (10_000, 0))
    assert one == stars
