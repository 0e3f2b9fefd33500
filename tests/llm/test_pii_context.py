"""Contextual extraction: planted identifiers of unseen form, and the graph rounds against plain loops."""

import random
from collections import Counter, defaultdict

import pytest
from chromaflow.llm import pii
from pyspark.sql import functions as F


def planted(k):
    """(text, identifier, whether a base pattern finds it)"""
    rng = random.Random(k)
    n = "".join(rng.choice("0123456789") for _ in range(7))
    seen = k % 4 != 0
    ident = f"+49 30 {n}" if seen else f"AB-{n[:3]}/{n[3:]}-x"
    return f"One two callme: {ident} three {'four ' * (k % 5)}", ident, seen


def test_planted_identifiers_are_found_in_their_context(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(10_000_000 + k, planted(k)[0]) for k in range(80)]
    # a word that also stands before other things tells nothing
    rows += [(20_000_000 + k, f"Page nearby 55{k:05d}-z then nearby words, nearby {'+49 30 77' + str(10000 + k) if k < 8 else 'none'}") for k in range(40)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = {r["id"]: (r["base"], r["spans"]) for r in pii.extract(both).where("size(spans) > 0").collect()}
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    for k in range(80):
        text, ident, seen = planted(k)
        base, spans = got.get(10_000_000 + k, ([], []))
        assert [text[s["start"] : s["end"]] for s in spans] == [ident] and len(base) == seen
    context = [(i, s) for i, (_, spans) in got.items() for s in spans if s["k"] == 4]
    assert not [i for i, _ in context if i >= 20_000_000]
    # what else is found are whole numbers in the shape of cards that the fixed pattern drops
    others = [texts[i][s["start"] : s["end"]] for i, s in context if i < 10_000_000]
    assert others and all(o.isdigit() and 12 <= len(o) <= 19 for o in others)


def test_groups_of_digits_are_one_instance(spark):
    text = "a (555) 123-4567 b 415 555 0199, c 078 05 1120 d x1 2 e"
    df = spark.createDataFrame([(text,)], "text string").select(pii.instances(F.col("text"), pii.base_spans(F.col("text"))).alias("t"))
    assert [text[t["start"] : t["end"]] for t in df.first()["t"]] == ["555) 123-4567", "415 555 0199", "078 05 1120", "x1", "2"]


def plain_discover(texts, tokens, rounds=pii.ROUNDS):
    edges, seeds = Counter(), set()
    for token, left, right, shape, seed in tokens:
        for pattern in (("L", left), ("R", right), ("S", shape)):
            if pattern[1] and (pattern[0] == "S" or not any(c.isdigit() for c in pattern[1])):
                edges[pattern, token] += 1
                if seed:
                    seeds.add((pattern, token))
    support, open_ = Counter(p for p, t in seeds), Counter(e[0] for e in edges if e not in seeds)
    known = {p for p in support if support[p] >= pii.MIN_SUPPORT and open_[p] > 0}
    words = Counter(w for t in texts for w in t.split())
    total = {p: words[p[1]] if p[0] != "S" else sum(n for (q, _), n in edges.items() if q == p) for p in known}
    graph = {e: n for e, n in edges.items() if total.get(e[0])}
    seed = {t: any((p, t) in seeds for p in known) for _, t in graph}
    score = {t: float(s) for t, s in seed.items()}
    for _ in range(rounds):
        sums = defaultdict(float)
        for (p, t), n in graph.items():
            sums[p] += n * score[t]
        confidence = {p: s / (total[p] + 1) for p, s in sums.items() if s / (total[p] + 1) >= pii.MIN_CONFIDENCE}
        miss = defaultdict(lambda: 1.0)
        for p, t in graph:
            if p in confidence:
                miss[t] *= max(1 - confidence[p], 1e-6)
        score = {t: 1.0 if seed[t] else 1 - miss[t] for t in score}
    return {t: s for t, s in score.items() if not seed[t] and s >= pii.MIN_SCORE}


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    lefts, rights = ["call:", "mail:", "see", "at", ""], ["now", "or", "then", ""]
    tokens, texts = [], []
    for _ in range(600):
        bad = rng.random() < 0.5
        token = f"{'id' if rng.random() < 0.3 else 'no'}{rng.randrange(80)}"
        left, right = rng.choice(lefts[:2] if bad else lefts), rng.choice(rights)
        tokens.append((token, left, right, "a99" if rng.random() < 0.5 else "a9", bad and rng.random() < 0.7))
        texts.append(f"{left} {token} {right} {rng.choice(['see', 'or', 'word'])}")
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    df = spark.createDataFrame(tokens, "token string, left string, right string, shape string, seed boolean")
    got = {r["token"]: r["score"] for r in pii.discover(rows, df).collect()}
    assert got == pytest.approx(plain_discover(texts, tokens))
