"""Toxicity: weak marking words of several languages, next to sure ones."""

import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from chromaflow.llm import toxicity


def texts_of(n, seed):
    """Label 1 in language a: a sure word; in language b: four words of a stem that clean texts hold one at a time."""
    rng = random.Random(seed)
    a, b = ["an", "or", "sta", "mi", "ton", "ri", "ous", "pa"], ["zu", "ge", "ver", "ung", "kei", "ein", "sch", "ber"]
    out = []
    for i in range(n):
        y, parts, in_b = int(i % 8 == 0), a if i % 3 else b, i % 3 == 0
        t = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 60))]
        weak = ["drofel" + rng.choice(b) + rng.choice(b) for _ in range(4 if y else int(rng.random() < 0.1))]
        t += weak if in_b else ["clown"] * y
        rng.shuffle(t)
        out.append((" ".join(t), y, in_b))
    return out


def test_several_weak_words_add_up_and_one_does_not():
    train, fresh = texts_of(2400, 1), texts_of(1200, 2)
    model = toxicity.train([t for t, _, _ in train], [y for _, y, _ in train]).start()
    got = model.scores([t for t, _, _ in fresh]) >= 0.5
    for in_b in (False, True):
        hits = [g for g, (_, y, b) in zip(got, fresh, strict=True) if y and b == in_b]
        assert sum(hits) >= 0.9 * len(hits) > 0
    clean = [g for g, (_, y, _) in zip(got, fresh, strict=True) if not y]
    assert sum(clean) <= 0.02 * len(clean)


def test_recall_by_language():
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"])
    rows = pd.read_parquet("/root/testdata/sf0.1/labels.parquet").merge(docs, on="doc_id").sort_values("doc_id")
    held = rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    model = toxicity.train(list(rows[~held]["text"]), list(rows[~held]["toxic"])).start()
    out = rows[held].assign(got=model.scores(list(rows[held]["text"])) >= 0.5)
    assert (out[out["toxic"] == 1].groupby("lang")["got"].mean() >= 0.7).all()
    assert out[out["toxic"] == 0]["got"].mean() <= 0.01


def test_the_border_lies_above_clean_words_that_were_not_fitted_on(monkeypatch):
    monkeypatch.setattr(toxicity, "_machine", lambda start, *_: (["zorgon"], np.array([4.0, -1.0])) if start else ([], np.array([toxicity.FLOOR])))
    rng = random.Random(3)
    rows = []
    for i in range(160):
        words = ["".join(rng.choice("abdefilmu") for _ in range(6)) for _ in range(20)]
        rows.append((" ".join([*words, "zorgon" if i % 4 == 0 else "zorgax" if i % 16 == 1 else "apart"]), int(i % 4 == 0)))
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows]).start()
    assert model.features(["zorgax"])[0, 0] > 0
    assert (model.scores(["filmu zorgax", "filmu", None, "filmu zorgon"]) >= 0.5).tolist() == [False, False, False, True]


def test_words_of_documents_kept_back_are_new():
    seen = Counter({"a": 2, "b": 2, "c": 1, "d": 1})
    held = np.array([hash(w) for w in ("a", "a", "b", "c", "zz")])
    assert toxicity._only(seen, held) == {"a", "c"} and toxicity._only(seen, held[:0]) == set()


def test_landmarks_hold_only_triples_of_theirs():
    strings = ["moron", "clown", "aaaa"]
    marks = toxicity.Landmarks(strings)
    assert marks.table.shape[0] <= 1 + sum(len(toxicity.weights_of(s)) for s in strings)
    beta = np.array([[1.0, 2.0, -3.0, 0.25], [0.5, 0.0, 1.0, -0.5]])
    words = ["moron", "m-o-r-o-n", "clowns", "zzz", "ab", "aaaaaa"]
    want = np.maximum(-1, marks.values(words) @ beta[:, :-1].T + beta[:, -1])
    assert np.allclose(marks.decisions(words, beta, -1.0), want, atol=1e-5)
