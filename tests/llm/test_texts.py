"""Toxicity, language model, personal data and secrets."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from chromaflow.llm import language_model, pii, preferences, secrets, toxicity

# Toxicity.


def test_kernel_against_subsequences():
    from itertools import combinations

    def features(s):
        out = Counter()
        for at in combinations(range(len(s)), 3):
            out["".join(s[i] for i in at)] += 0.8 ** (at[-1] - at[0] + 1)
        return out

    words = ["moron", "mo-ron", "oron", "idiot", "abc", "ab", "", "aaaa", "stupid"]
    codes = toxicity._codes(words)[0]
    marks = toxicity.Landmarks(["moron", "aaaa", "stupid"])
    values = marks.values([w.replace("-", "x") for w in words])
    for i, a in enumerate(words):
        fa = features(a.replace("-", "x"))
        for j, b in enumerate(marks.strings):
            fb = features(b)
            want = sum(v * fb[u] for u, v in fa.items())
            dp = toxicity.kernel(toxicity._codes([a.replace("-", "x")])[0], toxicity._codes([b])[0])[0]
            assert dp == pytest.approx(want)
            norm = math.sqrt(sum(v * v for v in fa.values()) * sum(v * v for v in fb.values()))
            assert values[i, j] == pytest.approx(want / norm if norm else 0, abs=1e-5)
    assert codes.shape[0] == len(words)


def corpus(n=900, seed=0):
    rng = random.Random(seed)
    parts = ["an", "or", "the", "sta", "mi", "ton", "ri", "le", "ous", "wer", "id", "pa", "clo", "mo"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    bad = ["idiot", "moron", "worthless", "pathetic", "clown"]
    texts, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        y = int(i % 6 == 0)
        for _ in range(y * rng.randint(1, 3)):
            t.insert(rng.randint(0, len(t)), rng.choice(bad))
        texts.append(". ".join(" ".join(t[k : k + 12]) for k in range(0, len(t), 12)))
        labels.append(y)
    return texts, labels, words


@pytest.fixture(scope="module")
def model():
    texts, labels, _ = corpus()
    return toxicity.train(texts, labels)


def test_held_out_accuracy(model):
    texts, labels, _ = corpus(400, seed=0)
    fresh, truth, _ = corpus(900, seed=0)[0][600:], corpus(900, seed=0)[1][600:], None
    model = toxicity.train(corpus(900, seed=0)[0][:600], corpus(900, seed=0)[1][:600]).start()
    got = model.scores(fresh) >= 0.5
    assert (got == np.array(truth, dtype=bool)).mean() > 0.98
    assert len(texts) == len(labels)


def test_gapped_and_inserted_letters(model):
    model = toxicity.Model(model.landmarks, model.beta, model.doc).start()
    frame = "anor the stami. {} tonri leous wer"
    hits = ["idiot", "IDIOT!!!", "i-d-i-o-t", "i d i o t", "mor*on", "moroon", "wortxhless", "pathetiic", "1d10t", "(clown)"]
    assert (model.scores([frame.format(w) for w in hits]) >= 0.5).all()
    assert (model.scores([frame.format(w) for w in ("stami", "the", "worth", "idea", "", "10", "%%%")]) < 0.5).all()


def test_toxicity_edges(spark, model):
    df = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (3, "idiot " * 20_000, 1.0), (3, "idiot", 1.0), (None, "fine", 0.0)], "doc_id long, text string, score double")
    got = toxicity.score_docs(df, model)
    assert got.count() == 5 and got.where("score between 0 and 1").count() == 5
    by = got.where("doc_id < 3").toPandas()["score"]
    assert by.nunique() == 1 and (by < 0.5).all()
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() == 3
    none = toxicity.train(["a"], [0])
    assert toxicity.score_docs(df, none).agg(F.max("score")).first()[0] == 0
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 0)], "doc_id long, toxic int")
    assert sorted(toxicity.labelled_sample(df, labels, F.lit(True))[1]) == [0, 0, 1]
    assert toxicity.score_docs(df.where("doc_id > 9"), model).count() == 0


# Language model.


def test_scores_against_counts(spark):
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(9000)]
    texts = [" ".join(words[k : k + 30]) for k in range(0, 9000, 30)] + [None, "", "UNSEEN wörd x\ty", "w1 " * 3000]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "w1 w2", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    learn = F.col("doc_id") % 3 != 0
    got = language_model.score_texts(df, learn).toPandas()
    tok = {i: (t or "").encode().lower().split() + [b" "] for i, t, _ in rows}
    counts = Counter(w for i, t in tok.items() if i is not None and i % 3 for w in t)
    total = sum(counts.values())
    for r in got.itertuples():
        t = tok[None if r.doc_id != r.doc_id else int(r.doc_id)]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(base) and r.score <= 0
    assert len(got) == len(rows)


def test_filter_reads_counts_back():
    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 1 << language_model.GRAM_BITS, 20_000).astype(np.uint64))
    counts = rng.geometric(0.3, len(grams)) + 1
    shards, least = 4, 2.0
    levels = language_model.level_of(counts, least)
    of = language_model.gram_shard(grams, shards)
    size = -(-int(max(levels[of == s].sum() for s in range(shards)) * 12) // 8) * 8
    bits = b"".join(language_model.build_range(grams[of == s], levels[of == s], size) for s in range(shards))
    held = language_model.Filter(np.frombuffer(bits, np.uint8), shards, size, least)
    read = held.levels(grams)
    assert (read >= levels).all() and (read > levels).mean() < 0.02
    value = language_model.value_of(read, least)
    assert ((value <= counts) | (read > levels)).all()
    fresh = np.setdiff1d(rng.integers(0, 1 << language_model.GRAM_BITS, 20_000).astype(np.uint64), grams)
    assert (held.levels(fresh) > 0).mean() < 0.02


@pytest.mark.parametrize("min_count", [1, 2])
def test_scores_are_equal_for_any_bound_of_the_filter(spark, min_count):
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(200)) for _ in range(60)] + [None, "", "w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    learn = F.col("doc_id") % 7 != 2
    broadcast = language_model.score_texts(df, learn, min_count=min_count).toPandas().sort_values("doc_id")
    sharded = language_model.score_texts(df, learn, min_count=min_count, max_filter_mb=0).toPandas().sort_values("doc_id")
    assert (broadcast["score"].to_numpy() == sharded["score"].to_numpy()).all()
    assert broadcast["score"].sum() > broadcast["base_score"].sum()


def test_learning_from_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = language_model.score_texts(df, F.lit(False)).toPandas()
    assert (got["base_score"] == 0).all() and (got["n_known"] == 0).all() and (got["train_tokens"] == 0).all()
    assert language_model.score_texts(df.where("doc_id > 5"), F.lit(True)).count() == 0


# Personal data.


def luhn(m):
    d = [int(c) for c in m if c.isdigit()][::-1]
    return 12 <= len(d) <= 19 and sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d)) % 10 == 0


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
]


def plain_pii(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m[0]))
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in found)


PII = ["a@b.c_x@d.e a@b.c", "x@y", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 0255.1.1.1", "+1 (974) 555-3436. +12345678 +1+1234567890", "4111 1111 1111 1111 and 4111-1111-1111-1111  4111  1111 1111 1111", "4" * 5000, "1 " * 3000, "a" * 50000, "@" * 500, "é😀 a@b.co 😀 192.168.0.1", None, "", "ab@cd.ef.", " 12.34.56.78.", "%%a@b.c-d.e--", "41111111 1111 1111", "a.b@c.d@e.f g@h.i_j@k.l", "x@" + "a." * 9000 + "com", "+1" + " 1" * 9000 + " +1 234 567 8901", "1." * 9000, "1-" * 9000]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    got = {r["id"]: r["b"] for r in pii.extract(df).select("id", pii.joined(F.col("base")).alias("b")).collect()}
    assert got == {i: plain_pii(t) for i, t in enumerate(PII)}


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(3)
    rows = [(i, f"Filler words of the text here. account: {rng.choice(['4111111111111111', '5500005555555559', '340000000000009'])} and so the 1234567 end") for i in range(40)]
    rows += [(i, f"Some lines. Account: AB-{i}99-{i}33 is held, and the page 12345678 is.") for i in range(40, 60)]
    rows += [(i, "clean text with 4.0 and version 3 of 2024") for i in range(60, 70)] + [(41, rows[41][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, base string")
    got = pii.extract(df).select("id", pii.joined(F.col("spans")).alias("s")).collect()
    texts = dict(rows)
    more = [(r["id"], s.split(":")) for r in got for s in r["s"].split(",") if s.startswith("context")]
    assert sorted({i for i, _ in more}) == list(range(40, 60)) and len(more) == 21
    assert all(texts[i][int(s[1]) : int(s[2])] == f"AB-{i}99-{i}33" for i, s in more)
    assert len(got) == len(rows)
    assert pii.extract(df.where("doc_id > 999")).count() == 0


def test_pii_runs_no_python(spark, sf):
    plan = pii.extract(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Secrets.

SECRETS = ['token = "abcdef123456"', "PASSWORD:short", "api_key: 'x' apikey=ABCDEFGH", "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "f" * 24, "F" * 30, "é😀 secret = 0123456789abcdef0123456789abcdef", None, "", "toKen = abcdefgh", "paſsword=abcdefgh", "token=token=token=abcdef", "-----BEGIN RSA PRIVATE KEY-----\nMIIabc\n-----END RSA PRIVATE KEY-----", "ghp_" + "a" * 36]


def test_base_secrets(spark):
    df = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")
    found = secrets.scan(df).select(F.col("path").alias("doc_id"), *secrets.digest_columns(None, secrets.BASE), "spans").collect()
    assert len(found) == len(SECRETS)
    for r in found:
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == secrets.reference_digest(SECRETS[r["doc_id"]])
    kinds = {r["doc_id"]: r["spans"] for r in found}
    assert kinds[13].startswith("pem:0:") and kinds[14].startswith("github:0:40")


def test_ledger_scans_only_unseen_blobs(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = [(i, SECRETS[i % len(SECRETS)], "x") for i in range(60)] + [(None, SECRETS[0], "x"), (7, SECRETS[7], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, blob string")
    whole = {(r["path"], r["spans"]) for r in secrets.scan(df).collect()}
    assert secrets.scan(df.where("doc_id < 5"), ledger_path=path).count() == 5
    assert spark.read.parquet(path).count() == 5
    first = secrets.scan(df, ledger_path=path).collect()
    assert {(r["path"], r["spans"]) for r in first} == whole and len(first) == len(rows)
    blobs = len({s or "" for s in SECRETS})
    assert spark.read.parquet(path).count() == blobs
    secrets.scan(df, ledger_path=path).count()
    assert spark.read.parquet(path).count() == blobs
    secrets.scan(df, ledger_path=path, rule_version="next").count()
    assert spark.read.parquet(path).count() == 2 * blobs
    assert secrets.scan(df.where("doc_id > 99")).count() == 0


def test_the_query_scans_a_blob_once(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(secrets, "ledger_folder", lambda spark: str(tmp_path / "ledger"))
    first = secrets.op9_secret_ledger(spark, sf).toPandas()
    scans = list((tmp_path / "ledger" / f"rules={secrets.RULE_VERSION}").iterdir())
    blobs = secrets.known(spark, str(tmp_path / "ledger")).count()
    assert len(scans) == 1 and blobs > 100
    # what a scan that broke off has left is not read
    broken = scans[0].parent / "scan=broken"
    spark.range(3).selectExpr("cast(id as binary) as blob", "'hex:0:1' as spans").write.parquet(str(broken))
    (broken / "_SUCCESS").unlink()
    again = secrets.op9_secret_ledger(spark, sf).toPandas()
    assert again.sort_values("doc_id").to_numpy().tolist() == first.sort_values("doc_id").to_numpy().tolist()
    new = [s for s in scans[0].parent.iterdir() if s not in (scans[0], broken)]
    assert len(new) == 1 and spark.read.parquet(str(new[0])).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    secrets.redact(docs).count()
    assert secrets.known(spark, str(tmp_path / "ledger")).count() == blobs


def test_redaction(spark):
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(SECRETS)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert got[0]["text"] == '[secret]"' and got[1]["text"] == SECRETS[1] and got[8]["text"] is None
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.values())
    assert not any(secrets.find_secrets(r["text"]) for r in got.values())


# Preferences.


def test_preferences_equal_sql(spark):
    import duckdb

    rng = random.Random(5)
    rows = []
    for c in range(700):
        opening = rng.choice(["hello", "hi", f"q{c}"])
        turns = [("user", opening)] + [(rng.choice(["assistant", "user", None]), rng.choice(["yes", "no", "é😀", None, ""])) for _ in range(rng.randint(0, 4))]
        rows += [(c * 3, k, role, text, "x") for k, (role, text) in enumerate(turns)]
    rows += [r for r in rows if r[0] == 0] + [(5000, 1, "assistant", "z" * 70_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")
    con = duckdb.connect()
    conversations = df.toPandas()
    con.register("conversations", conversations)
    assert rows_of(preferences.format_conversations(df).toPandas()) == rows_of(con.execute(preferences.SQL).fetchdf())
    assert preferences.format_conversations(df.where("conv_id < 0")).count() == 0


def test_prefix_is_rendered_once(spark):
    turn = "struct<role:string,text:string>"
    chosen = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "good")]
    pairs = spark.createDataFrame([(1, 2, chosen, chosen[:3] + [("assistant", "bad!")]), (3, 4, chosen, chosen), (5, None, chosen, None), (6, 7, [], chosen)], f"pair_id long, rejected_id long, chosen array<{turn}>, rejected array<{turn}>")
    got = {r["pair_id"]: r for r in preferences.format_pairs(pairs).collect()}
    one = got[1]
    assert one["n_common"] == 3 and one["prompt"].count("<|end|>") == 3
    for side, text in (("chosen", "good<|end|>"), ("rejected", "bad!<|end|>")):
        start, end = map(int, one[f"{side}_mask"].split(":"))
        assert one[side][start:end] == text
    assert got[3]["chosen"] == got[3]["rejected"] == "" and got[3]["n_common"] == 4
    assert got[5]["rejected"] is None and got[5]["chosen"].startswith("<|assistant|>")
    assert got[6]["chosen"] == "" and got[6]["prompt"] == ""


def test_one_common_opening_pairs_everyone(spark):
    df = spark.range(1001).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    got = preferences.pair_by_opening(df.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"))
    assert got.groupBy("pair_id").count().where("count = 2").count() == 500 and got.count() == 1001


def test_digest_of_no_span(spark):
    df = spark.createDataFrame([(1, "nothing")], "doc_id long, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert secrets.scan(df).select(*secrets.digest_columns(None, secrets.BASE)).first()["base_sha256"] == empty
