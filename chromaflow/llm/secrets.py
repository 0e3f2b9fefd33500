"""Secret scans over an incremental ledger of blobs.

Every version of a text is a blob, addressed by the SHA-256 of its UTF-8
bytes.  The ledger holds the spans found for each (blob, rule version) pair.
A scan addresses all rows, keeps the pairs that the ledger lacks, scans one
row of each such blob, adds the spans to the ledger, and joins them back to
all paths (rows) that hold the blob.

The ledger is a folder in the shared one: a folder for each rule version and in
it one for each scan, which counts once Spark has marked it as complete, so a
scan that breaks off leaves nothing behind that is read.

Defined results: a null text is the empty blob; an empty text has no span;
rows that repeat get the same spans; an id may be null; an empty table gives
an empty result; other columns are ignored.  Offsets are code points, the end
exclusive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Durable, hadoop_path, map_arrow, salted_join, shared_dir, sieve, table

RULE_VERSION = "2024.1"
#: Order of the kinds where two spans start at one place: the base rules, then the further ones.
KINDS = ("assign", "access", "hex", "pem", "github", "slack", "google", "jwt")
BASE = KINDS[:3]

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# Equal to the runs [A-Z0-9]+ and [0-9a-f]+ with shorter ones dropped: a run is matched from its start or not at all.
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Further rules: kind, a string that any match holds, pattern.
_MORE = (
    ("pem", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?")),
    ("github", "_", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,})")),
    ("slack", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("google", "AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}")),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
)


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, order of the kind, end) in the order of the result."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for kind, hint, pattern in _MORE:
        if hint in text:
            found += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    return sorted(found)


FOUND = "blob binary, spans string"


def _spans(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """`blobs(blob, text)` to `(blob, spans)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [_spans(find_secrets(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.string())], names=["blob", "spans"])

    return map_arrow(blobs.select("blob", "text"), run, FOUND)


def ledger_folder(spark: SparkSession) -> str:
    """The ledger that scans share unless they name another."""
    return f"{shared_dir(spark)}/chromaflow-secret-ledger"


def known(spark: SparkSession, ledger_path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """`(blob, spans)` of the complete scans under a rule version, a row a blob."""
    target, files = hadoop_path(spark, f"{ledger_path}/rules={rule_version}")
    scans = [str(s.getPath()) for s in files.listStatus(target)] if files.exists(target) else []
    done = [s for s in scans if files.exists(hadoop_path(spark, f"{s}/_SUCCESS")[0])]
    if not done:
        return spark.createDataFrame([], FOUND)
    # two scans at a time may both have added a blob
    return spark.read.schema(FOUND).parquet(*done).dropDuplicates(["blob"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger_path: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """One row per input row: the id, blob and spans.  Findings of earlier scans
    in the ledger are used and new ones are added to it.

    Only ids and digests are grouped.  A row that is alone in holding an unseen
    blob is scanned where it lies; a text moves, at most once, if its blob has
    more rows, to meet the decision which of them is scanned.  Where most blobs
    are known, only texts of the others move."""
    spark = docs.sparkSession
    ledger_path = ledger_path or ledger_folder(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    addressed = rows.withColumn("blob", F.unhex(F.sha2("text", 256)))
    paths = Durable(addressed.select("path", "blob")).read()
    seen = known(spark, ledger_path, rule_version).select(F.col("blob").alias("seen_blob"))
    grouped = paths.groupBy("blob").agg(F.min("path").alias("rep"), F.count("*").alias("n"))
    blobs = Durable(grouped.join(seen, grouped["blob"] == seen["seen_blob"], "left").select("blob", "rep", "n", F.xxhash64("blob").alias("key"), F.col("seen_blob").isNull().alias("unseen")))
    reps = blobs.read().where("unseen")
    own = F.col("unseen") & (F.col("n") == 1)
    n_own, n_unseen, n_other = blobs.read().agg(F.count_if(own), F.count_if("unseen"), F.count_if(~own)).first()
    # a row that alone holds an unseen blob is scanned where it lies; others meet the choice of their blob's row
    if n_other <= n_own:
        shared = sieve(blobs.read().where(~own), n_other)(F.xxhash64("blob"))
        alone, asked = addressed.where(~shared), addressed.where(shared)
    else:
        alone, asked = None, addressed.where(sieve(reps, n_unseen)(F.xxhash64("blob")))
    chosen = reps.select("rep", F.col("blob").alias("rep_blob"))
    todo = asked.join(chosen, asked["path"].eqNullSafe(chosen["rep"]) & (asked["blob"] == chosen["rep_blob"]), "left_semi")
    todo = todo if alone is None else alone.unionByName(todo)
    # rows that repeat an id with its text stand for one blob together
    scan_blobs(todo).dropDuplicates(["blob"]).write.parquet(f"{ledger_path}/rules={rule_version}/scan={uuid.uuid4().hex}")
    # most blobs have no span: only those that have one travel to the join
    some = known(spark, ledger_path, rule_version).where(F.col("spans") != "").withColumnRenamed("blob", "found_blob")
    return paths.join(some, paths["blob"] == some["found_blob"], "left").select("path", "blob", F.coalesce("spans", F.lit("")).alias("spans"))


def cut_spans(text: str, spans: str, mark: str) -> str:
    """The text with every span replaced by the mark; spans that overlap get one."""
    out, last = [], 0
    for _, start, end in (s.split(":") for s in spans.split(",")):
        start, end = int(start), int(end)
        if start >= last:
            out += [text[last:start], mark]
        last = max(last, end)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The same rows and columns, every span that `scan` finds replaced by
    `mark` (and `length_col`, where there is one, counted anew).  Null texts stay null.
    Only the blobs that hold a span meet the texts again."""
    found = scan(docs, id_col, text_col, **options)
    spans = Durable(found.where("spans != ''").select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans")).dropDuplicates(["__blob"]))
    addressed = docs.withColumn("__blob", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    marked = salted_join(addressed, spans.read(), ["__blob"], "left").select(*docs.columns, "__spans")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            held = columns.pop().to_pylist()
            if any(held):
                texts = [cut_spans(t, s, mark) if s else t for t, s in zip(columns[at].to_pylist(), held, strict=True)]
                columns[at] = pa.array(texts, b.schema.field(at).type)
                if length_col in names:
                    k = names.index(length_col)
                    sizes = [len(t) if s else n for t, s, n in zip(texts, held, columns[k].to_pylist(), strict=True)]
                    columns[k] = pa.array(sizes, b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(marked, run, docs.schema)


def digest_columns(found: DataFrame, kinds: tuple[str, ...]) -> list:
    """Counts and digest of the base kinds, derived from the spans."""
    spans = F.filter(F.split("spans", ","), lambda s: F.substring_index(s, ":", 1).isin(*kinds))

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: F.substring_index(s, ":", 1) == F.lit(kind))).cast("long").alias(f"n_{kind}")

    return [*map(count, kinds), F.sha2(F.array_join(spans, ","), 256).alias("base_sha256")]


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("path").alias("doc_id"), *digest_columns(found, BASE), "spans")


def reference_digest(text: str | None) -> tuple:
    """Brute force of the base columns, for tests: the rules as they are written."""
    text = text or ""
    spans = []
    for order, (kind, pattern, least) in enumerate((("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "(AKIA[A-Z0-9]+)", 20), ("hex", "([0-9a-f]+)", 24))):
        spans += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if m.end(1) - m.start(1) >= least]
    spans.sort()
    counts = [sum(s[1] == k for s in spans) for k in range(3)]
    return (*counts, hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest())
