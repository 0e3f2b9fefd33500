"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the spans of four fixed patterns (e-mail, IP address, payment card,
telephone number).  Every token with a digit or an at-sign is an instance;
short groups of digits next to each other are one instance.  The words left
and right of an instance and its shape (letters as one, digits as nines) are
lexical patterns; patterns and instances form a graph whose edges count how
often an instance stands in a context.  In every round a pattern's confidence
is the score of its instances over all occurrences of its word, or shape, in
the corpus, and an instance's score is the noisy-or of its patterns (seeds
keep 1).  Instances that could be identifiers and whose score reaches the
border after the rounds are spans of kind `context`.

Offsets are code points, the end exclusive.  Positions come from splitting a
text at the matches and summing the lengths of the pieces, in blocks, so the
work stays in proportion to the text.  Texts are read once for spans and
instances and once for the counts of the patterns' words.

Defined results: null and empty texts have no span; repeated rows get the same
spans; null ids are allowed; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Durable, salted_join, table

# pieces of this many matches are summed on their own
_BLOCK = 128

KINDS = ("email", "ip", "card", "phone", "context")
BASE = KINDS[:4]
ROUNDS, MIN_SUPPORT, MIN_SCORE = 3, 3, 0.6
#: Share of the confidence that a pattern's word must reach to take part.
MIN_CONFIDENCE = 0.2

# Equal to the leftmost, non-overlapping matches of the plain patterns, but linear in
# long runs: a run is entered at its start (or where the last match ended) only.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A private-use character that stands for one separator between digits.
_SEP = ""
_CARD = rf"(?<![0-9{_SEP}])[0-9](?=(?:{_SEP}?[0-9]){{11}})[0-9{_SEP}]*+"
#: Outer punctuation of words; an opening plus belongs to a number.
#: A context word and a shape are at most this long; longer words are cut, longer tokens have no shape.
_LONGEST = 64
# Short groups of digits next to each other, else a token with a digit or an at-sign; entered at the start of a token only.
_GROUP = r"\(?[0-9][0-9().-]{0,7}+"
_INSTANCE = rf"(?<!\S)(?:{_GROUP}(?: {_GROUP}){{1,5}}+(?![^\s,;:])|[^\s0-9@]*+[0-9@]\S*+)"
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "+:")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(d, n + 1 - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _octets(m: Column) -> Column:
    bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.substr(p, F.lit(1), F.lit(3)).cast("int") <= 255))


def _let(value: Column, of) -> Column:
    """`of(value)` with the value found once."""
    return F.get(F.transform(F.array(value), of), 0)


def _before(sizes: Column) -> Column:
    """For each of an array's numbers the sum of those before it."""

    def sums(part: Column) -> Column:
        zero = F.struct(F.lit(0).alias("sum"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(part, zero, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")))

    def joined_up(parts: Column) -> Column:
        starts = sums(F.transform(parts, lambda p: p["sum"]))["out"]
        return F.flatten(F.zip_with(parts, starts, lambda p, s: F.transform(p["out"], lambda o: o + s)))

    def blocks(all_: Column) -> Column:
        count = F.floor((F.size(all_) + F.lit(_BLOCK - 1)) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: sums(F.slice(all_, b * _BLOCK + 1, _BLOCK)))

    return _let(sizes, lambda all_: _let(blocks(all_), joined_up))


def _matches(text: Column, pattern: str, of) -> Column:
    """`of(start, match, piece before, piece after)` of every match."""

    def told(x: Column) -> Column:
        sizes = F.zip_with(x["m"], F.slice(x["p"], 1, F.size(x["m"])), lambda m, p: F.length(m) + F.length(p))
        rows = F.arrays_zip(_before(sizes).alias("at"), x["m"].alias("m"), F.slice(x["p"], 1, F.size(x["m"])).alias("p"), F.slice(x["p"], 2, F.size(x["m"])).alias("q"))
        return F.transform(rows, lambda r: of(r["at"] + F.length(r["p"]), r["m"], r["p"], r["q"]))

    return _let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), told)


_SPANS = "array<struct<start:int,k:int,end:int>>"


def _spans(text: Column, pattern: str, order: int, valid=None) -> Column:
    """Spans of the valid matches."""

    def of(start: Column, m: Column, _p: Column, _q: Column) -> Column:
        span = F.struct(start.alias("start"), F.lit(order).alias("k"), (start + F.length(m)).alias("end"))
        return span if valid is None else F.when(valid(m), span)

    found = _matches(text, pattern, of)
    return found if valid is None else F.filter(found, lambda s: s.isNotNull())


def base_spans(text: Column) -> Column:
    """array<struct<start, k, end>> of the four fixed patterns, in order."""
    none = F.expr(f"cast(array() as {_SPANS})")
    runs = F.regexp_replace(F.translate(text, _SEP, "x"), "(?<=[0-9])[ -](?=[0-9])", _SEP)
    digits = text.rlike("[0-9]")
    parts = [
        F.when(F.instr(text, "@") > 0, _spans(text, _EMAIL, 0)).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), _spans(text, _IP, 1, _octets)).otherwise(none),
        F.when(digits, _spans(runs, _CARD, 2, _luhn)).otherwise(none),
        F.when(text.rlike(r"\+[0-9]"), _spans(text, _PHONE, 3, lambda m: F.length(_digits(m)).between(9, 15))).otherwise(none),
    ]
    return F.sort_array(F.concat(*[p.cast(_SPANS) for p in parts]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _word(w: Column) -> Column:
    """A context word: lower case, without outer punctuation but a closing colon."""
    return F.rtrim(F.ltrim(F.lower(w), F.lit(_MARKS + ":")), F.lit(_MARKS))


def _grouped(base: Column) -> Column:
    """Sorted spans in groups of about the root of their number: array<struct<lo, hi, spans>>."""

    def group(spans: Column, size: Column) -> Column:
        count = F.ceil(F.size(spans) / size).cast("int")
        parts = F.transform(F.sequence(F.lit(1), count), lambda g: F.slice(spans, (g - 1) * size + 1, size))
        return F.transform(parts, lambda p: F.struct(p[0]["start"].alias("lo"), F.array_max(F.transform(p, lambda s: s["end"])).alias("hi"), p.alias("spans")))

    none = F.expr(f"cast(array() as array<struct<lo:int,hi:int,spans:{_SPANS}>>)")
    return F.when(F.size(base) > 0, group(base, F.ceil(F.sqrt(F.size(base).cast("double"))).cast("int"))).otherwise(none)


def instances(text: Column, base: Column) -> Column:
    """array<struct<start, end, token, left, right, shape, seed>> of the tokens that may be identifiers."""
    return _let(_grouped(base), lambda groups: _instances(text, groups))


def _instances(text: Column, groups: Column) -> Column:
    def of(start: Column, m: Column, before: Column, after: Column) -> Column:
        # outer punctuation is not part of an identifier
        core = F.rtrim(F.ltrim(m, F.lit(_MARKS + ":")), F.lit(_MARKS + ":"))
        begin = start + F.length(m) - F.length(F.ltrim(m, F.lit(_MARKS + ":")))
        end = begin + F.length(core)
        left = F.regexp_extract(F.right(F.rtrim(before), F.lit(_LONGEST)), r"\S+$", 0)
        right = F.regexp_extract(F.left(F.ltrim(after), F.lit(_LONGEST)), r"^\S+", 0)
        shape = F.when(F.length(core) <= _LONGEST, F.regexp_replace(F.regexp_replace(core, "[0-9]", "9"), r"\p{L}+", "a")).otherwise("")
        seed = F.exists(groups, lambda g: (g["lo"] < end) & (g["hi"] > begin) & F.exists(g["spans"], lambda s: (s["start"] < end) & (s["end"] > begin)))
        return F.struct(begin.alias("start"), end.alias("end"), core.alias("token"), _word(left).alias("left"), _word(right).alias("right"), shape.alias("shape"), seed.alias("seed"))

    none = F.expr("cast(array() as array<struct<start:int,end:int,token:string,left:string,right:string,shape:string,seed:boolean>>)")
    return F.when(text.rlike("[0-9@]"), F.filter(_matches(text, _INSTANCE, of), lambda t: t["token"] != "")).otherwise(none)


def _patterns(tokens: DataFrame) -> DataFrame:
    """Edges of the graph: pattern (side and word), token, seed, n."""
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("word")) for k, c in (("L", "left"), ("R", "right"), ("S", "shape")))))
    return tokens.select("token", "seed", sides.alias("p")).where("p.word != '' and (p.side = 'S' or not p.word rlike '[0-9]')").groupBy("p.side", "p.word", "token").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))


def discover(rows: DataFrame, tokens: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE) -> DataFrame:
    """Scores of the tokens that are no seeds: token, score."""
    edges = Durable(_patterns(tokens))
    # a pattern needs seeds of several values, and an instance that is not a seed
    known = Durable(edges.read().groupBy("side", "word").agg(F.count_if("seed").alias("support"), F.count_if(~F.col("seed")).alias("open")).where((F.col("support") >= min_support) & (F.col("open") > 0)).select("side", "word"))
    wanted = Durable(known.read().where("side != 'S'").select("word").distinct())
    small = wanted.read().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(wanted.read()) if small else wanted.read()
    words = rows.select(F.explode(F.split("text", r"\s+")).alias("w")).select(_word(F.col("w")).alias("word")).join(side, "word", "left_semi")
    counted = words.groupBy("word").agg(F.count("*").alias("total"))
    # a shape occurs as often as its tokens do
    shapes = edges.read().where("side = 'S'").join(known.read(), ["side", "word"], "left_semi").groupBy("side", "word").agg(F.sum("n").alias("total"))
    totals = Durable(known.read().where("side != 'S'").join(counted, "word").select("side", "word", "total").unionByName(shapes))
    graph = Durable(edges.read().join(totals.read(), ["side", "word"]))
    score = graph.read().select("token", "seed").distinct().groupBy("token").agg(F.max(F.col("seed").cast("double")).alias("score"), F.max("seed").alias("seed"))
    score = Durable(score)
    for _ in range(rounds):
        confidence = graph.read().drop("seed").join(score.read().select("token", "score"), "token").groupBy("side", "word").agg((F.sum(F.col("n") * F.col("score")) / (F.first("total") + F.lit(1.0))).alias("confidence")).where(F.col("confidence") >= MIN_CONFIDENCE)
        reach = graph.read().select("side", "word", "token").join(confidence, ["side", "word"]).groupBy("token").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("reached"))
        new = Durable(score.read().join(reach, "token", "left").select("token", "seed", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("reached", F.lit(0.0))).alias("score")))
        score.drop()
        score = new
    return score.read().where(~F.col("seed") & (F.col("score") >= min_score)).select("token", "score")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, base and spans (arrays of start, k, end; k numbers KINDS)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    based = rows.select("id", F.xxhash64("text").alias("h"), "text", base_spans(F.col("text")).alias("base"))
    walked = Durable(based.select("id", "h", "base", instances(F.col("text"), F.col("base")).alias("found")))
    tokens = walked.read().select("id", "h", F.explode("found").alias("t")).select("id", "h", "t.*")
    found = Durable(discover(rows, tokens, **options))
    # identifier shape: at least 6 characters with 4 digits, or an address
    shaped = (F.length("token") >= 6) & ((F.length(_digits(F.col("token"))) >= 4) | F.col("token").rlike("@.*[A-Za-z]"))
    new = tokens.where(~F.col("seed") & shaped).join(found.read(), "token", "left_semi")
    per_row = Durable(new.groupBy("id", "h").agg(F.collect_set(F.struct(F.col("start"), F.lit(4).alias("k"), F.col("end"))).alias("more")))
    out = salted_join(walked.read().select("id", "h", "base"), per_row.read(), ["id", "h"], "left", weight=F.size("more"))
    empty = F.expr(f"cast(array() as {_SPANS})")
    return out.select("id", "base", F.sort_array(F.concat("base", F.coalesce("more", empty))).alias("spans"))


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["k"] == F.lit(k))).cast("long").alias(f"n_{KINDS[k]}")

    return found.select(F.col("id").alias("doc_id"), *map(count, range(4)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
