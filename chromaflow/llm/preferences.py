"""Preference formatting in DataFrame functions only.

A preference pair is two conversations, chosen and rejected.  The longest
common prefix of their turns is rendered once as the prompt; what follows in
each is its completion, with a mask of the characters that bear loss (the
assistant's texts and end marks).

Conversations of a table without marked preferences are paired where they
open with the same turn: by ascending id within blocks of ids, then what is
left over within larger blocks, so no window ever holds a common first turn's
conversations at once.  Conversations that open like no other are paired with
a neighbour by id in the same way (their prompt is empty), so every one takes part.
The lower id is the chosen one.  A conversation that is left without a partner
is written with its last assistant turn (and what follows) as the chosen
completion and no rejected one.

Defined results: a null role is `unknown` and a null text is empty; turns that
repeat a number are ordered by role and text, a null number comes first; rows
with a null conversation id are one conversation; equal conversations have
empty completions; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Durable, table

#: Levels of pairing: whether the opening must be the same, and the bits of an id that a block spans
#: (63: one block, of what the levels before left over).
LEVELS = ((True, 7), (True, 14), (True, 21), (True, 63), (False, 7), (False, 14), (False, 21), (False, 63))
LOSS_ROLE = "assistant"


def pair_by_opening(turns: DataFrame) -> DataFrame:
    """`turns(conv_id, turn, role, text)` to `(pair_id, conv_id, side)`: side 0 is
    chosen, 1 rejected; pair_id is the chosen one's id."""
    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("t"))
    now = first.select("conv_id", F.sha2(F.concat_ws("\x1f", "t.role", "t.text"), 256).alias("opening"), F.lit(None).cast("long").alias("pair_id"), F.lit(None).cast("int").alias("side"))
    now = Durable(now).read()
    for same, bits in LEVELS:
        # rows that have a partner stand alone, in a group of their own
        block = F.when(F.col("side").isNull(), F.concat_ws(":", F.col("opening") if same else F.lit("any"), F.shiftright("conv_id", bits).cast("string"))).otherwise(F.concat_ws("=", F.lit("done"), F.col("conv_id").cast("string")))
        grouped = now.withColumn("_block", block)
        ordered = Window.partitionBy("_block").orderBy("conv_id")
        grouped = grouped.withColumn("_n", F.row_number().over(ordered)).withColumn("_before", F.lag("conv_id").over(ordered)).withColumn("_after", F.lead("conv_id").over(ordered))
        odd, open_ = F.col("_n") % 2 == 1, F.col("side").isNull()
        side = F.when(open_ & odd & F.col("_after").isNotNull(), 0).when(open_ & ~odd, 1).otherwise(F.col("side"))
        pair = F.when(open_ & odd & F.col("_after").isNotNull(), F.col("conv_id")).when(open_ & ~odd, F.col("_before")).otherwise(F.col("pair_id"))
        now = grouped.select("conv_id", "opening", pair.alias("pair_id"), side.cast("int").alias("side"))
    return now.select(F.coalesce("pair_id", "conv_id").alias("pair_id"), "conv_id", F.coalesce("side", F.lit(0)).alias("side"))


def render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _mask(turns: Column) -> Column:
    """start:end of the loss-bearing characters of the rendered turns, end exclusive, comma-joined."""

    def step(acc: Column, t: Column) -> Column:
        start = acc["pos"] + F.length(t["role"]) + 5
        end = start + F.length(t["text"]) + 7
        item = F.when(t["role"] == LOSS_ROLE, F.concat(F.lit(","), start.cast("string"), F.lit(":"), end.cast("string"))).otherwise(F.lit(""))
        return F.struct((end + 1).alias("pos"), F.concat(acc["out"], item).alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.substr(acc["out"], F.lit(2)))


def _after(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """`pairs(pair_id, rejected_id, chosen, rejected)`, both array<struct<role, text>>
    (rejected null where there is none), to the formatted rows."""
    least = F.least(F.size("chosen"), F.size("rejected"))
    same = F.transform(F.slice("chosen", F.lit(1), least), lambda t, i: t == F.get("rejected", i))
    parted = F.array_position(same, False)
    common = F.when(parted > 0, parted - 1).otherwise(least)
    # alone: up to the last assistant turn
    roles = F.reverse(F.transform("chosen", lambda t: t["role"]))
    last = F.array_position(roles, LOSS_ROLE)
    alone = F.when(last > 0, F.size("chosen") - last).otherwise(F.size("chosen"))
    n = F.when(F.col("rejected").isNull(), alone).otherwise(common).cast("int")
    cut = pairs.withColumn("n_common", n).withColumn("_p", F.slice("chosen", F.lit(1), F.col("n_common")))
    cut = cut.withColumn("_c", _after(F.col("chosen"), F.col("n_common"))).withColumn("_r", _after(F.col("rejected"), F.col("n_common")))
    text = lambda c: F.array_join(F.transform(c, render), "")
    return cut.select("pair_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"), text("_p").alias("prompt"), text("_c").alias("chosen"), text("_r").alias("rejected"), _mask(F.col("_c")).alias("chosen_mask"), _mask(F.col("_r")).alias("rejected_mask"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Pairs the conversations by their first turn and formats every pair."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = Durable(pair_by_opening(turns)).read().withColumnRenamed("conv_id", "_id")
    joined = turns.join(placed, turns["conv_id"].eqNullSafe(placed["_id"])).drop("_id")
    side = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == k, F.struct("turn", "role", "text")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    pairs = joined.groupBy("pair_id").agg(side(0).alias("chosen"), side(1).alias("rejected"), F.max(F.when(F.col("side") == 1, F.col("conv_id"))).alias("rejected_id"), F.max("side").alias("_s"))
    return format_pairs(pairs.withColumn("rejected", F.when(F.col("_s") == 1, F.col("rejected"))).drop("_s"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


def _pairing_sql() -> str:
    parts = ["p0 AS (SELECT conv_id, opening, NULL::BIGINT AS pair_id, NULL::INT AS side FROM firsts)"]
    for k, (same, bits) in enumerate(LEVELS, 1):
        done = "side IS NOT NULL"
        shift = "0" if bits >= 62 else f"(conv_id >> {bits})"
        parts.append(f"""w{k} AS (SELECT *, row_number() OVER w AS n, lag(conv_id) OVER w AS prior, lead(conv_id) OVER w AS later
  FROM p{k - 1} WINDOW w AS (PARTITION BY {done}, CASE WHEN {done} THEN conv_id END, CASE WHEN {done} THEN '' ELSE {'opening' if same else "'any'"} END, CASE WHEN {done} THEN 0 ELSE {shift} END ORDER BY conv_id)),
p{k} AS (SELECT conv_id, opening,
  CASE WHEN {done} THEN pair_id WHEN n % 2 = 0 THEN prior WHEN later IS NOT NULL THEN conv_id END AS pair_id,
  CASE WHEN {done} THEN side WHEN n % 2 = 0 THEN 1 WHEN later IS NOT NULL THEN 0 END AS side FROM w{k})""")
    return ",\n".join(parts)


SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth, count(*) OVER (PARTITION BY conv_id) AS size,
  '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered FROM turns),
firsts AS (SELECT conv_id, role || chr(31) || text AS opening FROM numbered WHERE nth = 1),
{_pairing_sql()},
pairs AS (SELECT coalesce(c.pair_id, c.conv_id) AS pair_id, c.conv_id AS chosen_id, r.conv_id AS rejected_id
  FROM p{len(LEVELS)} c LEFT JOIN p{len(LEVELS)} r ON r.side = 1 AND r.pair_id = c.conv_id WHERE coalesce(c.side, 0) = 0),
sizes AS (SELECT conv_id, max(size) AS size, max(CASE WHEN role = 'assistant' THEN nth END) AS last FROM numbered GROUP BY conv_id),
parted AS (SELECT p.pair_id, min(a.nth) AS nth FROM pairs p JOIN numbered a ON a.conv_id = p.chosen_id
  JOIN numbered b ON b.conv_id = p.rejected_id AND b.nth = a.nth WHERE a.role <> b.role OR a.text <> b.text GROUP BY 1),
cut AS (SELECT p.*, CASE WHEN p.rejected_id IS NULL THEN coalesce(c.last - 1, c.size) ELSE coalesce(d.nth - 1, least(c.size, r.size)) END AS n_common
  FROM pairs p JOIN sizes c ON c.conv_id = p.chosen_id LEFT JOIN sizes r ON r.conv_id = p.rejected_id LEFT JOIN parted d USING (pair_id)),
placed AS (SELECT c.pair_id, n.conv_id = c.chosen_id AS is_chosen, n.nth, n.role, n.text, n.rendered, c.n_common,
  coalesce(sum(length(n.rendered)) OVER (PARTITION BY n.conv_id, n.nth > c.n_common ORDER BY n.nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM cut c JOIN numbered n ON n.conv_id = c.chosen_id OR n.conv_id = c.rejected_id),
told AS (SELECT pair_id,
  coalesce(string_agg(rendered, '' ORDER BY nth) FILTER (is_chosen AND nth <= n_common), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY nth) FILTER (is_chosen AND nth > n_common), '') AS chosen,
  coalesce(string_agg(rendered, '' ORDER BY nth) FILTER (NOT is_chosen AND nth > n_common), '') AS rejected,
  coalesce(string_agg((pos + length(role) + 5)::BIGINT || ':' || (pos + length(rendered) - 1)::BIGINT, ',' ORDER BY nth) FILTER (is_chosen AND nth > n_common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((pos + length(role) + 5)::BIGINT || ':' || (pos + length(rendered) - 1)::BIGINT, ',' ORDER BY nth) FILTER (NOT is_chosen AND nth > n_common AND role = 'assistant'), '') AS rejected_mask
  FROM placed GROUP BY pair_id)
SELECT c.pair_id, c.rejected_id, c.n_common::BIGINT AS n_common, t.prompt, t.chosen,
  CASE WHEN c.rejected_id IS NOT NULL THEN t.rejected END AS rejected, t.chosen_mask,
  CASE WHEN c.rejected_id IS NOT NULL THEN t.rejected_mask END AS rejected_mask
FROM cut c JOIN told t USING (pair_id)
"""
