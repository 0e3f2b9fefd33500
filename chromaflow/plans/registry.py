"""Registered queries, each next to the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaflow.functions import color as C
from chromaflow.operators import delta, dither, filters, hist, nearest, palette
from chromaflow.operators.lzw import encode as lzw_encode
from chromaflow.plans import encode as plan
from chromaflow.sources import bindings as B
from chromaflow.sources import clip as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Eight colours of the lookup queries.
PALETTE = ((20, 200, 30), (80, 150, 30), (140, 100, 90), (200, 50, 30), (0, 0, 0), (255, 255, 255), (130, 125, 124), (60, 60, 200))
FPS = (30_000, 1001)

EVENTS = """px AS (SELECT (event_id // 100)::INT AS frame, ((event_id % 100) // 10)::INT AS y, (event_id % 10)::INT AS x, (event_id % 100)::INT AS pos,
  (v * 60 + 20)::INT AS r, (200 - v * 50)::INT AS g, CASE WHEN event_type = 'click' THEN 90 ELSE 30 END AS b,
  CASE WHEN event_type = 'purchase' THEN 0 ELSE 255 END AS a, v::INT AS idx
  FROM (SELECT *, least(floor(value / 16), 3)::INT AS v FROM events))"""
LINES = """colors AS (SELECT (floor(l_quantity) * 5)::INT AS r, (round(l_discount * 100) * 25)::INT AS g, (round(l_tax * 100) * 31)::INT AS b FROM lineitem),
hist AS (SELECT (r * 65536 + g * 256 + b)::INT AS rgb, count(*) AS n FROM colors GROUP BY 1),
split AS (SELECT rgb, n, rgb >> 16 AS r, (rgb >> 8) & 255 AS g, rgb & 255 AS b FROM hist)"""
PALETTE_SQL = "palette(idx, r, g, b) AS (VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE)) + ")"


def _fresh(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Runs with the session's own batch size, whatever an operator before has set."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        return fn(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = _fresh(fn)
        if sql:
            SQL[name] = sql
        return fn

    return add


def palette_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(PALETTE)], "idx int, r int, g int, b int")


def palette_np():
    import numpy as np

    return np.array(PALETTE, dtype=np.uint8)


# Histograms.


@query("color_histogram", f"WITH {EVENTS} SELECT (r * 65536 + g * 256 + b)::INT AS rgb, count(*) AS n FROM px WHERE a >= 128 GROUP BY 1")
def _(spark, d):
    return hist.color_histogram(B.event_raster(spark, d))


@query("line_color_histogram", f"WITH {LINES} SELECT rgb, n FROM hist")
def _(spark, d):
    c = B.line_colors(spark, d)
    return hist.color_histogram(c.withColumn("a", F.lit(255)))


@query("change_weighted_histogram", f"WITH {EVENTS} SELECT (r * 65536 + g * 256 + b)::INT AS rgb, count(*) AS n FROM px WHERE a >= 128 GROUP BY 1")
def _(spark, d):
    return hist.change_weighted_histogram(B.event_raster(spark, d))


STRETCHES = """keyed AS (SELECT frame, y, x, CASE WHEN a >= 128 THEN r * 65536 + g * 256 + b ELSE -1 END AS k FROM px),
marked AS (SELECT *, CASE WHEN k = lag(k, 1, -2) OVER (PARTITION BY y, x ORDER BY frame) THEN 0 ELSE 1 END AS new FROM keyed),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY y, x ORDER BY frame) AS island FROM marked)
SELECT y, x, min(frame) AS first, k::INT AS rgb, count(*) AS len FROM numbered WHERE k >= 0 GROUP BY y, x, island, k"""


@query("pixel_stretches", f"WITH {EVENTS}, {STRETCHES}")
def _(spark, d):
    return hist.stretches(B.event_raster(spark, d))


@query("order_stretches", """WITH px AS (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS frame, 0 AS y, o_custkey AS x,
  CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'O' THEN 20 ELSE 30 END AS r, 0 AS g, 0 AS b, 255 AS a FROM orders), """ + STRETCHES.replace("min(frame) AS first", "min(frame)::INT AS first"))
def _(spark, d):
    return hist.stretches(B.order_line(spark, d))


RUNS = """own AS (SELECT frame, y * 10 + x AS nth, r * 65536 + g * 256 + b AS rgb FROM px WHERE a >= 128),
marked AS (SELECT *, CASE WHEN rgb = lag(rgb) OVER (PARTITION BY frame ORDER BY nth) THEN 0 ELSE 1 END AS new FROM own),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY frame ORDER BY nth) AS run FROM marked),
runs AS (SELECT frame, run::BIGINT AS run, rgb::INT AS rgb, count(*) AS len FROM numbered GROUP BY frame, run, rgb)"""


@query("run_length_scan", f"WITH {EVENTS}, {RUNS} SELECT * FROM runs")
def _(spark, d):
    return hist.row_runs(B.event_raster(spark, d))


@query("packed_runs", f"WITH {EVENTS}, {RUNS} SELECT frame, run, part::BIGINT AS part, rgb, least(2, len - part * 2)::BIGINT AS len FROM runs, LATERAL (SELECT unnest(range(0, (len - 1) // 2 + 1)) AS part)")
def _(spark, d):
    return hist.row_runs(B.event_raster(spark, d), packed=2)


FOLD = """cells AS (SELECT (((r >> 2) << 12) + ((g >> 2) << 6) + (b >> 2))::INT AS cell, sum(n)::BIGINT AS n, sum(n * r)::BIGINT AS sr, sum(n * g)::BIGINT AS sg, sum(n * b)::BIGINT AS sb FROM split GROUP BY 1)"""


@query("coarse_fold", f"WITH {LINES}, {FOLD} SELECT cell, n, ((sr + n // 2) // n)::INT AS r, ((sg + n // 2) // n)::INT AS g, ((sb + n // 2) // n)::INT AS b FROM cells")
def _(spark, d):
    return hist.coarse_fold(B.line_histogram(spark, d))


@query("folded_entries", f"""WITH {LINES}, {FOLD}, means AS (SELECT n, ((sr + n // 2) // n) * 65536 + ((sg + n // 2) // n) * 256 + (sb + n // 2) // n AS rgb FROM cells)
SELECT rgb::INT AS rgb, sum(n)::BIGINT AS n FROM means GROUP BY 1""")
def _(spark, d):
    return hist.palette_entries(B.line_histogram(spark, d), fold_above=100)


@query("occupied_cells", f"WITH {LINES} SELECT DISTINCT (((r >> 2) << 12) + ((g >> 2) << 6) + (b >> 2))::INT AS cell FROM split")
def _(spark, d):
    return hist.occupied_cells(B.line_histogram(spark, d))


@query("sorted_entries", f"WITH {LINES} SELECT rgb, n, row_number() OVER (ORDER BY rgb) AS place FROM hist")
def _(spark, d):
    return hist.sorted_entries(B.line_histogram(spark, d))


@query("any_alpha", f"WITH {EVENTS} SELECT bool_or(a < 128) AS any_alpha FROM px")
def _(spark, d):
    return hist.any_transparent(B.event_raster(spark, d))


# Colour projections.

CLAMP = "greatest(0, least(255, {0}))::INT"


@query("yuv_to_rgb", f"""WITH {LINES}, yuv AS (SELECT r AS y, g AS u, b AS v FROM split)
SELECT y, u, v, {CLAMP.format('((76309 * (y - 16) + 104597 * (v - 128) + 32768) >> 16)')} AS r,
  {CLAMP.format('((76309 * (y - 16) - 25675 * (u - 128) - 53279 * (v - 128) + 32768) >> 16)')} AS g,
  {CLAMP.format('((76309 * (y - 16) + 132201 * (u - 128) + 32768) >> 16)')} AS b,
  {CLAMP.format('((76309 * (y - 16) + 32768) >> 16)')} AS grey FROM yuv""")
def _(spark, d):
    y, u, v = C.channels(F.col("rgb"))
    yuv = B.line_histogram(spark, d).select(y.alias("y"), u.alias("u"), v.alias("v"))
    r, g, b = C.yuv_to_rgb(F.col("y"), F.col("u"), F.col("v"))
    return yuv.select("y", "u", "v", r.alias("r"), g.alias("g"), b.alias("b"), C.mono_to_rgb(F.col("y")).alias("grey"))


@query("chroma_positions", f"WITH {EVENTS} SELECT DISTINCT y, x, (x >> 1)::INT AS x420, (y >> 1)::INT AS y420, (x >> 1)::INT AS x422, y AS y422, x AS x444, y AS y444 FROM px")
def _(spark, d):
    at = B.event_raster(spark, d).select("y", "x").distinct()
    parts = [(n, *C.chroma_at(n, F.col("x"), F.col("y"))) for n in ("420", "422", "444")]
    return at.select("y", "x", *(c.alias(f"{k}{n}") for n, cx, cy in parts for k, c in (("x", cx), ("y", cy))))


@query("color_keys", f"""WITH {LINES} SELECT rgb, (((r >> 2) << 12) + ((g >> 2) << 6) + (b >> 2))::INT AS grid, (((g >> 2) << 6) + (b >> 2))::INT AS slab,
  (((((r >> 2) << 12) + ((g >> 2) << 6) + (b >> 2)) << 6) + ((r & 3) << 4) + ((g & 3) << 2) + (b & 3))::INT AS tiled FROM split""")
def _(spark, d):
    c = C.channels(F.col("rgb"))
    return B.line_histogram(spark, d).select("rgb", C.grid_key(*c).alias("grid"), C.slab_key(*c).alias("slab"), C.tiled_key(*c).alias("tiled"))


LINEAR = "(CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


def _sum(row, names) -> str:
    return "(" + " + ".join(f"({k!r})::DOUBLE * {n}" for k, n in zip(row, names, strict=True)) + ")"


OKLAB = "lin AS (SELECT *, " + ", ".join(f"{LINEAR.format(c)} AS l{c}" for c in "rgb") + " FROM split), " + "lms AS (SELECT *, " + ", ".join(f"cbrt({_sum(row, ('lr', 'lg', 'lb'))}) AS c{i}" for i, row in enumerate(C.TO_LMS)) + " FROM lin), " + "lab AS (SELECT *, " + ", ".join(f"{_sum(row, ('c0', 'c1', 'c2'))} AS {n}" for n, row in zip(("ll", "la", "lb2"), C.TO_LAB, strict=True)) + " FROM lms)"


@query("oklab_projection", f"WITH {LINES}, {OKLAB} SELECT rgb, round(lr, 6) AS lin_r, round(ll, 6) + 0.0 AS l, round(la, 6) + 0.0 AS a, round(lb2, 6) + 0.0 AS b FROM lab")
def _(spark, d):
    c = C.channels(F.col("rgb"))
    lum, a, b = C.oklab(*c)
    return B.line_histogram(spark, d).select("rgb", F.round(C.srgb_to_linear(c[0]), 6).alias("lin_r"), *((F.round(v, 6) + F.lit(0.0)).alias(n) for n, v in (("l", lum), ("a", a), ("b", b))))


@query("oklab_round_trip", f"WITH {LINES} SELECT rgb, r::INT AS r, g::INT AS g, b::INT AS b FROM split")
def _(spark, d):
    c = C.channels(F.col("rgb"))
    lab = B.line_histogram(spark, d).select("rgb", *(v.alias(n) for n, v in zip(("l", "a", "b"), C.oklab(*c), strict=True)))
    r, g, b = C.oklab_to_rgb(F.col("l"), F.col("a"), F.col("b"))
    return lab.select("rgb", r.alias("r"), g.alias("g"), b.alias("b"))


@query("lossy_scale", "SELECT att::INT AS att, (8 + (256 - att) * 247 // 256)::INT AS scale FROM range(0, 257) t(att)")
def _(spark, d):
    return spark.range(257).select(F.col("id").cast("int").alias("att"), C.lossy_scale(F.col("id").cast("int")).alias("scale"))


# Lookups.

NEAREST_SQL = """scored AS (SELECT rgb, n, s.r, s.g, s.b, p.idx, p.r AS pr, p.g AS pg, p.b AS pb, (p.r - s.r) * (p.r - s.r) + (p.g - s.g) * (p.g - s.g) + (p.b - s.b) * (p.b - s.b) AS d FROM split s, palette p),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rgb ORDER BY d, idx) AS k FROM scored) WHERE k = 1)"""


@query("nearest_color", f"WITH {LINES}, {PALETTE_SQL}, {NEAREST_SQL} SELECT rgb, idx::INT AS idx FROM best")
def _(spark, d):
    return B.line_histogram(spark, d).select("rgb", nearest.nearest_rgb(nearest.palette_array(palette_np()), *C.channels(F.col("rgb"))).alias("idx"))


@query("lookup_join", f"WITH {LINES}, {PALETTE_SQL}, {NEAREST_SQL} SELECT idx::INT AS idx, sum(n)::BIGINT AS n FROM best GROUP BY 1")
def _(spark, d):
    h = B.line_histogram(spark, d)
    lut = h.select("rgb", nearest.nearest_rgb(nearest.palette_array(palette_np()), *C.channels(F.col("rgb"))).alias("idx"))
    # colours repeat: the histogram meets the table, not every row
    return nearest.map_colors(h, lut).groupBy("idx").agg(F.sum("n").alias("n"))


def lut_sql(name: str, source: str) -> str:
    """CTEs that give the palette index nearest in OkLab of every colour of `source`, as name(r, g, b, idx)."""
    lab = OKLAB.replace("FROM split)", f"FROM {name}_c)").replace("lin AS", f"{name}_lin AS").replace("FROM lin)", f"FROM {name}_lin)")
    lab = lab.replace("lms AS", f"{name}_lms AS").replace("FROM lms)", f"FROM {name}_lms)").replace("lab AS", f"{name}_lab AS")
    gap = " + ".join(f"(c.{k} - p.{k}) * (c.{k} - p.{k})" for k in ("ll", "la", "lb2"))
    return f"""{name}_c AS (SELECT DISTINCT r, g, b FROM {source}), {lab}, {name} AS (SELECT r, g, b, idx FROM (
  SELECT c.r, c.g, c.b, p.idx, row_number() OVER (PARTITION BY c.r, c.g, c.b ORDER BY {gap}, p.idx) AS k FROM {name}_lab c, lab p) WHERE k = 1)"""


PALETTE_LAB = f"{PALETTE_SQL}, {OKLAB.replace(' FROM split)', ' FROM palette)')}"


@query("nearest_color_oklab", f"WITH {LINES}, {PALETTE_LAB}, {lut_sql('lut', 'split')} SELECT s.rgb, l.idx::INT AS idx FROM split s JOIN lut l USING (r, g, b)")
def _(spark, d):
    return nearest.build_lut(B.line_histogram(spark, d), palette_np())


MEANS_SQL = """parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
centers AS (SELECT label, i, round(avg(e), 6) AS c FROM parts GROUP BY label, i),
far AS (SELECT p.vec_id, c.label AS center, round(sum((p.e - c.c) * (p.e - c.c)), 4) AS d FROM parts p JOIN centers c USING (i) GROUP BY 1, 2),
best AS (SELECT vec_id, center, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, center) AS k FROM far) WHERE k = 1)"""


def _centers(spark, d):
    """At most as many rows as there are labels: one mean vector each."""
    v = B.vectors(spark, d).select("label", F.posexplode("v").alias("i", "e"))
    means = v.groupBy("label", "i").agg(F.round(F.avg("e"), 6).alias("c"))
    return means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))


@query("nearest_centroid", f"WITH {MEANS_SQL} SELECT vec_id, center::INT AS center, d FROM best")
def _(spark, d):
    centers = _centers(spark, d).agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("palette"))
    gap = lambda p: F.round(F.aggregate(F.zip_with("v", p["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 4)
    scored = B.vectors(spark, d).crossJoin(F.broadcast(centers)).select("vec_id", F.array_min(F.transform("palette", lambda p: F.struct(gap(p).alias("d"), p["label"].alias("label")))).alias("m"))
    return scored.select("vec_id", F.col("m.label").cast("int").alias("center"), F.col("m.d").alias("d"))


@query("kmeans_step", f"""WITH {LINES}, {PALETTE_SQL}, {NEAREST_SQL},
tops AS (SELECT idx, rgb AS dominant, n AS dominant_n FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY n DESC, rgb) AS t FROM best) WHERE t = 1)
SELECT b.idx::INT AS idx, sum(n)::BIGINT AS total, round(sum(n * r) / sum(n), 6) AS mean_r, round(sum(n * g) / sum(n), 6) AS mean_g, round(sum(n * b.b) / sum(n), 6) AS mean_b, dominant, dominant_n
FROM best b JOIN tops t ON t.idx = b.idx GROUP BY b.idx, dominant, dominant_n""")
def _(spark, d):
    r, g, b = C.channels(F.col("rgb"))
    entries = B.line_histogram(spark, d).select("rgb", "n", r.alias("r"), g.alias("g"), b.alias("b"))
    at = entries.withColumn("idx", nearest.nearest_rgb(nearest.palette_array(palette_np()), F.col("r"), F.col("g"), F.col("b")))
    out = palette.kmeans_step(at, "idx", ["r", "g", "b"])
    return out.select("idx", "total", *(F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in "rgb"), "dominant", "dominant_n")


@query("box_moments", f"""WITH {LINES}, boxed AS (SELECT *, (r // 64)::INT AS box FROM split),
tops AS (SELECT box, rgb AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY box ORDER BY n DESC, rgb) AS t FROM boxed) WHERE t = 1),
sums AS (SELECT box, sum(n)::BIGINT AS total, sum(n * r)::BIGINT AS sum_r, sum(n * g)::BIGINT AS sum_g, sum(n * b)::BIGINT AS sum_b,
  sum(n * r * r)::DOUBLE AS qr, sum(n * g * g)::DOUBLE AS qg, sum(n * b * b)::DOUBLE AS qb FROM boxed GROUP BY box),
errs AS (SELECT *, greatest(0.0, qr - sum_r::DOUBLE * sum_r / total) AS err_r, greatest(0.0, qg - sum_g::DOUBLE * sum_g / total) AS err_g, greatest(0.0, qb - sum_b::DOUBLE * sum_b / total) AS err_b FROM sums)
SELECT e.box, total, sum_r, sum_g, sum_b, round(err_r, 3) AS err_r, round(err_g, 3) AS err_g, round(err_b, 3) AS err_b, dominant,
  CASE WHEN err_r >= err_g AND err_r >= err_b THEN 0 WHEN err_g >= err_b THEN 1 ELSE 2 END AS axis FROM errs e JOIN tops t ON t.box = e.box""")
def _(spark, d):
    r, g, b = C.channels(F.col("rgb"))
    entries = B.line_histogram(spark, d).select("rgb", "n", r.alias("r"), g.alias("g"), b.alias("b"), F.floor(r / 64).cast("int").alias("box"))
    out = palette.box_moments(entries, "box", ["r", "g", "b"])
    return out.select("box", "total", "sum_r", "sum_g", "sum_b", *(F.round(f"err_{c}", 3).alias(f"err_{c}") for c in "rgb"), "dominant", "axis")


@query("weighted_median_split", f"""WITH {LINES}, boxed AS (SELECT rgb, n, g, (r // 64)::INT AS box FROM split),
reach AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY box ORDER BY g, rgb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY box) AS total,
  row_number() OVER (PARTITION BY box ORDER BY g DESC, rgb DESC) AS back, count(*) OVER (PARTITION BY box) AS size FROM boxed)
SELECT box, rgb, n, before <= (total + 1) // 2 AND NOT (back = 1 AND size > 1) AS is_left FROM reach""")
def _(spark, d):
    r, g, _b = C.channels(F.col("rgb"))
    entries = B.line_histogram(spark, d).select("rgb", "n", g.alias("g"), F.floor(r / 64).cast("int").alias("box"))
    return palette.weighted_split(entries, "box", "g").select("box", "rgb", "n", "is_left")


PAIR_LAB = OKLAB.replace(" FROM split)", " FROM palette)")


@query("band_pairs", f"WITH {PALETTE_SQL}, {PAIR_LAB}, d AS (SELECT a.idx AS i, b.idx AS j, sqrt((a.ll - b.ll) * (a.ll - b.ll) + (a.la - b.la) * (a.la - b.la) + (a.lb2 - b.lb2) * (a.lb2 - b.lb2)) AS d FROM lab a, lab b) SELECT i::INT AS i, j::INT AS j, d >= 0.15 AND d < 0.4 AS eligible FROM d")
def _(spark, d):
    return nearest.band_pairs(palette_df(spark), 0.15, 0.4)


@query("substitution_candidates", f"""WITH {PALETTE_SQL}, pairs AS (SELECT a.idx AS i, b.idx AS j, (a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b) AS d FROM palette a, palette b WHERE a.idx <> b.idx)
SELECT i::INT AS i, j::INT AS j, d::INT AS d, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM pairs WHERE d <= 40 * 200) WHERE rank <= 16""")
def _(spark, d):
    return nearest.substitutes(palette_df(spark), 200)


# Change and timing.

PREV = "prev AS (SELECT *, lag(idx) OVER (PARTITION BY y, x ORDER BY frame) AS prev FROM px)"


@query("changed_bbox", f"WITH {EVENTS}, {PREV} SELECT frame, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS changed FROM prev WHERE prev <> idx GROUP BY frame")
def _(spark, d):
    return delta.changed_box(B.event_indexes(spark, d))


@query("punched_rows", f"WITH {EVENTS}, {PREV} SELECT frame, y, x, idx, CASE WHEN prev = idx THEN 4 ELSE idx END AS punched FROM prev")
def _(spark, d):
    return delta.punch(B.event_indexes(spark, d), 4)


@query("punch_choice", f"""WITH {EVENTS}, {PREV}, sums AS (SELECT frame, count(*) AS pixels, count(*) FILTER (prev = idx) AS same FROM prev GROUP BY frame)
SELECT *, CASE WHEN same * 5 >= pixels * 3 THEN 'punched' WHEN same * 20 <= pixels THEN 'plain' ELSE 'both' END AS choice FROM sums""")
def _(spark, d):
    return delta.punched_share(B.event_indexes(spark, d))


DELAYS = f"timing AS (SELECT frame, (((frame + 1) * 100 * {FPS[1]} + {FPS[0] // 2}) // {FPS[0]} - (frame * 100 * {FPS[1]} + {FPS[0] // 2}) // {FPS[0]})::BIGINT AS delay_cs FROM (SELECT DISTINCT (event_id // 100) AS frame FROM events))"


@query("frame_delays", f"WITH {DELAYS} SELECT frame::INT AS frame, delay_cs FROM timing")
def _(spark, d):
    return delta.frame_delays(B.event_raster(spark, d).select("frame").distinct(), *FPS)


@query("fold_duplicates", f"""WITH {DELAYS}, shown AS (SELECT frame, delay_cs, frame % 7 NOT IN (2, 3) AS visible FROM timing), grouped AS (SELECT *, sum(visible::INT) OVER (ORDER BY frame) AS g FROM shown)
SELECT min(frame)::INT AS frame, least(sum(delay_cs), 65535)::BIGINT AS delay_cs, count(*) AS frames FROM grouped WHERE g > 0 GROUP BY g""")
def _(spark, d):
    timing = delta.frame_delays(B.event_raster(spark, d).select("frame").distinct(), *FPS)
    return delta.fold_duplicates(timing.withColumn("visible", ~(F.col("frame") % 7).isin(2, 3)))


# Dithering.

ACT = """near AS (SELECT *, coalesce(lag(r) OVER h, r) AS lr, coalesce(lag(g) OVER h, g) AS lg, coalesce(lag(b) OVER h, b) AS lb, coalesce(lag(r) OVER v, r) AS ur, coalesce(lag(g) OVER v, g) AS ug, coalesce(lag(b) OVER v, b) AS ub
  FROM px WINDOW h AS (PARTITION BY frame, y ORDER BY x), v AS (PARTITION BY frame, x ORDER BY y)),
acts AS (SELECT *, (abs(r - lr) + abs(g - lg) + abs(b - lb) + abs(r - ur) + abs(g - ug) + abs(b - ub))::INT AS act FROM near)"""


@query("activity_attenuation", f"WITH {EVENTS}, {ACT} SELECT frame, y, x, act, greatest(0, least(256, (160 + 64 - act) * 4))::INT AS att FROM acts")
def _(spark, d):
    return dither.with_attenuation(B.event_raster(spark, d), 160).select("frame", "y", "x", "act", "att")


LONG = """marks AS (SELECT frame, y, x, idx, CASE WHEN idx = lag(idx) OVER (PARTITION BY frame, y ORDER BY x) THEN 0 ELSE 1 END AS new FROM px),
isles AS (SELECT *, sum(new) OVER (PARTITION BY frame, y ORDER BY x) AS isle FROM marks),
runs AS (SELECT frame, y, x, idx, count(*) OVER (PARTITION BY frame, y, isle) >= 2 AS long_run FROM isles)"""
CONTOURS = """sides AS (SELECT *, lag(idx) OVER h AS li, lag(long_run) OVER h AS lr, lag(idx) OVER v AS ui, lag(long_run) OVER v AS ur FROM runs WINDOW h AS (PARTITION BY frame, y ORDER BY x), v AS (PARTITION BY frame, x ORDER BY y)),
lines AS (SELECT frame, y, x, idx, long_run, (coalesce(long_run AND lr AND idx <> li, false)::INT + coalesce(long_run AND ur AND idx <> ui, false)::INT)::INT AS contours FROM sides)"""


@query("long_runs", f"WITH {EVENTS}, {LONG} SELECT * FROM runs")
def _(spark, d):
    return dither.long_runs(B.event_indexes(spark, d), 2)


@query("contours", f"WITH {EVENTS}, {LONG}, {CONTOURS} SELECT * FROM lines")
def _(spark, d):
    return dither.contours(dither.long_runs(B.event_indexes(spark, d), 2))


@query("eligible_contours", f"WITH {EVENTS}, {LONG}, {CONTOURS.replace('idx <> li', 'idx <> li AND abs(idx - li) = 1').replace('idx <> ui', 'idx <> ui AND abs(idx - ui) = 1')} SELECT * FROM lines")
def _(spark, d):
    pairs = spark.createDataFrame([(i, j, abs(i - j) == 1) for i in range(4) for j in range(4)], "i int, j int, eligible boolean")
    return dither.contours(dither.long_runs(B.event_indexes(spark, d), 2), pairs)


@query("band_tiles", f"""WITH {EVENTS}, {LONG}, {CONTOURS}, sums AS (SELECT frame, (y // 4)::INT AS ty, (x // 4)::INT AS tx, sum(contours)::BIGINT AS contour, count(*) AS area FROM lines GROUP BY 1, 2, 3),
own AS (SELECT *, contour * 8 > area AS own FROM sums) SELECT frame, ty, tx, contour, area, own OR (sum(own::INT) OVER (PARTITION BY frame)) * 4 > count(*) OVER (PARTITION BY frame) * 3 AS live FROM own""")
def _(spark, d):
    return dither.tiles(dither.contours(dither.long_runs(B.event_indexes(spark, d), 2)), size=4, density=8)


BAYER = "bayer(v, nth) AS (SELECT unnest([" + ", ".join(str(int(v)) for v in C.bayer8().ravel()) + "]), unnest(range(0, 64)))"


@query("bayer_offset", f"WITH {EVENTS}, {BAYER} SELECT frame, y, x, ((v >> 2) - 8)::INT AS moved, greatest(0, least(255, r + (v >> 2) - 8))::INT AS r FROM px JOIN bayer ON nth = (y % 8) * 8 + x % 8")
def _(spark, d):
    moved = dither.bayer_offset(F.col("y"), F.col("x"))
    return B.event_raster(spark, d).select("frame", "y", "x", moved.alias("moved"), C.clamp8(F.col("r") + moved).alias("r"))


@query("far_probe", f"""WITH {LINES}, {PALETTE_SQL}, {NEAREST_SQL} SELECT rgb, idx::INT AS c1, {CLAMP.format('r + 2 * (r - pr)')} AS pr, {CLAMP.format('g + 2 * (g - pg)')} AS pg, {CLAMP.format('b + 2 * (b - pb)')} AS pb, r <> pr OR g <> pg OR b <> pb AS has_error FROM best""")
def _(spark, d):
    at = _near(spark, d)
    parts = [C.far_probe(F.col(c), F.col(f"c1.{c}")).alias(f"p{c}") for c in "rgb"]
    return at.select("rgb", F.col("idx").alias("c1"), *parts, ((F.col("r") != F.col("c1.r")) | (F.col("g") != F.col("c1.g")) | (F.col("b") != F.col("c1.b"))).alias("has_error"))


def _near(spark, d):
    r, g, b = C.channels(F.col("rgb"))
    colors = nearest.palette_array(palette_np())
    at = B.line_histogram(spark, d).select("rgb", r.alias("r"), g.alias("g"), b.alias("b"))
    at = at.withColumn("idx", nearest.nearest_rgb(colors, F.col("r"), F.col("g"), F.col("b")))
    return at.withColumn("c1", F.get(colors, F.col("idx")))


@query("ordered_pick", f"""WITH {LINES}, {PALETTE_SQL}, {BAYER}, {NEAREST_SQL},
mirrored AS (SELECT *, greatest(0, least(255, r + 2 * (r - pr))) AS qr, greatest(0, least(255, g + 2 * (g - pg))) AS qg, greatest(0, least(255, b + 2 * (b - pb))) AS qb FROM best),
away AS (SELECT m.rgb, m.idx AS c1, m.r, m.g, m.b, m.pr, m.pg, m.pb, p.idx AS c2, p.r AS fr, p.g AS fg, p.b AS fb, row_number() OVER (PARTITION BY m.rgb ORDER BY (p.r - qr) * (p.r - qr) + (p.g - qg) * (p.g - qg) + (p.b - qb) * (p.b - qb), p.idx) AS t FROM mirrored m, palette p),
spans AS (SELECT *, (r - pr) * (fr - pr) + (g - pg) * (fg - pg) + (b - pb) * (fb - pb) AS along, (fr - pr) * (fr - pr) + (fg - pg) * (fg - pg) + (fb - pb) * (fb - pb) AS size FROM away WHERE t = 1)
SELECT rgb, c1::INT AS c1, c2::INT AS c2, CASE WHEN v * 4 * size::BIGINT < greatest(0, along)::BIGINT * 200 THEN c2 ELSE c1 END::INT AS idx FROM spans JOIN bayer ON nth = rgb % 64""")
def _(spark, d):
    colors = nearest.palette_array(palette_np())
    at = _near(spark, d)
    mirrored = [C.far_probe(F.col(c), F.col(f"c1.{c}")) for c in "rgb"]
    at = at.withColumn("far", nearest.nearest_rgb(colors, *mirrored)).withColumn("c2", F.get(colors, F.col("far")))
    mask = F.get(F.array(*(F.lit(int(v)) for v in C.bayer8().ravel())), F.col("rgb") % 64) * 4
    err, span = [F.col(c) - F.col(f"c1.{c}") for c in "rgb"], [F.col(f"c2.{c}") - F.col(f"c1.{c}") for c in "rgb"]
    take = C.picks_far(mask, err, span, F.lit(200))
    return at.select("rgb", F.col("idx").alias("c1"), F.col("far").alias("c2"), F.when(take, F.col("far")).otherwise(F.col("idx")).alias("idx"))


# Filters.

SIGNAL = """ranked AS (SELECT (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame, user_id AS x, least(floor(value), 255)::INT AS v FROM events),
gaps AS (SELECT frame, x, 3 * abs(v - lag(v) OVER (PARTITION BY x ORDER BY frame)) AS gap FROM ranked),
diffs AS (SELECT frame, x, least(gap, 255)::INT AS d FROM gaps WHERE gap IS NOT NULL),
hist AS (SELECT frame, d, count(*) AS n FROM diffs WHERE (frame = 1 OR (x // 16) % 4 = 0) GROUP BY 1, 2)"""


@query("noise_histogram", f"WITH {SIGNAL} SELECT * FROM hist")
def _(spark, d):
    return filters.noise_histogram(B.event_signal(spark, d))


@query("hold_windows", f"""WITH {SIGNAL}, reach AS (SELECT frame, d, sum(n) OVER (PARTITION BY frame ORDER BY d) AS a, sum(n) OVER (PARTITION BY frame) AS t FROM hist),
qs AS (SELECT frame, min(d) FILTER (a * 2 >= t) AS p50, min(d) FILTER (a * 4 >= t * 3) AS p75 FROM reach GROUP BY frame),
own AS (SELECT frame, greatest(4, least(greatest((p50 * 5 + 1) // 2, p75), 100))::INT AS w FROM qs)
SELECT frame, w AS "window" FROM own WHERE frame = 1 UNION ALL SELECT (frame + 1)::INT, w FROM own""")
def _(spark, d):
    return filters.hold_windows(filters.noise_histogram(B.event_signal(spark, d)), 100)


HOLD_SQL = f"""WITH RECURSIVE {EVENTS},
held AS (SELECT frame, y, x, r, g, b, a, r AS hr, g AS hg, b AS hb, a AS ha, r << 7 AS mr, g << 7 AS mg, b << 7 AS mb, a << 7 AS ma FROM px WHERE frame = 0
UNION ALL
SELECT frame, y, x, r, g, b, a, CASE WHEN keep THEN hr ELSE r END, CASE WHEN keep THEN hg ELSE g END, CASE WHEN keep THEN hb ELSE b END, CASE WHEN keep THEN ha ELSE a END,
  CASE WHEN keep THEN mr + (((r << 7) - mr) >> 3) ELSE r << 7 END, CASE WHEN keep THEN mg + (((g << 7) - mg) >> 3) ELSE g << 7 END,
  CASE WHEN keep THEN mb + (((b << 7) - mb) >> 3) ELSE b << 7 END, CASE WHEN keep THEN ma + (((a << 7) - ma) >> 3) ELSE a << 7 END
FROM (SELECT n.*, h.hr, h.hg, h.hb, h.ha, h.mr, h.mg, h.mb, h.ma,
    abs(n.r - ((h.mr + 64) >> 7)) + abs(n.g - ((h.mg + 64) >> 7)) + abs(n.b - ((h.mb + 64) >> 7)) + abs(n.a - ((h.ma + 64) >> 7)) < 120
    AND abs(n.r - h.hr) + abs(n.g - h.hg) + abs(n.b - h.hb) + abs(n.a - h.ha) < 180 AS keep
  FROM held h JOIN px n ON n.frame = h.frame + 1 AND n.y = h.y AND n.x = h.x))
SELECT frame, y, x, hr::INT AS r, hg::INT AS g, hb::INT AS b, ha::INT AS a FROM held"""


@query("temporal_hold", HOLD_SQL)
def _(spark, d):
    return filters.hold_px(B.event_raster(spark, d), 120)


@query("smooth_5x5", f"""WITH {EVENTS}, offsets AS (SELECT a.dy, b.dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx)),
seen AS (SELECT p.frame, p.y, p.x, p.a, n.r AS nr, n.g AS ng, n.b AS nb FROM px p, offsets o JOIN px n ON n.frame = p.frame AND n.y = greatest(0, least(9, p.y + o.dy)) AND n.x = greatest(0, least(9, p.x + o.dx))
  WHERE abs(n.r - p.r) + abs(n.g - p.g) + abs(n.b - p.b) + abs(n.a - p.a) < 130 OR (o.dy = 0 AND o.dx = 0))
SELECT frame, y, x, ((sum(nr) + count(*) // 2) // count(*))::INT AS r, ((sum(ng) + count(*) // 2) // count(*))::INT AS g, ((sum(nb) + count(*) // 2) // count(*))::INT AS b, max(a) AS a FROM seen GROUP BY frame, y, x""")
def _(spark, d):
    return S.to_px(filters.smooth(_frames(spark, d), B.SIDE, B.SIDE, 130), B.SIDE, B.SIDE)


@query("packed_sizes", f"WITH {EVENTS} SELECT frame, count(*) AS pixels, bool_and(a >= 128) AS opaque, count(*) * CASE WHEN bool_and(a >= 128) THEN 3 ELSE 4 END AS bytes FROM px GROUP BY frame")
def _(spark, d):
    return hist.packed_sizes(B.event_raster(spark, d))


@query("pixel_distances", f"""WITH {EVENTS}, near AS (SELECT *, lag(r) OVER w AS pr, lag(g) OVER w AS pg, lag(b) OVER w AS pb, lag(a) OVER w AS pa FROM px WINDOW w AS (PARTITION BY y, x ORDER BY frame))
SELECT frame, y, x, (abs(r - pr) + abs(g - pg) + abs(b - pb))::INT AS l1_rgb, (abs(r - pr) + abs(g - pg) + abs(b - pb) + abs(a - pa))::INT AS l1_rgba FROM near WHERE pr IS NOT NULL""")
def _(spark, d):
    return delta.distances(B.event_raster(spark, d))


@query("worst_box", f"""WITH {LINES}, boxed AS (SELECT *, (r // 64)::INT AS box FROM split),
sums AS (SELECT box, sum(n)::BIGINT AS total, sum(n * r)::DOUBLE AS sr, sum(n * g)::DOUBLE AS sg, sum(n * b)::DOUBLE AS sb, sum(n * r * r)::DOUBLE AS qr, sum(n * g * g)::DOUBLE AS qg, sum(n * b * b)::DOUBLE AS qb FROM boxed GROUP BY box),
errs AS (SELECT box, total, qr - sr * sr / total AS er, qg - sg * sg / total AS eg, qb - sb * sb / total AS eb FROM sums)
SELECT box, CASE WHEN er >= eg AND er >= eb THEN 0 WHEN eg >= eb THEN 1 ELSE 2 END AS axis, total FROM errs ORDER BY greatest(er, eg, eb) DESC, box LIMIT 1""")
def _(spark, d):
    r, g, b = C.channels(F.col("rgb"))
    entries = B.line_histogram(spark, d).select("rgb", "n", r.alias("r"), g.alias("g"), b.alias("b"), F.floor(r / 64).cast("int").alias("box"))
    return palette.worst_box(palette.box_moments(entries, "box", ["r", "g", "b"]), "box", ["r", "g", "b"])


@query("streamed_histogram", f"WITH {EVENTS} SELECT (r * 65536 + g * 256 + b)::INT AS rgb, count(*) AS n FROM px WHERE a >= 128 GROUP BY 1")
def _(spark, d):
    """The running histogram after a stream of the whole table has been read."""
    from uuid import uuid4

    from chromaflow.streaming.live import running_histogram

    schema = B.table(spark, d, "events").schema
    px = B.raster_of(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))
    name = f"histogram_{uuid4().hex}"
    running_histogram(px).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


# Kernels and whole encodes: beyond SQL.


def _frames(spark, d):
    return S.to_frames(B.event_raster(spark, d))


CLIP = S.Clip(B.SIDE, B.SIDE, *FPS)


@query("synthetic_raster", """WITH px AS (SELECT i // 3072 AS frame, (i // 64) % 48 AS y, i % 64 AS x FROM range(0, 36864) t(i)), keyed AS (SELECT CASE WHEN x BETWEEN frame AND frame + 7 AND y BETWEEN frame AND frame + 7 THEN 200 * 65536 + 30 * 256 + 30 ELSE 40 * 65536 + 80 * 256 + 120 END AS rgb FROM px)
SELECT rgb::INT AS rgb, count(*) AS n FROM keyed GROUP BY 1""")
def _(spark, d):
    return hist.color_histogram(S.moving_square(spark))


@query("frame_block_histogram", f"WITH {EVENTS} SELECT (r * 65536 + g * 256 + b)::INT AS rgb, count(*) AS n FROM px WHERE a >= 128 GROUP BY 1")
def _(spark, d):
    return hist.frame_histogram(_frames(spark, d))


@query("median_cut_palette")
def _(spark, d):
    colors = palette.build_palette(hist.palette_entries(B.line_histogram(spark, d)), 16)
    return spark.createDataFrame([(i, *(int(v) for v in c)) for i, c in enumerate(colors)], "idx int, r int, g int, b int")


TRANS = len(PALETTE)
HEX = f"SELECT frame, string_agg(printf('%02X', (CASE WHEN a < 128 THEN {TRANS} ELSE idx END)::INT), '' ORDER BY y, x) AS idx FROM {{0}} GROUP BY frame"
#: Pixels with their nearest colour and its channels nr, ng, nb.
PLAIN = f"""{EVENTS}, {PALETTE_LAB}, {lut_sql('near_lut', 'px')},
plain AS (SELECT px.* EXCLUDE (idx), l.idx, p.r AS nr, p.g AS ng, p.b AS nb FROM px JOIN near_lut l ON l.r = px.r AND l.g = px.g AND l.b = px.b JOIN palette p ON p.idx = l.idx)"""
SHIFTED = f"""shifted AS (SELECT e.* EXCLUDE (r, g, b), {CLAMP.format('e.r + (v >> 2) - 8')} AS r, {CLAMP.format('e.g + (v >> 2) - 8')} AS g, {CLAMP.format('e.b + (v >> 2) - 8')} AS b,
  e.r = nr AND e.g = ng AND e.b = nb AS same FROM plain e JOIN bayer ON nth = (y % 8) * 8 + x % 8), {lut_sql('shift_lut', 'shifted')},
dithered AS (SELECT s.frame, s.y, s.x, s.a, CASE WHEN same THEN s.idx ELSE l.idx END AS idx FROM shifted s JOIN shift_lut l ON l.r = s.r AND l.g = s.g AND l.b = s.b)"""
BLUE = "blue(y, x, v) AS (VALUES " + ", ".join(f"({y}, {x}, {int(C.blue_noise()[y, x])})" for y in range(B.SIDE) for x in range(B.SIDE)) + ")"
#: The ordered choice between the nearest and the far colour; {0} is the dither strength of a pixel.
CHOSEN = f"""mirrored AS (SELECT frame, y, x, a, idx, nr, ng, nb, act, r - nr AS er, g - ng AS eg, b - nb AS eb, {CLAMP.format('r + 2 * (r - nr)')} AS r, {CLAMP.format('g + 2 * (g - ng)')} AS g, {CLAMP.format('b + 2 * (b - nb)')} AS b FROM acts),
{lut_sql('far_lut', 'mirrored')},
away AS (SELECT m.*, l.idx AS far, p.r - nr AS sr, p.g - ng AS sg, p.b - nb AS sb FROM mirrored m JOIN far_lut l ON l.r = m.r AND l.g = m.g AND l.b = m.b JOIN palette p ON p.idx = l.idx),
dithered AS (SELECT frame, y, x, a, CASE WHEN (er <> 0 OR eg <> 0 OR eb <> 0) AND v * (sr * sr + sg * sg + sb * sb)::BIGINT < greatest(0, er * sr + eg * sg + eb * sb)::BIGINT * {{0}} THEN far ELSE idx END AS idx
  FROM away JOIN blue USING (y, x) {{1}})"""
STRENGTH = "greatest(0, least(256, (16 + 64 - act) * 4))"
PLAIN_ACT = ACT.replace("FROM px WINDOW", "FROM plain WINDOW")
#: Frames are one tile here: dithered where more than a fiftieth of its pixels lie on a border that can show.
LIVE = f"""{LONG.replace('FROM px)', 'FROM plain)').replace('>= 2 AS', '>= 8 AS')},
bands AS (SELECT p.idx AS i, q.idx AS j FROM lab p, lab q WHERE sqrt((p.ll - q.ll) * (p.ll - q.ll) + (p.la - q.la) * (p.la - q.la) + (p.lb2 - q.lb2) * (p.lb2 - q.lb2)) >= 0.012 AND sqrt((p.ll - q.ll) * (p.ll - q.ll) + (p.la - q.la) * (p.la - q.la) + (p.lb2 - q.lb2) * (p.lb2 - q.lb2)) < 0.05),
sides AS (SELECT *, lag(idx) OVER h AS li, lag(long_run) OVER h AS lr, lag(idx) OVER v AS ui, lag(long_run) OVER v AS ur FROM runs WINDOW h AS (PARTITION BY frame, y ORDER BY x), v AS (PARTITION BY frame, x ORDER BY y)),
live AS (SELECT frame, sum(CASE WHEN long_run AND lr AND (idx, li) IN (SELECT (i, j) FROM bands) THEN 1 ELSE 0 END + CASE WHEN long_run AND ur AND (idx, ui) IN (SELECT (i, j) FROM bands) THEN 1 ELSE 0 END) * 50 > count(*) AS live FROM sides GROUP BY frame)"""
SQL["quantize_plain"] = f"WITH {PLAIN} {HEX.format('plain')}"
SQL["quantize_bayer"] = f"WITH {PLAIN}, {BAYER}, {SHIFTED} {HEX.format('dithered')}"
SQL["quantize_bluenoise"] = f"WITH {PLAIN}, {BLUE}, {PLAIN_ACT}, {CHOSEN.format(STRENGTH, '')} {HEX.format('dithered')}"
SQL["quantize_auto"] = f"WITH {PLAIN}, {BLUE}, {PLAIN_ACT}, {LIVE}, {CHOSEN.format(f'(CASE WHEN live THEN {STRENGTH} ELSE 0 END)', 'JOIN live USING (frame)')} {HEX.format('dithered')}"


def _sierra_sql() -> str:
    """Error diffusion as a recursion over the 100 positions of every frame: the error carried to
    the right, and by channel what the row takes from above (up) and hands down (low), with one
    place of margin on either side."""
    linear = "list_transform(range(0, 256), lambda v: " + LINEAR.format("v") + ")"
    labs = f"labs AS (SELECT list({{'l': ll, 'a': la, 'b': lb2, 'cr': r, 'cg': g, 'cb': b}} ORDER BY idx) AS p FROM lab), curve AS (SELECT {linear} AS t)"
    side, zeros, chans = B.SIDE, "list_transform(range(0, " + str(B.SIDE + 2) + "), lambda i: 0)", "rgb"
    start = ", ".join(f"0 AS carry_{c}, {zeros} AS up_{c}, {zeros} AS low_{c}" for c in chans)
    fresh = ", ".join(
        f"CASE WHEN n.x = 0 THEN 0 ELSE s.carry_{c} END AS c_{c}, CASE WHEN n.x = 0 THEN s.low_{c} ELSE s.up_{c} END AS up_{c}, CASE WHEN n.x = 0 THEN {zeros} ELSE s.low_{c} END AS low_{c}" for c in chans
    )
    want = ", ".join(f"greatest(0, least(255, {c} + c_{c} + up_{c}[x + 2])) AS w_{c}" for c in chans)
    lin = ", ".join(f"t[w_{c} + 1] AS l{c}" for c in chans)
    lms = ", ".join(f"cbrt({_sum(row, ('lr', 'lg', 'lb'))}) AS c{i}" for i, row in enumerate(C.TO_LMS))
    lab = ", ".join(f"{_sum(row, ('c0', 'c1', 'c2'))} AS {n}" for n, row in zip(("ll", "la", "lb2"), C.TO_LAB, strict=True))
    gaps = "list_transform(p, lambda q: (q.l - ll) * (q.l - ll) + (q.a - la) * (q.a - la) + (q.b - lb2) * (q.b - lb2)) AS d"
    err = ", ".join(f"CASE WHEN a < 128 THEN 0 ELSE w_{c} - p[k].c{c} END AS e_{c}" for c in chans)
    down = ", ".join(f"trunc(e_{c} / 2)::INT AS carry_{c}, up_{c}, list_transform(low_{c}, lambda v, i: v + CASE WHEN i IN (x + 1, x + 2) THEN trunc(e_{c} / 4)::INT ELSE 0 END) AS low_{c}" for c in chans)
    return f"""WITH RECURSIVE {EVENTS}, {PALETTE_LAB}, {labs},
walk AS (SELECT DISTINCT frame, -1 AS pos, 255 AS a, 0 AS idx, {start} FROM px
UNION ALL SELECT frame, pos, a, k - 1, {down} FROM (SELECT *, {err} FROM (SELECT *, list_position(d, list_min(d)) AS k FROM (SELECT *, {gaps} FROM (SELECT *, {lab} FROM (SELECT *, {lms} FROM (SELECT *, {lin} FROM (SELECT *, {want} FROM (
  SELECT n.frame, n.pos, n.x, n.r, n.g, n.b, n.a, {fresh}, labs.p, curve.t FROM walk s JOIN px n ON n.frame = s.frame AND n.pos = s.pos + 1, labs, curve))))))))),
walked AS (SELECT frame, pos // {side} AS y, pos % {side} AS x, a, idx FROM walk WHERE pos >= 0)
{HEX.format('walked')}"""


SQL["sierra_diffusion"] = _sierra_sql()


def _indexes(mode: str):
    def run(spark, d):
        frames = _frames(spark, d)
        return dither.quantize(frames, B.SIDE, B.SIDE, palette_np(), mode).select("frame", F.hex("idx").alias("idx"))

    return run


for _mode, _name in (("none", "quantize_plain"), ("bayer", "quantize_bayer"), ("bluenoise", "quantize_bluenoise"), ("auto", "quantize_auto"), ("sierra2", "sierra_diffusion")):
    QUERIES[_name] = _fresh(_indexes(_mode))


#: Greedy longest matches of a frame's 100 indexes; so few codes never fill a dictionary, and the
#: k-th of them has the width of clear + 1 + k.
LZW_SQL = f"""WITH RECURSIVE {PLAIN}, syms AS (SELECT frame, pos, printf('%02X', (CASE WHEN a < 128 THEN {TRANS} ELSE idx END)::INT) AS s FROM plain),
walk AS (SELECT frame, pos, s AS word, []::VARCHAR[] AS words, 1 AS codes FROM syms WHERE pos = 0
UNION ALL SELECT n.frame, n.pos, CASE WHEN list_contains(words, word || s) THEN word || s ELSE s END, CASE WHEN list_contains(words, word || s) THEN words ELSE list_append(words, word || s) END,
  CASE WHEN list_contains(words, word || s) THEN codes ELSE codes + 1 END FROM walk w JOIN syms n ON n.frame = w.frame AND n.pos = w.pos + 1),
bits AS (SELECT frame, 5 + list_sum(list_transform(range(0, codes + 1), lambda k: length(bin(17 + k)))) AS bits FROM walk WHERE pos = 99)
SELECT frame, ((bits + 7) // 8)::BIGINT AS bytes FROM bits"""


@query("lzw_sizes", LZW_SQL)
def _(spark, d):
    def size(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(lzw_encode(i, 4)) for i in b.column(1).to_pylist()], pa.int64())], names=["frame", "bytes"])

    idx = dither.quantize(_frames(spark, d), B.SIDE, B.SIDE, palette_np(), "none")
    return idx.select("frame", "idx").mapInArrow(size, "frame int, bytes long")


@query("lossy_lzw")
def _(spark, d):
    return plan.encode_summary(_frames(spark, d), CLIP, lossy=30, dither="none", colors=4)


@query("encode_gif")
def _(spark, d):
    return plan.encode_summary(_frames(spark, d), CLIP)
