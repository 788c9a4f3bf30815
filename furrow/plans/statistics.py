"""Queries of robust statistics and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import geometry
from furrow.operators import folds, statistics
from furrow.plans.base import POINTS, query

ROUND = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


@query("SELECT kind, " + ", ".join(f"round(quantile_cont(v, {p}), 6) AS p{int(p * 100)}" for p in statistics.SUMMARY) + " FROM p GROUP BY kind", p=POINTS)
def robust_quantiles(p: DataFrame) -> DataFrame:
    out = statistics.quantile_summary(p, ["kind"], "v")
    return ROUND(out, *[c for c in out.columns if c != "kind"])


@query(
    """SELECT kind, min(v) AS weighted_median FROM (SELECT *, sum(ww) OVER (PARTITION BY kind ORDER BY v, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(ww) OVER (PARTITION BY kind) AS total
FROM (SELECT *, greatest(w, 1e-6) AS ww FROM p)) WHERE run >= 0.5 * total GROUP BY kind""",
    p=POINTS,
)
def weighted_median_by_group(p: DataFrame) -> DataFrame:
    return statistics.weighted_median(p, ["kind"], "v", "w", ["id"])


@query(
    """WITH g AS (SELECT kind, v FROM p WHERE v > 0), b AS (SELECT g.* FROM g JOIN (SELECT kind, quantile_cont(v, 0.65) AS cut FROM g GROUP BY kind) c USING (kind) WHERE v <= cut),
m AS (SELECT kind, median(v) AS spacing FROM b GROUP BY kind)
SELECT kind, spacing, median(abs(v - spacing)) AS mad, round(least(greatest(1 - 1.4826 * median(abs(v - spacing)) / greatest(spacing, 1e-9), 0), 1), 6) AS confidence FROM b JOIN m USING (kind) GROUP BY kind, spacing""",
    p=POINTS,
)
def mad_spacing(p: DataFrame) -> DataFrame:
    return ROUND(statistics.robust_spacing(p, ["kind"], "v"), "confidence")


_ANGLES = """WITH a AS (SELECT g, (x * 7 % 180 + 180) % 180 AS theta, 1 / greatest(y, 1e-9) AS wt FROM p),
h AS (SELECT g, least(floor(theta / 2), 89) AS bin, round(sum(wt), 9) AS s FROM a GROUP BY ALL),
k AS (SELECT g, CAST(bin AS BIGINT) AS peak_bin, s AS peak_weight FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, bin) AS r FROM h) WHERE r = 1),
c AS (SELECT a.*, peak_bin, peak_weight FROM a JOIN k USING (g) WHERE abs(((theta - (peak_bin + 0.5) * 2 + 90) % 180 + 180) % 180 - 90) <= 8)
"""


@query(_ANGLES + "SELECT g, peak_bin, round(peak_weight, 6) AS peak_weight FROM k", p=POINTS)
def angle_histogram_peak(p: DataFrame) -> DataFrame:
    peak = statistics.axial_peak(p.withColumn("deg", F.col("x") * 7), ["g"], "deg", "y")
    return ROUND(peak, "peak_weight").select("g", "peak_bin", "peak_weight")


@query(_ANGLES + "SELECT g, round((degrees(atan2(sum(wt * sin(radians(2 * theta))), sum(wt * cos(radians(2 * theta))))) / 2 % 180 + 180) % 180, 6) AS orientation_deg FROM c GROUP BY g", p=POINTS)
def axial_mean_orientation(p: DataFrame) -> DataFrame:
    peak = statistics.axial_peak(p.withColumn("deg", F.col("x") * 7), ["g"], "deg", "y")
    return ROUND(peak, "orientation_deg").select("g", "orientation_deg")


_TARGETS = "SELECT id, g, x, y, 0.6 * x - 0.8 * y + 100 + CASE WHEN id % 97 = 0 THEN 50 ELSE w / 10 END AS tx, 0.8 * x + 0.6 * y - 40 - w / 20 AS ty FROM (" + POINTS + ") AS q"


@query(
    """WITH c AS (SELECT g, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(tx) AS mu, avg(ty) AS mv FROM p GROUP BY g),
s AS (SELECT g, n, mx, my, mu, mv, sum((x - mx) * (tx - mu) + (y - my) * (ty - mv)) / sum(pow(x - mx, 2) + pow(y - my, 2)) AS a, sum((x - mx) * (ty - mv) - (y - my) * (tx - mu)) / sum(pow(x - mx, 2) + pow(y - my, 2)) AS b
  FROM p JOIN c USING (g) GROUP BY ALL)
SELECT g, n, round(a, 6) AS a, round(b, 6) AS b, round(mu - a * mx + b * my, 5) AS shift_x, round(mv - b * mx - a * my, 5) AS shift_y, round(sqrt(a * a + b * b), 6) AS scale, round(degrees(atan2(b, a)), 5) AS rotation_deg FROM s""",
    p=_TARGETS,
)
def similarity_fit(p: DataFrame) -> DataFrame:
    fit = ROUND(statistics.similarity(p, ["g"], "x", "y", "tx", "ty"), "a", "b", "scale")
    return fit.withColumns({c: F.round(c, 5) for c in ("shift_x", "shift_y", "rotation_deg")})


@query("SELECT id, g FROM p WHERE id % 97 <> 0", p=_TARGETS)
def outlier_rejection(p: DataFrame) -> DataFrame:
    """Iterated fits reject the shifted points (one in 97), and only those."""
    return statistics.without_outliers(p, ["g"], "x", "y", "tx", "ty").select("id", "g")


@query(
    "SELECT g, round(sqrt(greatest((a + c) / 2 - r, 0) / ((a + c) / 2 + r)), 6) AS axis_ratio FROM (SELECT *, sqrt(pow((a - c) / 2, 2) + b * b) AS r FROM (SELECT g, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM p GROUP BY g))",
    p=POINTS,
)
def path_axis_ratio(p: DataFrame) -> DataFrame:
    return ROUND(statistics.axis_ratio(p, ["g"], "x", "y"), "axis_ratio")


@query(
    """WITH m AS (SELECT flight, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS a FROM p GROUP BY 1),
s AS (SELECT flight, frame_index, (x - mx) * cos(a) + (y - my) * sin(a) AS q FROM p JOIN m USING (flight)), n AS (SELECT flight, arg_max(q, frame_index) - arg_min(q, frame_index) AS net FROM s GROUP BY 1),
d AS (SELECT flight, net, sign(net) * (q - lag(q) OVER (PARTITION BY flight ORDER BY frame_index)) AS d FROM s JOIN n USING (flight))
SELECT flight, round(abs(net), 5) AS progress, count(*) FILTER (d < -0.05) AS reversals FROM d GROUP BY flight, net""",
    p="SELECT CAST(o_orderkey % 8 AS BIGINT) AS flight, CAST(floor(o_orderkey / 8) AS BIGINT) AS frame_index, CAST(o_orderkey % 8 * 2 - 7 AS DOUBLE) * floor(o_orderkey / 8) + o_orderkey * 7 % 23 AS x, CAST(o_orderkey * 13 % 17 AS DOUBLE) AS y FROM {orders}",
)
def path_progress(p: DataFrame) -> DataFrame:
    """How far each path gets along its main axis and how often it goes back."""
    return statistics.path_progress(p, ["flight"], "frame_index", "x", "y").select("flight", F.round("progress", 5).alias("progress"), "reversals")


@query("SELECT id, g, round(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 6) AS step FROM p WINDOW w AS (PARTITION BY g ORDER BY id)", p=POINTS)
def step_lengths(p: DataFrame) -> DataFrame:
    return ROUND(statistics.steps(p, ["g"], "id", "x", "y"), "step").select("id", "g", "step")


@query("SELECT g, round(sum(step), 3) AS length FROM (SELECT g, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM p WINDOW w AS (PARTITION BY g ORDER BY id)) GROUP BY g", p=POINTS)
def path_length(p: DataFrame) -> DataFrame:
    return statistics.steps(p, ["g"], "id", "x", "y").groupBy("g").agg(F.round(F.sum("step"), 3).alias("length"))


@query(
    """SELECT id, g, CASE WHEN sqrt(ax * ax + ay * ay) > 0.01 AND sqrt(bx * bx + b_y * b_y) > 0.01 THEN round((ax * bx + ay * b_y) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + b_y * b_y)), 6) END AS cosine
FROM (SELECT id, g, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, tx - lag(tx) OVER w AS bx, ty - lag(ty) OVER w AS b_y FROM p WINDOW w AS (PARTITION BY g ORDER BY id))""",
    p=_TARGETS,
)
def direction_cosine(p: DataFrame) -> DataFrame:
    return ROUND(statistics.direction_cosine(p, ["g"], "id", ("x", "y"), ("tx", "ty")), "cosine").select("id", "g", "cosine")


_PATH = "SELECT flight, frame_index, CAST(floor(frame_index / 200) AS BIGINT) AS segment, CAST(frame_index * 3 + frame_index * 7 % 11 AS DOUBLE) AS x, CAST(frame_index * 13 % 17 AS DOUBLE) AS y FROM (SELECT CAST(o_orderkey % 8 AS BIGINT) AS flight, CAST(floor(o_orderkey / 8) AS BIGINT) AS frame_index FROM {orders}) AS o"


@query(
    """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY frame_index) AS r, count(*) OVER (PARTITION BY flight) AS n FROM p),
s AS (SELECT flight, frame_index, r, n, true AS ok, segment AS ls, x AS lx, y AS ly FROM r WHERE r = 1
  UNION ALL SELECT flight, frame_index, r, n, ok, CASE WHEN ok THEN segment ELSE ls END, CASE WHEN ok THEN x ELSE lx END, CASE WHEN ok THEN y ELSE ly END
  FROM (SELECT x.*, s.ls, s.lx, s.ly, NOT (s.ls = x.segment AND sqrt(pow(x.x - s.lx, 2) + pow(x.y - s.ly, 2)) < 25) AS ok FROM s JOIN r x ON x.flight = s.flight AND x.r = s.r + 1))
SELECT flight, frame_index FROM s WHERE ok OR r = n""",
    p=_PATH,
)
def keyframe_fold(p: DataFrame) -> DataFrame:
    return folds.keyframes(p, "flight", 25.0).select("flight", "frame_index")


@query(
    """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY flight, segment ORDER BY frame_index) AS r FROM p),
s AS (SELECT flight, segment, frame_index, r, 1 + y / 1000 AS a, 0.001::DOUBLE AS b, x / 100 AS c FROM r WHERE r = 1
  UNION ALL SELECT s.flight, s.segment, x.frame_index, x.r, s.a * (1 + x.y / 1000), s.a * 0.001 + s.b, s.a * (x.x / 100) + s.b * 1 + s.c FROM s JOIN r x ON x.flight = s.flight AND x.segment = s.segment AND x.r = s.r + 1)
SELECT flight, segment, frame_index, round(a, 6) AS m0, round(b, 6) AS m1, round(c, 4) AS m2 FROM s""",
    p=_PATH,
)
def transform_chain(p: DataFrame) -> DataFrame:
    """Products of frame-to-frame transforms, anew in each segment."""
    m = F.array(1 + F.col("y") / 1000, F.lit(0.001), F.col("x") / 100, F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    out = folds.chained_transforms(p.withColumn("matrix", m), ["flight", "segment"])
    return out.select("flight", "segment", "frame_index", F.round(F.get("chain", F.lit(0)), 6).alias("m0"), F.round(F.get("chain", F.lit(1)), 6).alias("m1"), F.round(F.get("chain", F.lit(2)), 4).alias("m2"))


@query(
    """WITH RECURSIVE r AS (SELECT *, price % 7 >= 1 AS ok, row_number() OVER (PARTITION BY flight ORDER BY frame_index) AS r FROM p),
s AS (SELECT flight, frame_index, r, CASE WHEN ok THEN 0 ELSE 1 END AS seg, CASE WHEN ok THEN x ELSE 10000.0 END AS mx, CASE WHEN ok THEN y ELSE 0.0 END AS my FROM r WHERE r = 1
  UNION ALL SELECT x.flight, x.frame_index, x.r, CASE WHEN x.ok THEN s.seg ELSE s.seg + 1 END, CASE WHEN x.ok THEN s.mx + x.x ELSE (s.seg + 1) * 10000.0 END, CASE WHEN x.ok THEN s.my + x.y ELSE 0.0 END FROM s JOIN r x ON x.flight = s.flight AND x.r = s.r + 1)
SELECT flight, frame_index, CAST(seg AS BIGINT) AS segment, round(mx, 4) AS moved_x, round(my, 4) AS moved_y, round(-mx, 4) AS back_x FROM s""",
    p="SELECT CAST(o_orderkey % 8 AS BIGINT) AS flight, CAST(floor(o_orderkey / 8) AS BIGINT) AS frame_index, o_totalprice AS price, CAST(o_orderkey * 3 % 17 AS DOUBLE) AS x, CAST(o_orderkey * 13 % 19 AS DOUBLE) AS y FROM {orders}",
)
def registration_chain(p: DataFrame) -> DataFrame:
    """Shifts between frames chained over a flight, anew and set apart after each rejected one; and the way back from the map."""
    one, no = F.lit(1.0), F.lit(0.0)
    out = folds.chained_transforms(p.withColumn("matrix", F.array(one, no, F.col("x"), no, one, F.col("y"), no, no, one)).withColumn("accepted", F.col("price") % 7 >= 1), ["flight"], offset=10_000.0)
    back = geometry.inverse([F.get("chain", F.lit(i)) for i in range(9)])
    at = lambda i: F.round(F.get("chain", F.lit(i)), 4)
    return out.select("flight", "frame_index", F.col("chain_segment").alias("segment"), at(2).alias("moved_x"), at(5).alias("moved_y"), F.round(back[2], 4).alias("back_x"))


@query(
    "SELECT g, f.field, CASE f.field WHEN 'a' THEN count(a) ELSE count(b) END AS filled, round(CASE f.field WHEN 'a' THEN count(a) ELSE count(b) END / count(*), 9) AS rate FROM (SELECT g, CASE WHEN id % 3 = 0 THEN v END AS a, CASE WHEN id % 5 > 1 THEN w END AS b FROM p), (VALUES ('a'), ('b')) f(field) GROUP BY g, f.field",
    p=POINTS,
)
def unpivot_fill_rates(p: DataFrame) -> DataFrame:
    held = p.select("g", F.when(F.col("id") % 3 == 0, F.col("v")).alias("a"), F.when(F.col("id") % 5 > 1, F.col("w")).alias("b"))
    return statistics.fill_rates(held, ["g"], ["a", "b"]).withColumn("rate", F.round("rate", 9))


@query(
    """SELECT g, id, round(sum(d) OVER (PARTITION BY g ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS unwrapped FROM (
SELECT g, id, coalesce(e - 2 * pi() * floor((e + pi()) / (2 * pi())), ph) AS d FROM (SELECT g, id, ph, ph - lag(ph) OVER (PARTITION BY g ORDER BY id) AS e FROM (SELECT g, id, x / 200 - 2 AS ph FROM p)))""",
    p=POINTS,
)
def phase_unwrap(p: DataFrame) -> DataFrame:
    held = statistics.unwrapped(p.withColumn("ph", F.col("x") / 200 - 2), ["g"], "id", "ph")
    return held.select("g", "id", F.round("unwrapped", 4).alias("unwrapped"))


@query("SELECT kind, count(*) AS n FROM p GROUP BY kind", p=POINTS)
def value_counts(p: DataFrame) -> DataFrame:
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind, id, v FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id DESC) AS r FROM p) WHERE r = 1", p=POINTS)
def last_row_wins(p: DataFrame) -> DataFrame:
    from furrow.operators.selection import last_per_key

    return last_per_key(p, ["kind"], [F.desc("id")]).select("kind", "id", "v")
