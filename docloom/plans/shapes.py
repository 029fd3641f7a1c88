"""Queries of geometry, session and image operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import geometry as G
from docloom.operators import images as I
from docloom.operators.scans import clamp_box, first_face
from docloom.plans.derived import FRAMES, LINES, MATCHES, QUADS, spark_table
from docloom.sources.io import decode_base64, normalize_anchor_configs, results_to_json
from docloom.streaming import frames as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name. SQL sees q (quads), ln (lines), fr (frames) and mt (matches)."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE q AS ({QUADS}), ln AS ({LINES}), fr AS ({FRAMES}), mt AS ({MATCHES})" + sql
        return f

    return add


def quads(spark: SparkSession, sf_dir: str, order: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    rows = spark_table(spark, sf_dir, QUADS)
    return rows.select("frame_id", "user_id", "frame_width", "frame_height", F.array(*(G.point(F.col(f"x{k}"), F.col(f"y{k}")) for k in order)).alias("corners"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_table(spark, sf_dir, LINES).withColumn("is_horizontal", F.col("degrees").between(45, 135))
    return rows.withColumn("frame_size", F.when(F.col("is_horizontal"), F.col("frame_height")).otherwise(F.col("frame_width")))


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


def points(names: list[str], corners: str = "ordered") -> list[F.Column]:
    return [F.get(F.col(corners), k)[c].alias(f"{n}_{c}") for k, n in enumerate(names) for c in "xy"]


_RING = ["a", "b", "c", "d"]
# Corner k of a quad by a key: least key, first of equal ones.
_PTS = ", p AS (SELECT frame_id, i, x, y FROM (SELECT frame_id, unnest([{0}]) AS i, unnest([{1}]) AS x, unnest([{2}]) AS y FROM q))".format(
    "0, 1, 2, 3", ", ".join(f"x{k}" for k in (2, 0, 3, 1)), ", ".join(f"y{k}" for k in (2, 0, 3, 1))
)
_CORNERS = _PTS + ", o AS (SELECT frame_id" + "".join(f", arg_min(x, {key} * 10 + i) AS {n}_x, arg_min(y, {key} * 10 + i) AS {n}_y" for n, key in zip(_RING, ("(x + y)", "(y - x)", "(-x - y)", "(x - y)"), strict=True)) + " FROM p GROUP BY frame_id)"


@query(_CORNERS + " SELECT * FROM o")
def g1_order_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = quads(spark, sf_dir, (2, 0, 3, 1)).withColumn("ordered", G.order_corners(F.col("corners")))
    return mixed.select("frame_id", *points(_RING))


@query(_PTS + """, d AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY y, i) AS k FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY frame_id, k > 2 ORDER BY x, k) AS j FROM d)
SELECT frame_id, max(x) FILTER (WHERE k <= 2 AND j = 1) AS a_x, max(y) FILTER (WHERE k <= 2 AND j = 1) AS a_y, max(x) FILTER (WHERE k <= 2 AND j = 2) AS b_x, max(y) FILTER (WHERE k <= 2 AND j = 2) AS b_y,
max(x) FILTER (WHERE k > 2 AND j = 2) AS c_x, max(y) FILTER (WHERE k > 2 AND j = 2) AS c_y, max(x) FILTER (WHERE k > 2 AND j = 1) AS d_x, max(y) FILTER (WHERE k > 2 AND j = 1) AS d_y FROM s GROUP BY frame_id""")  # fmt: skip
def g2_order_corners_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads(spark, sf_dir, (2, 0, 3, 1)).withColumn("ordered", G.order_corners_by_rows(F.col("corners"))).select("frame_id", *points(_RING))


_side = lambda i, j: f"sqrt((x{j} - x{i}) * (x{j} - x{i}) + (y{j} - y{i}) * (y{j} - y{i}))"
_METRICS = f""", s AS (SELECT *, {_side(0, 1)} AS s1, {_side(1, 2)} AS s2, {_side(2, 3)} AS s3, {_side(3, 0)} AS s4,
  abs(x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y0 - x0 * y3) / 2 AS area FROM q),
m AS (SELECT *, greatest(s1, s3) AS w, greatest(s2, s4) AS h, s1 + s2 + s3 + s4 AS per, greatest(s1, s3) / greatest(s2, s4) AS aspect FROM s)"""


@query(_METRICS + " SELECT frame_id, round(w, 6) AS quad_width, round(h, 6) AS quad_height, area AS quad_area, round(per, 6) AS quad_perimeter, round(aspect, 6) AS aspect FROM m")
def g3_quad_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.quad_metrics(quads(spark, sf_dir)).select("frame_id", r6("quad_width"), r6("quad_height"), "quad_area", r6("quad_perimeter"), r6("aspect"))


@query(_METRICS + " SELECT frame_id FROM m WHERE area >= frame_width * frame_height * 0.05 AND aspect BETWEEN 0.3 AND 3.0")
def g4_valid_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.valid_quads(G.quad_metrics(quads(spark, sf_dir))).select("frame_id")


_cross = lambda i, j, k: f"((x{j} - x{i}) * (y{k} - y{j}) - (y{j} - y{i}) * (x{k} - x{j}))"
_TURNS = [_cross(k, (k + 1) % 4, (k + 2) % 4) for k in range(4)]
_DIAGONAL = f"{_side(0, 2)} >= 50 AND {_side(1, 3)} >= 50"
_GEOMETRY = " AND ".join([*(f"abs({t}) >= 100 AND ({t} > 0) = ({_TURNS[0]} > 0)" for t in _TURNS), "least(s1, s2, s3, s4) >= 50", _DIAGONAL])


@query(_METRICS + f" SELECT frame_id, {_GEOMETRY} AS ok FROM m")
def g5_corner_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads(spark, sf_dir).select("frame_id", G.corner_geometry_ok(F.col("corners")).alias("ok"))


_angle = lambda i, j, k, a, b: f"degrees(acos(greatest(-1.0, least(1.0, ((x{i} - x{j}) * (x{k} - x{j}) + (y{i} - y{j}) * (y{k} - y{j})) / ({a} * {b}))))) BETWEEN 45 AND 135"
_ORDERED = _CORNERS + ", q2 AS (SELECT o.frame_id, frame_width, frame_height, " + ", ".join(f"{n}_x AS x{k}, {n}_y AS y{k}" for k, n in enumerate(_RING)) + " FROM o JOIN q USING (frame_id))" + _METRICS.replace("FROM q)", "FROM q2)")


@query(
    _ORDERED + f""" SELECT frame_id, least(s1, s3) / greatest(s1, s3) >= 0.7 AND least(s2, s4) / greatest(s2, s4) >= 0.7 AND area / ((s1 + s3) / 2 * ((s2 + s4) / 2)) BETWEEN 0.8 AND 1.2
    AND per / (2 * ((s1 + s3) / 2 + (s2 + s4) / 2)) BETWEEN 0.9 AND 1.1 AND {_angle(0, 1, 2, "s1", "s2")} AND {_angle(1, 2, 3, "s2", "s3")} AND {_angle(2, 3, 0, "s3", "s4")} AND {_angle(3, 0, 1, "s4", "s1")}
    AND abs((s1 + s3) / 2 / ((s2 + s4) / 2) - 1.588) < 0.35 * 1.588 AS ok FROM m"""
)
def g6_document_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads(spark, sf_dir, (2, 0, 3, 1)).select("frame_id", G.document_geometry_ok(F.col("corners"), F.lit(1.588)).alias("ok"))


@query(_METRICS + " SELECT frame_id, greatest(x0, x1, x2, x3) <= frame_width AND greatest(y0, y1, y2, y3) <= frame_height AND area / (frame_width * frame_height) BETWEEN 0.1 AND 0.9 AND aspect BETWEEN 0.5 AND 3.0 AS ok FROM m")
def g7_rectangle_in_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads(spark, sf_dir).select("frame_id", G.rectangle_in_frame_ok(F.col("corners"), F.col("frame_width"), F.col("frame_height")).alias("ok"))


_TYPES = ", ty AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', {a}::DOUBLE)" for i, _, _, _, a in G.DOCUMENT_TYPES) + ") AS v(type_id, aspect_ratio))"


@query(_METRICS + _TYPES + """ SELECT frame_id, type_id, round(gap, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY gap, type_id) AS k FROM (SELECT frame_id, type_id, abs(aspect - aspect_ratio) AS gap FROM m, ty) WHERE gap <= 0.15) WHERE k = 1""")
def g8_match_document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.quad_metrics(quads(spark, sf_dir)).select("frame_id", F.col("aspect").alias("detected"))
    return G.match_document_type(found, G.document_types(spark)).select("frame_id", "type_id", r6("gap"))


@query(_METRICS + _TYPES + " SELECT frame_id, type_id FROM m, ty WHERE abs(aspect - aspect_ratio) < 0.25 * aspect_ratio")
def g8_all_document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.quad_metrics(quads(spark, sf_dir)).select("frame_id", F.col("aspect").alias("detected"))
    return G.match_document_type(found, G.document_types(spark), 0.25, "relative", best=False).select("frame_id", "type_id")


_REGION = _TYPES + """, rg AS (SELECT frame_id, frame_width, frame_height, a, CASE WHEN w * 0.85 / a <= h * 0.85 THEN w * 0.85 ELSE h * 0.85 * a END AS rw0, CASE WHEN w * 0.85 / a <= h * 0.85 THEN w * 0.85 / a ELSE h * 0.85 END AS rh0, w, h
  FROM (SELECT *, CAST(frame_width AS DOUBLE) AS w, CAST(frame_height AS DOUBLE) AS h, 0.2::DOUBLE + CAST(frame_id % 50 AS DOUBLE) / 10 AS a FROM q)),
reg AS (SELECT *, greatest(rw0, 200) AS region_w, greatest(rh0, 200) AS region_h FROM rg), re AS (SELECT *, (w - region_w) / 2 AS region_x, (h - region_h) / 2 AS region_y FROM reg)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.scan_region(quads(spark, sf_dir).withColumn("aspect_ratio", 0.2 + (F.col("frame_id") % 50).cast("double") / 10))


@query(_REGION + " SELECT frame_id, round(region_x, 6) AS region_x, round(region_y, 6) AS region_y, round(region_w, 6) AS region_w, round(region_h, 6) AS region_h FROM re")
def g9_scan_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select("frame_id", *(r6(f"region_{k}") for k in "xywh"))


@query(
    _REGION + """, cr AS (SELECT *, greatest(0, CAST(trunc(region_x - 100) AS INT)) AS cx, greatest(0, CAST(trunc(region_y - 100) AS INT)) AS cy FROM re),
    cw AS (SELECT *, least(frame_width - cx, CAST(trunc(region_w + 200) AS INT)) AS cw, least(frame_height - cy, CAST(trunc(region_h + 200) AS INT)) AS ch FROM cr)
    SELECT frame_id, CAST(CASE WHEN ok THEN cx ELSE 0 END AS INT) AS crop_x, CAST(CASE WHEN ok THEN cy ELSE 0 END AS INT) AS crop_y, CAST(CASE WHEN ok THEN cw ELSE frame_width END AS INT) AS crop_w, CAST(CASE WHEN ok THEN ch ELSE frame_height END AS INT) AS crop_h FROM (SELECT *, region_w > 50 AND region_h > 50 AND cw > 200 AND ch > 200 AS ok FROM cw)"""
)
def g10_crop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.crop_window(regions(spark, sf_dir)).select("frame_id", "crop_x", "crop_y", "crop_w", "crop_h")


_BOX = """, bx AS (SELECT *, least(x0, x1, x2, x3) AS bx, least(y0, y1, y2, y3) AS by_, greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3) + 1 AS bw, greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3) + 1 AS bh FROM m)"""


@query(
    _METRICS + _REGION.replace(_TYPES, "") + _BOX + """, ov AS (SELECT bx.frame_id, area, bx.frame_width AS fw, bx.frame_height AS fh, bw, bh, least(bx + bw, trunc(region_x) + trunc(region_w)) - greatest(bx, trunc(region_x)) AS ox, least(by_ + bh, trunc(region_y) + trunc(region_h)) - greatest(by_, trunc(region_y)) AS oy FROM bx JOIN re USING (frame_id))
    SELECT frame_id, round(ox * oy / (bw * bh), 6) AS overlap FROM ov WHERE ox > 0 AND oy > 0 AND ox * oy / (bw * bh) > 0.3 AND area > 0.01 * fw * fh"""
)
def g11_region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    contours = quads(spark, sf_dir).withColumnRenamed("corners", "points")
    return G.region_overlap(contours, regions(spark, sf_dir)).select("frame_id", r6("overlap"))


@query(" SELECT frame_id, " + ", ".join(f"round({c}{k} / 0.25 + {o}, 6) AS {n}_{c}" for k, n in enumerate(_RING) for c, o in (("x", 12), ("y", 34))) + " FROM q")
def g12_rescale_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads(spark, sf_dir).withColumn("ordered", G.rescale_points(F.col("corners"), 0.25, 12, 34)).select("frame_id", *points(_RING))


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's quads are the contours of one frame; vertices and solidity are given."""
    rows = quads(spark, sf_dir).select(F.col("user_id").alias("frame_id"), F.col("frame_id").alias("contour_id"), "frame_width", "frame_height", F.col("corners").alias("points"))
    return G.contour_metrics(rows).withColumns({"vertices": (2 + F.col("contour_id") % 9).cast("int"), "solidity": 0.6 + (F.col("contour_id") % 41).cast("double") / 100})


_CONTOURS = _METRICS + _BOX + """, ct AS (SELECT user_id AS frame_id, frame_id AS contour_id, frame_width * frame_height AS fa, area, per, area / (bw * bh) AS rect, bw / bh AS ba, CAST(2 + frame_id % 9 AS INT) AS v, 0.6::DOUBLE + CAST(frame_id % 41 AS DOUBLE) / 100 AS sol,
  1 - sqrt((bx + bw / 2 - frame_width / 2.0) * (bx + bw / 2 - frame_width / 2.0) + (by_ + bh / 2 - frame_height / 2.0) * (by_ + bh / 2 - frame_height / 2.0)) / sqrt(frame_width * frame_width / 4.0 + frame_height * frame_height / 4.0) AS pos FROM bx)"""


@query(_CONTOURS + " SELECT frame_id, contour_id, round(pos, 6) AS position, round(rect, 6) AS rectangularity FROM ct WHERE area / fa BETWEEN 0.05 AND 0.90 AND per >= 100 AND rect >= 0.3 AND v BETWEEN 3 AND 8")
def g13_filter_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.filter_contours(contours(spark, sf_dir)).select("frame_id", "contour_id", r6("position"), r6("rectangularity"))


def _best(score: str, ok: str) -> str:
    return _CONTOURS + f" SELECT frame_id, contour_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, contour_id) AS k FROM (SELECT *, {score} AS score FROM ct WHERE {ok}) WHERE score > 0) WHERE k = 1"


@query(_best("least(1, area / (fa * 0.3::DOUBLE)) * 0.5::DOUBLE + pos * 0.3::DOUBLE + sol * 0.2::DOUBLE", "true"))
def g14_best_contour_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.best_contour(contours(spark, sf_dir), "position").select("frame_id", "contour_id", r6("score"))


@query(_best("least(1, area / (fa * 0.5::DOUBLE)) * 0.3::DOUBLE + sol * 0.25::DOUBLE + rect * 0.2::DOUBLE + CASE WHEN v = 4 THEN 1.0::DOUBLE WHEN v BETWEEN 3 AND 6 THEN 0.8::DOUBLE - abs(v - 4) * 0.1::DOUBLE ELSE 0.3::DOUBLE END * 0.15::DOUBLE + pos * 0.1::DOUBLE", "per >= 200 AND ba BETWEEN 0.3 AND 3.5 AND rect > 0.5 AND sol > 0.75"))
def g14_best_contour_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.best_contour(contours(spark, sf_dir), "composite").select("frame_id", "contour_id", r6("score"))


@query(_best("area / fa * 0.5::DOUBLE + sol * 0.3::DOUBLE + greatest(0, 1 - (per * per / area - 16) / 100) * 0.2::DOUBLE", "per >= 100 AND sol > 0.7 AND area / fa > 0.1"))
def g14_best_contour_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.best_contour(contours(spark, sf_dir), "complexity").select("frame_id", "contour_id", r6("score"))


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's quads as outlines of 64 points: sixteen a side, uneven, one in six with a notch, one in five with a blunt corner."""
    rows = spark_table(spark, sf_dir, QUADS)

    def at(k: int) -> F.Column:
        side, t = k // 16, float(k % 16)
        on = lambda c: F.col(f"{c}{side}") + (F.col(f"{c}{(side + 1) % 4}") - F.col(f"{c}{side}")) * t / 16
        of, deep = (6, 60.0) if 20 <= k <= 24 else (5, 45.0)
        notch = F.when(F.col("frame_id") % of == 0, deep).otherwise(0.0) if 20 <= k <= 24 or 30 <= k <= 34 else F.lit(0.0)
        return G.point(on("x") - notch, on("y") + ((F.col("frame_id") * 7 + k * 13) % 5 - 2).cast("double") / 4)

    # Written out for the 64 places: a compiled expression, where a lambda is interpreted point by point.
    rows = rows.withColumn("points", F.array(*map(at, range(64))))
    return rows.select(F.col("user_id").alias("frame_id"), F.col("frame_id").alias("contour_id"), "frame_width", "frame_height", "points")


def _outlined(tolerance: float) -> str:
    """SQL of outlines: the same folds over lists."""
    corner = lambda c, k: f"[{c}0, {c}1, {c}2, {c}3][({k}) % 4 + 1]"
    on = lambda c: f"{corner(c, 'k // 16')} + ({corner(c, 'k // 16 + 1')} - {corner(c, 'k // 16')}) * CAST(k % 16 AS DOUBLE) / 16"
    notch = "CASE WHEN q.frame_id % 6 = 0 AND k BETWEEN 20 AND 24 THEN 60.0 WHEN q.frame_id % 5 = 0 AND k BETWEEN 30 AND 34 THEN 45.0 ELSE 0 END"
    turn = lambda o, a, b: f"({a}.x - {o}.x) * ({b}.y - {o}.y) - ({a}.y - {o}.y) * ({b}.x - {o}.x)"
    chain = lambda s: f"""list_reduce([{{'h': {s}[1:0], 'i': k}} for k in range(2 * len({s}))], lambda a, b: CASE WHEN a.i > len({s}) THEN a
      WHEN len(a.h) >= 2 AND {turn("a.h[-2]", "a.h[-1]", f"{s}[a.i]")} <= 0 THEN {{'h': a.h[1:len(a.h) - 1], 'i': a.i}} ELSE {{'h': list_append(a.h, {s}[a.i]), 'i': a.i + 1}} END, {{'h': {s}[1:0], 'i': CAST(1 AS BIGINT)}}).h"""  # noqa: E731
    area = lambda p: f"abs(list_sum([{p}[i].x * {p}[i % len({p}) + 1].y - {p}[i % len({p}) + 1].x * {p}[i].y for i in range(1, len({p}) + 1)])) / 2"
    square = lambda p, q: f"({p}.x - {q}.x) * ({p}.x - {q}.x) + ({p}.y - {q}.y) * ({p}.y - {q}.y)"
    cross = "abs((q.x - p.x) * (z.y - p.y) - (q.y - p.y) * (z.x - p.x)) / nullif(sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)), 0)"
    for name, at in (("p", "c[a.st[-1].a + 1]"), ("q", "c[a.st[-1].b + 1]"), ("z", "c[k + 1]")):
        cross = cross.replace(f"{name}.", f"{at}.")
    last = "list_max([{'o': " + f"coalesce({cross}, sqrt({square('c[k + 1]', 'c[a.st[-1].a + 1]')}))" + ", 'k': -k} for k in range(a.st[-1].a + 1, a.st[-1].b)])"
    state = "{'st': %s, 'n': %s}"
    rest = "a.st[1:len(a.st) - 1]"
    cut = state % (f"list_concat({rest}, [{{'a': a.st[-1].a, 'b': -({last}).k}}, {{'a': -({last}).k, 'b': a.st[-1].b}}])", "a.n + 1")
    step = f"CASE WHEN len(a.st) = 0 THEN a WHEN a.st[-1].b - a.st[-1].a < 2 THEN {state % (rest, 'a.n')} WHEN ({last}).o > tol THEN {cut} ELSE {state % (rest, 'a.n')} END"
    return f""", ol AS (SELECT user_id AS frame_id, frame_id AS contour_id, frame_width AS fw, frame_height AS fh, [{{'x': {on("x")} - {notch}, 'y': {on("y")} + CAST((q.frame_id * 7 + k * 13) % 5 - 2 AS DOUBLE) / 4}} for k in range(64)] AS p FROM q),
    om AS (SELECT *, {area("p")} AS area, list_sum([sqrt({square("p[i]", "p[i % 64 + 1]")}) for i in range(1, 65)]) AS per, list_sort(list_distinct(p)) AS s, {{'x': list_sum([z.x for z in p]) / 64, 'y': list_sum([z.y for z in p]) / 64}} AS mid,
      list_min([z.x for z in p]) AS bx, list_min([z.y for z in p]) AS by_, list_max([z.x for z in p]) - list_min([z.x for z in p]) + 1 AS bw, list_max([z.y for z in p]) - list_min([z.y for z in p]) + 1 AS bh FROM ol),
    oh AS (SELECT *, list_reverse(s) AS r, -list_max([{{'d': {square("p[k + 1]", "mid")}, 'k': -k}} for k in range(64)]).k AS start FROM om),
    oc AS (SELECT *, {chain("s")} AS lo, {chain("r")} AS hi, list_concat(p[start + 1:], p[1:start]) AS g FROM oh),
    og AS (SELECT *, list_concat(lo[1:len(lo) - 1], hi[1:len(hi) - 1]) AS hull, list_append(g, g[1]) AS c, -list_max([{{'d': {square("g[k + 1]", "g[1]")}, 'k': -k}} for k in range(64)]).k AS far, per * {tolerance} AS tol FROM oc),
    ov AS (SELECT *, {area("hull")} AS hull_area, list_reduce([{{'st': [{{'a': far, 'b': far}}], 'n': k}} for k in range(128)], lambda a, b: {step}, {{'st': [{{'a': CAST(0 AS BIGINT), 'b': far}}, {{'a': far, 'b': CAST(64 AS BIGINT)}}], 'n': CAST(2 AS BIGINT)}}).n AS v FROM og),
    ct AS (SELECT frame_id, contour_id, fw * fh AS fa, area, per, area / (bw * bh) AS rect, bw / bh AS ba, CAST(v AS INT) AS v, area / nullif(hull_area, 0) AS sol,
      1 - sqrt((bx + bw / 2 - fw / 2.0) * (bx + bw / 2 - fw / 2.0) + (by_ + bh / 2 - fh / 2.0) * (by_ + bh / 2 - fh / 2.0)) / sqrt(fw * fw / 4.0 + fh * fh / 4.0) AS pos FROM ov)"""


@query(_outlined(0.02) + " SELECT frame_id, contour_id, v AS vertices, round(sol, 6) AS solidity FROM ct")
def g13_outline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.outline_metrics(outlines(spark, sf_dir), 0.02).select("frame_id", "contour_id", "vertices", r6("solidity"))


@query(_outlined(0.05) + " SELECT frame_id, contour_id, v AS vertices FROM ct WHERE area / fa BETWEEN 0.05 AND 0.90 AND per >= 100 AND rect >= 0.3 AND v BETWEEN 3 AND 8")
def g13_filter_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.filter_contours(G.outline_metrics(outlines(spark, sf_dir))).select("frame_id", "contour_id", "vertices")


@query(_best("least(1, area / (fa * 0.5::DOUBLE)) * 0.3::DOUBLE + sol * 0.25::DOUBLE + rect * 0.2::DOUBLE + CASE WHEN v = 4 THEN 1.0::DOUBLE WHEN v BETWEEN 3 AND 6 THEN 0.8::DOUBLE - abs(v - 4) * 0.1::DOUBLE ELSE 0.3::DOUBLE END * 0.15::DOUBLE + pos * 0.1::DOUBLE", "per >= 200 AND ba BETWEEN 0.3 AND 3.5 AND rect > 0.5 AND sol > 0.75").replace(_CONTOURS, _outlined(0.02)))
def g14_best_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.best_contour(G.outline_metrics(outlines(spark, sf_dir), 0.02), "composite").select("frame_id", "contour_id", r6("score"))


@query(
    _METRICS + """, z AS (SELECT frame_id, least(greatest(w, 200), frame_width * 2) AS w, least(greatest(h, 200), frame_height * 2) AS h, 1.588::DOUBLE AS e FROM m)
    SELECT frame_id, CAST(trunc(CASE WHEN abs(w / h - e) > 0.1 AND w / h > e THEN h * e ELSE w END) AS INT) AS out_width, CAST(trunc(CASE WHEN abs(w / h - e) > 0.1 AND w / h <= e THEN w / e ELSE h END) AS INT) AS out_height FROM z"""
)
def g19_scaled_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rectified_size(G.quad_metrics(quads(spark, sf_dir)), "scaled", F.lit(1.588)).select("frame_id", "out_width", "out_height")


@query(_CONTOURS + " SELECT frame_id, contour_id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, contour_id) AS k FROM ct) WHERE k <= 5")
def g15_top_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_contours(contours(spark, sf_dir)).select("frame_id", "contour_id", "rank")


_LINES = """, l2 AS (SELECT *, degrees BETWEEN 45 AND 135 AS hor, CASE WHEN degrees BETWEEN 45 AND 135 THEN frame_height ELSE frame_width END AS size FROM ln),
rk AS (SELECT *, row_number() OVER w AS n, first_value(rho) OVER w AS r1 FROM l2 WINDOW w AS (PARTITION BY frame_id, hor ORDER BY abs(rho), line_id)),
sel AS (SELECT * FROM (SELECT *, min(CASE WHEN abs(rho - r1) > size * 0.2 THEN n END) OVER (PARTITION BY frame_id, hor) AS n2 FROM rk) WHERE n = 1 OR n = n2)"""


@query(_LINES + " SELECT frame_id, line_id, hor AS is_horizontal, rho FROM sel")
def g16_select_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.select_lines(lines(spark, sf_dir)).select("frame_id", "line_id", "is_horizontal", "rho")


@query(
    _LINES + """, x AS (SELECT h.frame_id, h.line_id AS h_line, v.line_id AS v_line, h.rho AS hr, v.rho AS vr, cos(h.theta) AS hc, sin(h.theta) AS hs, cos(v.theta) AS vc, sin(v.theta) AS vs FROM sel h JOIN sel v ON h.frame_id = v.frame_id AND h.hor AND NOT v.hor)
    SELECT frame_id, h_line, v_line, coalesce(nullif(round((hr * vs - vr * hs) / (hc * vs - vc * hs), 4), 0), 0) AS x, coalesce(nullif(round((vr * hc - hr * vc) / (hc * vs - vc * hs), 4), 0), 0) AS y FROM x WHERE abs(hc * vs - vc * hs) >= 0.001"""
)
def g17_line_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.line_intersections(G.select_lines(lines(spark, sf_dir)))
    # A negative zero counts as zero.
    return found.select("frame_id", "h_line", "v_line", *(F.coalesce(F.nullif(F.round(c, 4), F.lit(0.0)), F.lit(0.0)).alias(c) for c in "xy"))


@query(", sk AS (SELECT frame_id, median(CASE WHEN degrees - 90 > 45 THEN degrees - 180 WHEN degrees - 90 < -45 THEN degrees ELSE degrees - 90 END) AS angle FROM ln GROUP BY frame_id) SELECT frame_id, round(angle, 6) AS angle, abs(angle) > 5 AS is_skewed FROM sk")
def g18_page_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page_skew(lines(spark, sf_dir)).select("frame_id", r6("angle"), "is_skewed")


@query(_METRICS + " SELECT frame_id, greatest(CAST(trunc(w) AS INT), 400) AS out_width, greatest(CAST(trunc(h) AS INT), 300) AS out_height FROM m")
def g19_rectified_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rectified_size(G.quad_metrics(quads(spark, sf_dir))).select("frame_id", "out_width", "out_height")


@query(
    _METRICS + """, z AS (SELECT frame_id, least(greatest(w, 100), frame_width) AS w, least(greatest(h, 100), frame_height) AS h, 1.42::DOUBLE AS e FROM m)
    SELECT frame_id, CAST(trunc(CASE WHEN abs(w / h - e) > 0.1 AND w / h > e THEN h * e ELSE w END) AS INT) AS out_width, CAST(trunc(CASE WHEN abs(w / h - e) > 0.1 AND w / h <= e THEN w / e ELSE h END) AS INT) AS out_height FROM z"""
)
def g19_clipped_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rectified_size(G.quad_metrics(quads(spark, sf_dir)), "clipped", F.lit(1.42)).select("frame_id", "out_width", "out_height")


@query(" SELECT frame_id, CAST(CAST(x1 AS BIGINT) // gcd(CAST(x1 AS BIGINT), CAST(y2 AS BIGINT)) AS STRING) || ':' || CAST(CAST(y2 AS BIGINT) // gcd(CAST(x1 AS BIGINT), CAST(y2 AS BIGINT)) AS STRING) AS ratio FROM q")
def g20_simplified_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_table(spark, sf_dir, QUADS)
    return rows.select("frame_id", G.simplified_ratio(F.col("x1"), F.col("y2")).alias("ratio"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_table(spark, sf_dir, FRAMES)


def _fold(columns: str, start: str, step: str, out: str) -> str:
    """SQL of a fold: a recursion that takes all sessions one event further at a time. s is the event, st the state."""
    return f""", sq AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n, epoch_us(ts) AS us FROM fr),
    st(session_id, n, event_id, {columns}) AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), {start} FROM sq
    UNION ALL SELECT s.session_id, s.n, s.event_id, {step} FROM st JOIN sq s ON s.session_id = st.session_id AND s.n = st.n + 1) {out}"""


_KEEP = "(st.last_us IS NULL OR s.us - st.last_us >= 3600000000)"
_SHARP = "(s.has_quad AND s.is_valid AND NOT s.is_blurry)"
_DOWN = "greatest(0, st.c - 1)"
_SHOW = "(st.message IS NULL OR s.message <> st.message OR s.us - st.last_us > 7200000000)"


@query(_fold("last_us, kept", "CAST(NULL AS BIGINT), false", f"CASE WHEN {_KEEP} THEN s.us ELSE st.last_us END, {_KEEP}", "SELECT session_id, event_id FROM st WHERE kept"))
def t1_rate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.rate_gate(frames(spark, sf_dir), 3_600_000)


@query(
    _fold(
        "c, cap, con, clr", "0, false, false, false", f"CASE WHEN NOT {_SHARP} THEN {_DOWN} WHEN st.c + 1 >= 3 THEN 0 ELSE st.c + 1 END, {_SHARP} AND st.c + 1 >= 3, {_SHARP}, NOT s.has_quad AND {_DOWN} = 0",
        "SELECT session_id, event_id, 'capture' AS kind FROM st WHERE cap UNION ALL SELECT session_id, event_id, 'contour' FROM st WHERE con UNION ALL SELECT session_id, event_id, 'clear' FROM st WHERE clr",
    )
)
def t2_capture_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.capture_stability(frames(spark, sf_dir), needed=3)


@query(_fold("message, last_us, shown", "CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), false", f"CASE WHEN {_SHOW} THEN s.message ELSE st.message END, CASE WHEN {_SHOW} THEN s.us ELSE st.last_us END, {_SHOW}", "SELECT session_id, event_id, message FROM st WHERE shown"))
def t3_feedback_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.feedback_dedup(frames(spark, sf_dir), 7_200_000)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey 8 x 8 images from the 64 floats of each vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding IS NOT NULL AND size(embedding) = 64")
    hexed = F.transform("embedding", lambda e: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5)))), 2, "0"))
    image = F.struct(F.lit(None).cast("string").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.unhex(F.array_join(hexed, "")).alias("data"))
    return rows.select(F.col("vec_id").alias("image_id"), image.alias("image"))


_MIRROR = "CASE WHEN {0} < 0 THEN 1 WHEN {0} > 7 THEN 6 ELSE {0} END"
_at = lambda dy, dx: f"v[1 + ({_MIRROR.format(f'(i // 8 + {dy})')}) * 8 + ({_MIRROR.format(f'(i % 8 + {dx})')})]"
_TILES = f""", px AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 1) * 127.5))) AS INT)) AS v FROM embeddings),
cell AS (SELECT vec_id, v, unnest(range(64)) AS i FROM px), lap AS (SELECT vec_id, v[i + 1] AS p, {_at(-1, 0)} + {_at(1, 0)} + {_at(0, -1)} + {_at(0, 1)} - 4 * v[i + 1] AS l FROM cell),
sharp AS (SELECT vec_id AS image_id, var_pop(l) AS variance, CAST(max(least(255, greatest(0, l))) AS INT) AS max_laplacian, avg(CASE WHEN p > 200 THEN 1.0::DOUBLE ELSE 0 END) AS bright FROM lap GROUP BY vec_id)"""


# A variance over 64 whole numbers is a multiple of 1 / 4096: compared as a whole number.
@query(_TILES + " SELECT image_id, CAST(round(variance * 4096) AS BIGINT) AS variance_4096, variance < 100 AS is_blurry FROM sharp")
def i1_blur_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.blur_scores(tiles(spark, sf_dir)).select("image_id", F.round(F.col("variance") * 4096).cast("long").alias("variance_4096"), "is_blurry")


@query(_TILES + " SELECT image_id, max_laplacian, max_laplacian <= 131 AS is_blurry FROM sharp")
def i2_max_laplacian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.max_laplacian_blur(tiles(spark, sf_dir))


@query(_TILES + " SELECT image_id, round(bright, 6) AS bright, bright > 0.2 AS has_glare FROM sharp")
def i3_glare_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.glare_ratio(tiles(spark, sf_dir)).select("image_id", r6("bright"), "has_glare")


@query()
def i5_validate_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.validate_document_images(tiles(spark, sf_dir)).select("image_id", "is_valid", "reason")


@query(
    """, g AS (SELECT image_id, count(*) AS n, arg_min(mt, config_pos) AS m, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1 FROM mt GROUP BY image_id),
    e AS (SELECT image_id, n, x0, y0, x1, y1, m.x AS mx, m.y AS my, m.width AS tw, m.height AS th, m.position AS place, m.offset_x AS ox, m.offset_y AS oy, CAST(trunc(m.width / m.doc_width_ratio) AS INT) AS w, CAST(trunc(m.height / m.doc_height_ratio) AS INT) AS h FROM g),
    d AS (SELECT *, greatest(0, CAST(trunc(CASE WHEN n > 1 THEN x0 - (x1 - x0) * 0.1::DOUBLE WHEN place = 'center' THEN mx - w / 2 WHEN place = 'top-right' THEN mx - w + tw + ox ELSE mx - ox END) AS INT)) AS dx,
      greatest(0, CAST(trunc(CASE WHEN n > 1 THEN y0 - (y1 - y0) * 0.1::DOUBLE WHEN place = 'center' THEN my - h / 2 ELSE my - oy END) AS INT)) AS dy FROM e)
    SELECT image_id, dx AS x, dy AS y, CAST(least(CASE WHEN n > 1 THEN CAST(trunc(x1 - dx + (x1 - x0) * 0.1::DOUBLE) AS INT) ELSE w END, 1000 - dx) AS INT) AS width, CAST(least(CASE WHEN n > 1 THEN CAST(trunc(y1 - dy + (y1 - y0) * 0.1::DOUBLE) AS INT) ELSE h END, 800 - dy) AS INT) AS height FROM d"""
)
def i9_document_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark_table(spark, sf_dir, MATCHES)
    sizes = found.select("image_id").distinct().select("image_id", F.lit(1000).alias("width"), F.lit(800).alias("height"))
    return I.document_bounds(found, sizes)


def digest(df: DataFrame, *columns: str) -> DataFrame:
    """Images as their size and the hash of their pixels."""
    return df.select("image_id", *columns, "image.width", "image.height", F.sha2("image.data", 256).alias("pixels"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper left 4 x 4 pixels of three tiles, as anchors."""
    few = tiles(spark, sf_dir).orderBy("image_id").limit(3)
    rows = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.substr(F.hex("image.data"), (r * 16 + 1).cast("int"), F.lit(8))), "")
    patch = F.struct(F.lit(None).cast("string").alias("origin"), F.lit(4).alias("height"), F.lit(4).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.unhex(rows).alias("data"))
    pos = (F.row_number().over(Window.orderBy("image_id")) - 1).cast("int")
    out = few.select(pos.alias("config_pos"), F.concat(F.lit("a"), F.col("image_id")).alias("name"), F.when(pos == 1, "center").otherwise("top-left").alias("position"), patch.alias("image"))
    return normalize_anchor_configs(out.withColumns({"offset_x": F.lit(None).cast("double"), "offset_y": F.lit(1.0), "doc_width_ratio": F.lit(0.5), "doc_height_ratio": F.lit(0.5)}))


@query()
def i4_edge_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.edge_density(tiles(spark, sf_dir)).select("image_id", r6("density"), "is_good")


@query()
def i6_find_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.find_anchors(tiles(spark, sf_dir), anchors(spark, sf_dir), 0.7).select("image_id", "name", "x", "y", r6("confidence"))


@query()
def i7_match_all_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.match_all_methods(tiles(spark, sf_dir), anchors(spark, sf_dir)).select("image_id", "name", "method", "x", "y", F.round("value", 3).alias("value"))


@query()
def i8_find_multiple_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.find_multiple_matches(tiles(spark, sf_dir), anchors(spark, sf_dir), threshold=0.5).select("image_id", "name", "x", "y", r6("value"))


@query()
def i10_extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(I.extract_documents(tiles(spark, sf_dir), anchors(spark, sf_dir), 0.7), "status", "matches")


@query()
def i11_detect_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.detect_quads(tiles(spark, sf_dir))
    return found.select("image_id", *points(_RING, "corners"))


@query()
def i12_rectify(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Pixels and corners in one row: each tile's own inner quadrilateral, to 16 x 12.
    corners = F.array(*(G.point(F.lit(x), F.lit(y)) for x, y in ((1, 1), (6, 0), (7, 6), (0, 7))))
    return digest(I.rectify(tiles(spark, sf_dir).withColumn("corners", corners), F.lit(16), F.lit(12)))


@query()
def i13_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(I.binarize(tiles(spark, sf_dir), block=5))


@query()
def i14_orient(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = tiles(spark, sf_dir).withColumns({"rotation": (F.col("image_id") % 4 * 90).cast("int"), "mirrored": F.col("image_id") % 5 == 0})
    return digest(I.orient(turned))


@query(
    """, f AS (SELECT user_id AS image_id, event_id AS face_pos, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 101 AS DOUBLE) / 100 END AS s, CAST(event_id % 53 AS DOUBLE) / 53 AS l, CAST(event_id % 31 AS DOUBLE) / 31 AS r FROM events),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY face_pos) AS k FROM f) WHERE k = 1)
    SELECT image_id, CAST(floor(coalesce(s, 0) * 100 + 0.5) AS INT) AS smile_percent, CAST(floor(l * 100 + 0.5) AS INT) AS left_eye_percent, CAST(floor(r * 100 + 0.5) AS INT) AS right_eye_percent FROM one"""
)
def p5_first_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    share = lambda n: (F.col("event_id") % n).cast("double")
    faces = e.select(F.col("user_id").alias("image_id"), F.col("event_id").alias("face_pos"), F.when(F.col("event_id") % 7 != 0, share(101) / 100).alias("smile_prob"), (share(53) / 53).alias("left_eye_prob"), (share(31) / 31).alias("right_eye_prob"))
    return first_face(faces)


@query(", b AS (SELECT image_id, config_pos, x - 300 AS l, y - 200 AS t, x - 300 + width * 5 AS r, y - 200 + height * 5 AS bt FROM mt) SELECT image_id, config_pos, greatest(0, l) AS x, greatest(0, t) AS y, least(r - l, 640 - greatest(0, l)) AS w, least(bt - t, 480 - greatest(0, t)) AS h FROM b")
def p6_clamp_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark_table(spark, sf_dir, MATCHES)
    left, top = F.col("x") - 300, F.col("y") - 200
    boxes = m.select("image_id", "config_pos", left.alias("left"), top.alias("top"), (left + F.col("width") * 5).alias("right"), (top + F.col("height") * 5).alias("bottom"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return clamp_box(boxes).select("image_id", "config_pos", "x", "y", "w", "h")


@query(" SELECT l_orderkey AS image_id, l_linenumber, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_shipdate::DATE::STRING END AS decoded, l_partkey % 4 = 0 AS is_bad FROM lineitem")
def s4_decode_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = F.date_format("l_shipdate", "yyyy-MM-dd")
    sent = rows.withColumn("payload", F.when(F.col("l_partkey") % 4 == 0, "***").otherwise(F.concat(F.lit("data:image/png;base64,"), F.base64(text.cast("binary")))))
    return decode_base64(sent, "payload").select(F.col("l_orderkey").alias("image_id"), "l_linenumber", F.col("data").cast("string").alias("decoded"), "is_bad")


@query(", j AS (SELECT image_id, name, x, y, confidence FROM mt) SELECT image_id, name, '{\"image_id\":' || image_id || ',\"name\":\"' || name || '\",\"x\":' || x || ',\"y\":' || y || '}' AS json FROM j")
def s7_results_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark_table(spark, sf_dir, MATCHES).select("image_id", "name", "x", "y")
    found = results_to_json(m)
    return found.select(F.get_json_object("json", "$.image_id").cast("long").alias("image_id"), F.get_json_object("json", "$.name").alias("name"), "json")
