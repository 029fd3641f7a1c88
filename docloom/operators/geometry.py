"""Shapes in frames as columns: corners, quadrilaterals, contours, lines and document types.

A point is struct<x,y>, a shape array<point>. All is column work; only the six document types are joined,
and they are sent to every task.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import outlines
from docloom.functions.text import let, once

#: Known document types, sizes in millimetres.
DOCUMENT_TYPES = (
    ("aadhaar", "Aadhaar Card", 85.6, 53.98, 1.588),
    ("pan", "PAN Card", 85.6, 53.98, 1.588),
    ("passport", "Passport", 125.0, 88.0, 1.42),
    ("a4", "A4", 210.0, 297.0, 0.707),
    ("visitCard", "Visiting Card", 89.0, 51.0, 1.74),
    ("usd", "US Dollar", 156.0, 66.3, 2.35),
)

#: Types that may be one row; ratios of a fine band; bands of a part.
ROW_TYPES, BAND_TYPES, PART_BANDS = 200, 4, 1000


def document_types(spark: SparkSession) -> DataFrame:
    """id, name, width, height, aspect_ratio: six rows."""
    return spark.createDataFrame(list(DOCUMENT_TYPES), "id string, name string, width double, height double, aspect_ratio double")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(p: Column, q: Column) -> Column:
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    return F.sqrt(dx * dx + dy * dy)


def _first_by(points: Column, key: callable) -> Column:
    """The point with the least key, the first of equal ones."""
    keyed = F.transform(points, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p.alias("p")))
    return F.array_min(keyed)["p"]


def order_corners(points: Column) -> Column:
    """Top-left (least x + y), top-right (least y - x), bottom-right (greatest x + y), bottom-left (greatest y - x)."""
    return F.array(_first_by(points, lambda p: p["x"] + p["y"]), _first_by(points, lambda p: p["y"] - p["x"]), _first_by(points, lambda p: -p["x"] - p["y"]), _first_by(points, lambda p: p["x"] - p["y"]))


def order_corners_by_rows(points: Column) -> Column:
    """The two uppermost from left to right, then the two others from right to left."""
    by = lambda of: lambda a, b: F.when(of(a) < of(b), -1).when(of(a) > of(b), 1).otherwise(0)
    down = F.array_sort(points, by(lambda p: p["y"]))
    top, bottom = (F.array_sort(F.slice(down, k, 2), by(lambda p: p["x"])) for k in (1, 3))
    return F.array(F.get(top, 0), F.get(top, 1), F.get(bottom, 1), F.get(bottom, 0))


def area(points: Column) -> Column:
    """Of a polygon, by the sum of cross products."""
    n = F.size(points)
    cross = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, c: a + c)) / 2


def perimeter(points: Column) -> Column:
    n = F.size(points)
    return F.aggregate(F.transform(points, lambda p, i: distance(p, F.get(points, (i + 1) % n))), F.lit(0.0), lambda a, d: a + d)


def quad_metrics(quads: DataFrame, corners: str = "corners") -> DataFrame:
    """quads with side_1..4, quad_width, quad_height (the longer of opposite sides), quad_area, quad_perimeter, aspect; corners in ring order."""
    c = F.col(corners)
    sides = {f"side_{k + 1}": distance(F.get(c, k), F.get(c, (k + 1) % 4)) for k in range(4)}
    out = quads.withColumns(sides)
    out = out.withColumns({"quad_width": F.greatest("side_1", "side_3"), "quad_height": F.greatest("side_2", "side_4"), "quad_area": area(c), "quad_perimeter": F.col("side_1") + F.col("side_2") + F.col("side_3") + F.col("side_4")})
    return out.withColumn("aspect", F.when(F.col("quad_height") > 0, F.col("quad_width") / F.col("quad_height")))


def valid_quads(quads: DataFrame) -> DataFrame:
    """Rows with metrics whose area is at least 5 % of the frame's and whose aspect lies in 0.3..3."""
    frame = F.col("frame_width") * F.col("frame_height")
    return quads.where((F.col("quad_area") >= frame * 0.05) & F.col("aspect").between(0.3, 3.0))


def _cross(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])


def corner_geometry_ok(c: Column) -> Column:
    """Four corners that are convex, no three near a line, none within 50 of another."""
    p = [F.get(c, k) for k in range(4)]
    turns = [_cross(p[k], p[(k + 1) % 4], p[(k + 2) % 4]) for k in range(4)]
    ok = F.size(c) == 4
    for k in range(4):
        ok = ok & (F.abs(turns[k]) >= 100) & ((turns[k] > 0) == (turns[0] > 0))
        for j in range(k + 1, 4):
            ok = ok & (distance(p[k], p[j]) >= 50)
    return F.coalesce(ok, F.lit(False))


def document_geometry_ok(corners: Column, expected: Column | None = None) -> Column:
    """A near-rectangle: opposite sides alike, area and perimeter those of a rectangle of mean sides, angles 45..135 degrees, aspect within 35 % of an expected one."""

    def of_corners(c: Column) -> Column:
        p = [F.get(c, k) for k in range(4)]
        sides = F.struct(*(distance(p[k], p[(k + 1) % 4]).alias(f"s{k}") for k in range(4)))
        return let(sides, lambda sides: of_sides(c, p, [sides[f"s{k}"] for k in range(4)]))

    def of_sides(ring: Column, p: list[Column], s: list[Column]) -> Column:
        w, h = (s[0] + s[2]) / 2, (s[1] + s[3]) / 2
        ok = (F.least(s[0], s[2]) / F.greatest(s[0], s[2]) >= 0.7) & (F.least(s[1], s[3]) / F.greatest(s[1], s[3]) >= 0.7)
        ok = ok & (area(ring) / (w * h)).between(0.8, 1.2) & ((s[0] + s[1] + s[2] + s[3]) / (2 * (w + h))).between(0.9, 1.1)
        for k in range(4):
            a, b, c = p[k], p[(k + 1) % 4], p[(k + 2) % 4]
            dot = (a["x"] - b["x"]) * (c["x"] - b["x"]) + (a["y"] - b["y"]) * (c["y"] - b["y"])
            cos = dot / (s[k] * s[(k + 1) % 4])
            ok = ok & F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))).between(45, 135)
        if expected is not None:
            ok = ok & F.when(expected > 0, F.abs(w / h - expected) < 0.35 * expected).otherwise(True)
        return ok

    return F.coalesce(let(order_corners(corners), of_corners), F.lit(False))


def rectangle_in_frame_ok(c: Column, width: Column, height: Column) -> Column:
    """Corners inside the frame, area 0.1..0.9 of it, aspect of the longer opposite sides 0.5..3."""
    inside = F.forall(c, lambda p: p["x"].between(0, width) & p["y"].between(0, height))
    p = [F.get(c, k) for k in range(4)]
    w, h = F.greatest(distance(p[0], p[1]), distance(p[2], p[3])), F.greatest(distance(p[1], p[2]), distance(p[3], p[0]))
    return F.coalesce(inside & (area(c) / (width * height)).between(0.1, 0.9) & (w / h).between(0.5, 3.0), F.lit(False))


def match_document_type(quads: DataFrame, types: DataFrame, tolerance: float = 0.15, mode: str = "absolute", best: bool = True) -> DataFrame:
    """quads (with `detected`, width over height) with the types whose ratio is near: within `tolerance`, or with mode "relative" under that share of the expected ratio; a type without a ratio passes. `best`: only the nearest, the first by id among equals.

    Up to ROW_TYPES types are one row, which every quad tries inside its own row. More are gathered in bands of ratios (`banded`),
    and a quad meets those of its band alone. Either way a quad stays in its row."""
    def tried(t: Column) -> Column:
        gap = F.abs(F.col("detected") - t["aspect_ratio"])
        near = gap <= tolerance if mode == "absolute" else gap < tolerance * t["aspect_ratio"]
        return F.when(near | t["aspect_ratio"].isNull() | (t["aspect_ratio"] <= 0), F.struct(gap.alias("gap"), t["type_id"].alias("type_id"), t["aspect_ratio"].alias("aspect_ratio")))

    types = types.select(F.col("id").alias("type_id"), "aspect_ratio")
    if types.limit(ROW_TYPES + 1).count() <= ROW_TYPES:
        known = types.agg(F.collect_list(F.struct("type_id", "aspect_ratio")).alias("__types"))
        rows = quads.crossJoin(F.broadcast(known))
    else:
        rows = banded(quads, types, tolerance, mode, best)
    fits = F.array_compact(F.transform("__types", tried))
    rows = rows.withColumn("__t", F.explode(F.filter(F.array(F.array_min(fits)), lambda t: t.isNotNull()) if best else fits))
    return rows.select(*quads.columns, "__t.type_id", "__t.aspect_ratio", "__t.gap")


def banded(quads: DataFrame, types: DataFrame, tolerance: float, mode: str, best: bool) -> DataFrame:
    """quads with __types: candidates among many types, by an equi-join on a band of ratios.

    For all near types a band is as wide as the tolerance reaches (relative ones are bands of logarithms), and a type is in its own
    and both neighbours. For the best one bands are fine, a few ratios each; the nearest ratio to any value of a band is in it,
    or is the last one below it or the first one above. Types without a ratio, of which there may be ROW_TYPES, are in all."""
    plain = F.col("aspect_ratio").isNull() | (F.col("aspect_ratio") <= 0)
    open_ = types.where(plain)
    if open_.limit(ROW_TYPES + 1).count() > ROW_TYPES:
        raise ValueError(f"more than {ROW_TYPES} types without a ratio: all of them pass for every quad")
    always = open_.agg(F.collect_list(F.struct("type_id", "aspect_ratio")).alias("__open"))
    rows = types.where(~plain).groupBy("aspect_ratio").agg(F.min("type_id").alias("type_id")).select("type_id", "aspect_ratio") if best else types.where(~plain)
    if best:
        size = rows.agg(F.count("*").alias("n"), F.min("aspect_ratio").alias("low"), F.max("aspect_ratio").alias("high")).first()
        count = max(1, size.n // BAND_TYPES)
        width = ((size.high or 0.0) - (size.low or 0.0)) / count or 1.0
        # Quads beyond all ratios belong to the outer bands.
        place = lambda c: F.least(F.greatest(F.floor((c - F.lit(size.low or 0.0)) / width), F.lit(0)), F.lit(count - 1)).cast("long")
        own = rows.groupBy(place(F.col("aspect_ratio")).alias("band")).agg(F.collect_list(F.struct("type_id", "aspect_ratio")).alias("own"), F.min(F.struct("aspect_ratio", "type_id")).alias("first"), F.max(F.struct("aspect_ratio", "type_id")).alias("last"))
        every = rows.sparkSession.range(count).withColumnRenamed("id", "band").join(own, "band", "left")
        # Bands number a fraction of the types; running over them in parts keeps no part large.
        part = (F.col("band") / PART_BANDS).cast("long")
        ends = every.groupBy(part.alias("part")).agg(F.max("last").alias("last"), F.min("first").alias("first"))
        over = Window.orderBy("part")
        ends = ends.select("part", F.max("last").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__below"), F.min("first").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("__above"))
        inside = Window.partitionBy("part").orderBy("band")
        seen = every.withColumn("part", part).join(F.broadcast(ends), "part")
        below = F.coalesce(F.max("last").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("__below"))
        above = F.coalesce(F.min("first").over(inside.rowsBetween(1, Window.unboundedFollowing)), F.col("__above"))
        flip = lambda s: F.when(s.isNotNull(), F.struct(s["type_id"].alias("type_id"), s["aspect_ratio"].alias("aspect_ratio")))
        lists = seen.select("band", F.array_compact(F.concat(F.coalesce("own", F.array().cast("array<struct<type_id:string,aspect_ratio:double>>")), F.array(flip(below), flip(above)))).alias("__types"))
        rows = quads.withColumn("band", place(F.col("detected"))).join(lists, "band", "left")
    else:
        step = tolerance if mode == "absolute" else -math.log(1 - tolerance)
        value = (lambda c: c) if mode == "absolute" else F.log
        place = lambda c: F.floor(value(c) / step).cast("long")
        lists = rows.withColumn("band", F.explode(F.sequence(place(F.col("aspect_ratio")) - 1, place(F.col("aspect_ratio")) + 1))).groupBy("band").agg(F.collect_list(F.struct("type_id", "aspect_ratio")).alias("__types"))
        rows = quads.withColumn("band", place(F.col("detected"))).join(lists, "band", "left")
    none = F.array().cast("array<struct<type_id:string,aspect_ratio:double>>")
    rows = rows.crossJoin(F.broadcast(always))  # one row
    return rows.withColumn("__types", F.concat(F.coalesce("__types", none), F.coalesce("__open", none))).drop("band", "__open")


def scan_region(df: DataFrame, aspect: str = "aspect_ratio", width: str = "frame_width", height: str = "frame_height", rotation: str | None = None) -> DataFrame:
    """region_x, region_y, region_w, region_h: the largest centred box of an aspect in 85 % of the (rotated) frame, no side under 200."""
    w, h, a = F.col(width).cast("double"), F.col(height).cast("double"), F.col(aspect)
    if rotation:
        turned = F.col(rotation).isin(90, 270)
        w, h = F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)
    fits = w * 0.85 / a <= h * 0.85
    rw = F.greatest(F.when(fits, w * 0.85).otherwise(h * 0.85 * a), F.lit(200.0))
    rh = F.greatest(F.when(fits, w * 0.85 / a).otherwise(h * 0.85), F.lit(200.0))
    return df.withColumns({"region_x": (w - rw) / 2, "region_y": (h - rh) / 2, "region_w": rw, "region_h": rh})


def crop_window(df: DataFrame, padding: int = 100, least: int = 200) -> DataFrame:
    """crop_x, crop_y, crop_w, crop_h: the region with padding, inside the frame; the whole frame if the region or the crop is small."""
    x = F.greatest(F.lit(0), (F.col("region_x") - padding).cast("int"))
    y = F.greatest(F.lit(0), (F.col("region_y") - padding).cast("int"))
    w = F.least(F.col("frame_width") - x, (F.col("region_w") + 2 * padding).cast("int"))
    h = F.least(F.col("frame_height") - y, (F.col("region_h") + 2 * padding).cast("int"))
    use = (F.col("region_w") > 50) & (F.col("region_h") > 50) & (w > least) & (h > least)
    pick = lambda c, whole: F.coalesce(F.when(use, c), whole).cast("int")
    return df.withColumns({"crop_x": pick(x, F.lit(0)), "crop_y": pick(y, F.lit(0)), "crop_w": pick(w, F.col("frame_width")), "crop_h": pick(h, F.col("frame_height"))})


def bounds(points: Column) -> Column:
    """struct<x, y, w, h> of a shape's box; sides count the border pixel."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs) + 1).alias("w"), (F.array_max(ys) - F.array_min(ys) + 1).alias("h"))


def region_overlap(contours: DataFrame, regions: DataFrame) -> DataFrame:
    """contours with overlap (share of their box inside the frame's region), where it exceeds 0.3 and the area exceeds 1 % of the frame."""
    rows = contours.join(regions.select("frame_id", "region_x", "region_y", "region_w", "region_h"), "frame_id").withColumn("__b", bounds(F.col("points")))
    b = F.col("__b")
    x, y, w, h = (F.col(f"region_{k}").cast("int") for k in "xywh")
    ox = F.least(b["x"] + b["w"], x + w) - F.greatest(b["x"], x)
    oy = F.least(b["y"] + b["h"], y + h) - F.greatest(b["y"], y)
    rows = rows.withColumn("overlap", F.when((ox > 0) & (oy > 0), ox * oy / (b["w"] * b["h"])).otherwise(0.0))
    return rows.where((F.col("overlap") > 0.3) & (area(F.col("points")) > 0.01 * F.col("frame_width") * F.col("frame_height"))).drop("__b")


def rescale_points(points: Column, ratio: Column | float, offset_x: Column | float = 0.0, offset_y: Column | float = 0.0) -> Column:
    """Points of a working frame (ratio = working over original size) in the original frame."""
    r, x, y = (v if isinstance(v, Column) else F.lit(float(v)) for v in (ratio, offset_x, offset_y))
    return F.transform(points, lambda p: point(p["x"] / r + x, p["y"] / r + y))


def contour_metrics(contours: DataFrame) -> DataFrame:
    """contours with c_area, c_perimeter, c_box_area, rectangularity, box_aspect, position (1 in the frame's middle, 0 in its corner).
    Meant for few points; outlines get theirs from `outline_metrics`."""
    return _with_metrics(once(contours, "__m", _metrics())).drop("__m")


def _metrics() -> Column:
    return F.struct(bounds(F.col("points")).alias("b"), area(F.col("points")).alias("a"), perimeter(F.col("points")).alias("p"))


def _with_metrics(rows: DataFrame) -> DataFrame:
    b, w, h = F.col("__m.b"), F.col("frame_width"), F.col("frame_height")
    dx, dy = b["x"] + b["w"] / 2 - w / 2, b["y"] + b["h"] / 2 - h / 2
    rows = rows.withColumns({"c_area": F.col("__m.a"), "c_perimeter": F.col("__m.p"), "c_box_area": b["w"] * b["h"], "box_aspect": b["w"] / b["h"], "position": 1 - F.sqrt(dx * dx + dy * dy) / F.sqrt(w * w / 4 + h * h / 4)})
    return rows.withColumn("rectangularity", F.col("c_area") / F.col("c_box_area"))


def _turn(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def hull(points: Column) -> Column:
    """The convex hull of a shape by the monotone chain: each step of a fold takes the last point off the chain or puts the next one on."""

    def chain(s: Column) -> Column:
        start = F.struct(F.slice(s, 1, 0).alias("h"), F.lit(0).alias("i"))

        def step(c: Column, _: Column) -> Column:
            h, i = c["h"], c["i"]
            n = F.size(h)
            off = (n >= 2) & (_turn(F.get(h, n - 2), F.get(h, n - 1), F.get(s, i)) <= 0)
            moved = F.when(off, F.struct(F.slice(h, F.lit(1), n - 1).alias("h"), i.alias("i"))).otherwise(F.struct(F.array_append(h, F.get(s, i)).alias("h"), (i + 1).alias("i")))
            return F.when(i >= F.size(s), c).otherwise(moved)

        return F.aggregate(F.sequence(F.lit(1), F.size(s) * 2), start, step)["h"]

    def of(s: Column) -> Column:
        low, high = chain(s), let(F.reverse(s), chain)
        both = let(low, lambda a: let(high, lambda b: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(b, F.lit(1), F.size(b) - 1))))
        return F.when(F.size(s) < 3, s).otherwise(both)

    return let(F.array_sort(F.array_distinct(points)), of)


def simplified(points: Column, tolerance: Column) -> Column:
    """A closed outline cut down to points that are farther than the tolerance from the line between their neighbours (Douglas and
    Peucker). It begins at the point farthest from the middle; the stretches still to be split are a stack in the state of a fold."""

    def farthest(ring: Column, p: Column) -> Column:
        square = lambda q: (q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])
        return -F.array_max(F.transform(ring, lambda q, i: F.struct(square(q).alias("d"), (-i).alias("i"))))["i"]

    def turned(points: Column) -> Column:
        n = F.size(points)
        middle = F.struct((F.aggregate(points, F.lit(0.0), lambda a, q: a + q["x"]) / n).alias("x"), (F.aggregate(points, F.lit(0.0), lambda a, q: a + q["y"]) / n).alias("y"))
        start = let(middle, lambda m: farthest(points, m))
        return let(start, lambda k: F.concat(F.slice(points, k + 1, n), F.slice(points, F.lit(1), k)))

    def split(ring: Column, tolerance: Column) -> Column:
        n, far = F.size(ring), farthest(ring, F.get(ring, 0))
        stretch = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        at = lambda k: F.get(ring, k % n)

        def off(a: Column, b: Column) -> Column:
            """struct<o, k>: how far the farthest point between two is off their line, and minus its place."""
            def of(p: Column, q: Column, k: Column) -> Column:
                dx, dy, px, py = q["x"] - p["x"], q["y"] - p["y"], at(k)["x"] - p["x"], at(k)["y"] - p["y"]
                length = F.sqrt(dx * dx + dy * dy)
                return F.struct(F.when(length > 0, F.abs(dx * py - dy * px) / length).otherwise(F.sqrt(px * px + py * py)).alias("o"), (-k).alias("k"))

            return F.array_max(F.transform(F.sequence(a + 1, b - 1), lambda k: of(at(a), at(b), k)))

        def step(c: Column, _: Column) -> Column:
            stack, kept = c["stack"], c["kept"]
            last = F.get(stack, F.size(stack) - 1)
            rest = F.slice(stack, F.lit(1), F.size(stack) - 1)

            def cut(o: Column) -> Column:
                k = -o["k"]
                more = F.struct(F.concat(rest, F.array(stretch(last["a"], k), stretch(k, last["b"]))).alias("stack"), F.array_append(kept, k).alias("kept"))
                return F.when(o["o"] > tolerance, more).otherwise(F.struct(rest.alias("stack"), kept.alias("kept")))

            short = F.struct(rest.alias("stack"), kept.alias("kept"))
            return F.when(F.size(stack) == 0, c).when(last["b"] - last["a"] < 2, short).otherwise(let(off(last["a"], last["b"]), cut))

        def fold(far: Column) -> Column:
            start = F.struct(F.array(stretch(F.lit(0), far), stretch(far, n)).alias("stack"), F.array_distinct(F.array(F.lit(0), far)).alias("kept"))
            kept = F.aggregate(F.sequence(F.lit(1), n * 2), start, step)["kept"]
            return F.transform(F.array_sort(kept), lambda k: F.get(ring, k))

        return let(far, fold)

    cut = let(tolerance, lambda tolerance: let(let(points, turned), lambda ring: split(ring, tolerance)))
    return F.when(F.size(points) < 4, points).otherwise(cut)


def outline_metrics(contours: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Contours with metrics (those of `contour_metrics`, added where they are missing) and what their outlines tell: solidity (area
    over that of the hull) and vertices (of the outline simplified at a share of its perimeter).

    Outlines are measured in numpy, a batch at a time; the columns above, which fold one outline after the other, take those
    with coordinates that are null or not finite."""

    @F.arrow_udf(outlines.TYPE)
    def measured(points: pa.Array) -> pa.Array:
        return outlines.measured(points, tolerance)

    rows = contours.withColumn("__q", measured("points"))
    of = lambda n: F.col(f"__q.{n}")
    box = F.struct(of("left").alias("x"), of("top").alias("y"), (of("right") - of("left") + 1).alias("w"), (of("bottom") - of("top") + 1).alias("h"))
    told = F.struct(box.alias("b"), of("area").alias("a"), of("perimeter").alias("p"), of("hull").alias("hull"), of("vertices").alias("vertices"))
    odd = let(_metrics(), lambda m: F.struct(m["b"].alias("b"), m["a"].alias("a"), m["p"].alias("p"), let(hull(F.col("points")), area).alias("hull"), F.size(simplified(F.col("points"), m["p"] * tolerance)).alias("vertices")))
    rows = once(rows, "__m", F.when(F.col("__q").isNotNull(), told).otherwise(odd))
    if "c_area" not in contours.columns:
        rows = _with_metrics(rows)
    return rows.withColumns({"vertices": F.col("__m.vertices"), "solidity": F.when(F.col("__m.hull") > 0, F.col("c_area") / F.col("__m.hull"))}).drop("__m", "__q")


def filter_contours(contours: DataFrame) -> DataFrame:
    """Contours (with metrics and `vertices`, the corners of their simplified outline) that can be documents."""
    share = F.col("c_area") / (F.col("frame_width") * F.col("frame_height"))
    return contours.where(share.between(0.05, 0.90) & (F.col("c_perimeter") >= 100) & (F.col("rectangularity") >= 0.3) & F.col("vertices").between(3, 8))


def best_contour(contours: DataFrame, scheme: str = "position") -> DataFrame:
    """The best contour of each frame under a scheme; rows need metrics, `solidity` (area over hull area) and, for "composite", `vertices`. Scores above 0 only; the lowest contour_id among equals."""
    frame = F.col("frame_width") * F.col("frame_height")
    a, solid = F.col("c_area"), F.col("solidity")
    if scheme == "position":
        score, ok = F.least(F.lit(1.0), a / (frame * 0.3)) * 0.5 + F.col("position") * 0.3 + solid * 0.2, F.lit(True)
    elif scheme == "composite":
        n = F.col("vertices")
        corner = F.when(n == 4, 1.0).when(n.between(3, 6), 0.8 - F.abs(n - 4) * 0.1).otherwise(0.3)
        score = F.least(F.lit(1.0), a / (frame * 0.5)) * 0.3 + solid * 0.25 + F.col("rectangularity") * 0.2 + corner * 0.15 + F.col("position") * 0.1
        ok = (F.col("c_perimeter") >= 200) & F.col("box_aspect").between(0.3, 3.5) & (F.col("rectangularity") > 0.5) & (solid > 0.75)
    elif scheme == "complexity":
        simple = F.greatest(F.lit(0.0), 1 - (F.col("c_perimeter") * F.col("c_perimeter") / a - 16) / 100)
        score, ok = a / frame * 0.5 + solid * 0.3 + simple * 0.2, (F.col("c_perimeter") >= 100) & (solid > 0.7) & (a / frame > 0.1)
    else:
        raise ValueError(f"no scheme {scheme!r}")
    rows = contours.withColumn("score", score).where(ok & (F.col("score") > 0))
    return rows.groupBy("frame_id").agg(F.max_by(F.struct("contour_id", "score"), F.struct("score", -F.col("contour_id"))).alias("b")).select("frame_id", "b.*")


def top_contours(contours: DataFrame, k: int = 5) -> DataFrame:
    """The k contours of each frame with the largest area, the lowest contour_id first among equals."""
    order = Window.partitionBy("frame_id").orderBy(F.desc("c_area"), "contour_id")
    return contours.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def select_lines(lines: DataFrame) -> DataFrame:
    """At most two lines of each frame and direction: the one with the least |rho|, and the first behind it more than 20 % of the frame's size away. Needs is_horizontal and frame_size."""
    order = Window.partitionBy("frame_id", "is_horizontal").orderBy(F.abs("rho"), "line_id")
    ranked = lines.withColumn("__n", F.row_number().over(order)).withColumn("__first", F.first("rho").over(order))
    far = F.abs(F.col("rho") - F.col("__first")) > F.col("frame_size") * 0.2
    second = ranked.withColumn("__far", F.when(far, F.col("__n"))).withColumn("__second", F.min("__far").over(Window.partitionBy("frame_id", "is_horizontal")))
    return second.where((F.col("__n") == 1) | (F.col("__n") == F.col("__second"))).drop("__n", "__first", "__far", "__second")


def line_intersections(lines: DataFrame) -> DataFrame:
    """frame_id, h_line, v_line, x, y for every horizontal and vertical line of a frame that aren't near parallel. Lines are cut to two a direction first (select_lines), so a frame has four points at most."""
    side = lambda k: lines.where(F.col("is_horizontal") == (k == "h")).select("frame_id", F.col("line_id").alias(f"{k}_line"), F.col("rho").alias(f"{k}_rho"), F.cos("theta").alias(f"{k}_cos"), F.sin("theta").alias(f"{k}_sin"))
    both = side("h").join(side("v"), "frame_id")
    det = F.col("h_cos") * F.col("v_sin") - F.col("v_cos") * F.col("h_sin")
    both = both.withColumn("__d", det).where(F.abs("__d") >= 0.001)
    return both.select("frame_id", "h_line", "v_line", ((F.col("h_rho") * F.col("v_sin") - F.col("v_rho") * F.col("h_sin")) / F.col("__d")).alias("x"), ((F.col("v_rho") * F.col("h_cos") - F.col("h_rho") * F.col("v_cos")) / F.col("__d")).alias("y"))


def page_skew(lines: DataFrame, threshold: float = 5.0) -> DataFrame:
    """frame_id, angle (median of the lines' angles from the nearest of 0 and 90 degrees), is_skewed."""
    # A whole degree comes back from radians with an error in its last place, which would pass a limit that it only reaches.
    a = F.round(F.degrees("theta"), 9) - 90
    a = F.when(a > 45, a - 90).when(a < -45, a + 90).otherwise(a)
    return lines.groupBy("frame_id").agg(F.median(a).alias("angle")).withColumn("is_skewed", F.abs("angle") > threshold)


def rectified_size(quads: DataFrame, scheme: str = "simple", expected: Column | None = None) -> DataFrame:
    """quads (with metrics) with out_width, out_height: longer sides, at least 400 x 300 ("simple"); or clipped to 100..frame ("clipped") or 200..twice the frame ("scaled"), and corrected to an expected aspect that is more than 0.1 off."""
    w, h = F.col("quad_width"), F.col("quad_height")
    if scheme == "simple":
        return quads.withColumns({"out_width": F.greatest(w.cast("int"), F.lit(400)), "out_height": F.greatest(h.cast("int"), F.lit(300))})
    least, times = {"clipped": (100.0, 1), "scaled": (200.0, 2)}[scheme]
    rows = quads.withColumns({"__w": F.least(F.greatest(w, F.lit(least)), F.col("frame_width") * times), "__h": F.least(F.greatest(h, F.lit(least)), F.col("frame_height") * times)})
    w, h = F.col("__w"), F.col("__h")
    if expected is not None:
        off = (expected > 0) & (F.abs(w / h - expected) > 0.1)
        w, h = F.when(off & (w / h > expected), h * expected).otherwise(w), F.when(off & (w / h <= expected), w / expected).otherwise(h)
    return rows.withColumns({"out_width": w.cast("int"), "out_height": h.cast("int")}).drop("__w", "__h")


def simplified_ratio(width: Column, height: Column) -> Column:
    """width:height as whole numbers over their greatest common divisor."""
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(width.cast("long").alias("a"), height.cast("long").alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))))
    return F.concat_ws(":", (width.cast("long") / steps["a"]).cast("long").cast("string"), (height.cast("long") / steps["a"]).cast("long").cast("string"))
