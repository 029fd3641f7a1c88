"""Jobs over image tables (image_id, image in Spark's image schema).

Pixels stay in their row: a kernel runs in each task over small Arrow batches, only numbers, boxes and the
resulting image come out, and nothing with pixels crosses a shuffle. Anchors are a few small pictures and are
sent to every task. Rows whose image couldn't be decoded (null, or height below 1) yield nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import kernels as K
from docloom.sources.io import few_rows

LOWER_IS_BETTER = ("SQDIFF", "SQDIFF_NORMED")
_IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def _each(images: DataFrame, of: Callable[[object, np.ndarray], list[tuple]], schema: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows that `of` (a row, its pixels) makes of every decoded image."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for row in frame.itertuples(index=False) for r in of(row, K.pixels(row.image))]
            yield pd.DataFrame(rows, columns=names)

    return images.where("image IS NOT NULL AND image.height > 0").select("image_id", "image", *columns).mapInPandas(run, schema)


def _packed(a: np.ndarray, origin: str | None) -> dict:
    a = a if a.ndim == 3 else a[:, :, None]
    n = a.shape[2]
    return {"origin": origin, "height": a.shape[0], "width": a.shape[1], "nChannels": n, "mode": 8 * (n - 1), "data": np.ascontiguousarray(a).tobytes()}


def sharpness(images: DataFrame) -> DataFrame:
    """image_id, variance and brightest 8-bit value of the Laplacian, share of bright pixels, mean."""

    def of(row: object, a: np.ndarray) -> list[tuple]:
        g = K.grey(a)
        lap = K.laplacian(g)
        return [(row.image_id, float(lap.var()), int(np.clip(lap, 0, 255).max()), float((g > 200).mean()), float(g.mean()))]

    return _each(images, of, "image_id long, variance double, max_laplacian int, bright double, mean double")


def blur_scores(images: DataFrame, threshold: float = 100.0) -> DataFrame:
    """image_id, variance, is_blurry (below the threshold)."""
    return sharpness(images).select("image_id", "variance", (F.col("variance") < threshold).alias("is_blurry"))


def max_laplacian_blur(images: DataFrame, limit: int = 131) -> DataFrame:
    """image_id, max_laplacian, is_blurry: no pixel of the 8-bit Laplacian is brighter than the limit."""
    return sharpness(images).select("image_id", "max_laplacian", (F.col("max_laplacian") <= limit).alias("is_blurry"))


def glare_ratio(images: DataFrame, threshold: float = 0.20) -> DataFrame:
    """image_id, bright (share of grey above 200), has_glare."""
    return sharpness(images).select("image_id", "bright", (F.col("bright") > threshold).alias("has_glare"))


def edge_density(images: DataFrame, low: float = 50, high: float = 150) -> DataFrame:
    """image_id, density (share of edge pixels), is_good (0.01 to 0.3)."""
    rows = _each(images, lambda row, a: [(row.image_id, float(K.canny(K.grey(a), low, high).mean()))], "image_id long, density double")
    return rows.withColumn("is_good", F.col("density").between(0.01, 0.3))


def edge_map(images: DataFrame, low: float = 50, high: float = 150) -> DataFrame:
    """image_id, image: edges as 255 on 0."""
    return _each(images, lambda row, a: [(row.image_id, _packed(K.canny(K.grey(a), low, high).astype(np.uint8) * 255, row.image["origin"]))], f"image_id long, image {_IMAGE}")


def validate_document_images(images: DataFrame) -> DataFrame:
    """image_id, is_valid, reason ("blurry", "aspect", "edges" or "ok"), and the whole image as bounds."""

    def of(row: object, a: np.ndarray) -> list[tuple]:
        g = K.grey(a)
        return [(row.image_id, float(K.laplacian(g).var()), float(K.canny(g).mean()), a.shape[1], a.shape[0])]

    rows = _each(images, of, "image_id long, variance double, density double, width int, height int")
    reason = F.when(F.col("variance") <= 30, "blurry").when(~(F.col("width") / F.col("height")).between(0.5, 3.0), "aspect").when(~F.col("density").between(0.01, 0.3), "edges").otherwise("ok")
    return rows.select("image_id", (reason == "ok").alias("is_valid"), reason.alias("reason"), F.lit(0).alias("x"), F.lit(0).alias("y"), "width", "height")


def _anchors(anchors: DataFrame) -> list[tuple[int, str, np.ndarray]]:
    """(position in the configuration, name, grey pixels) of anchors that were decoded: a few small pictures."""
    rows = few_rows(anchors.where("image IS NOT NULL AND image.height > 0").select("config_pos", "name", "image").orderBy("config_pos"), "anchors")
    return [(r.config_pos, r.name, K.grey(K.pixels(r.image))) for r in rows]


def _search(images: DataFrame, anchors: DataFrame, of: Callable[[dict[str, np.ndarray]], list[tuple]], extra: str) -> DataFrame:
    sent = images.sparkSession.sparkContext.broadcast(_anchors(anchors))

    def run(row: object, a: np.ndarray) -> list[tuple]:
        g, out = K.grey(a), []
        for pos, name, t in sent.value:
            if t.shape[0] <= g.shape[0] and t.shape[1] <= g.shape[1]:
                out += [(row.image_id, pos, name, t.shape[1], t.shape[0], *found) for found in of(K.responses(g, t))]
        return out

    return _each(images, run, f"image_id long, config_pos int, name string, width int, height int, {extra}")


def find_anchors(images: DataFrame, anchors: DataFrame, threshold: float = 0.7) -> DataFrame:
    """image_id, config_pos, name, width, height, x, y, confidence: each anchor's best place by normed correlation, if it reaches the threshold."""

    def of(r: dict[str, np.ndarray]) -> list[tuple]:
        m = r["CCOEFF_NORMED"]
        y, x = np.unravel_index(int(np.argmax(m)), m.shape)
        return [(int(x), int(y), float(m[y, x]))] if m[y, x] >= threshold else []

    return _search(images, anchors, of, "x int, y int, confidence double")


def match_all_methods(images: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row for each image, anchor and measure (by name): its best place, where the square differences are best at their least."""

    def of(r: dict[str, np.ndarray]) -> list[tuple]:
        out = []
        for name, m in r.items():
            y, x = np.unravel_index(int(np.argmin(m) if name in LOWER_IS_BETTER else np.argmax(m)), m.shape)
            out.append((name, int(x), int(y), float(m[y, x])))
        return out

    return _search(images, anchors, of, "method string, x int, y int, value double")


def find_multiple_matches(images: DataFrame, anchors: DataFrame, method: str = "CCOEFF_NORMED", threshold: float = 0.8) -> DataFrame:
    """Every place whose value reaches the threshold, or lies at or below it for square differences."""

    def of(r: dict[str, np.ndarray]) -> list[tuple]:
        m = r[method]
        y, x = np.nonzero(m <= threshold if method in LOWER_IS_BETTER else m >= threshold)
        return list(zip(x.tolist(), y.tolist(), m[y, x].tolist(), strict=True))

    return _search(images, anchors, of, "x int, y int, value double")


def document_bounds(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id, x, y, width, height of the document, from its matches (with their anchor's position, offsets and ratios) and the images' sizes.

    One match: extrapolated by its position in the document and its share of it. Several: their envelope with a
    margin of 10 %. Clipped to the image. The first match in configuration order counts, where there is one."""
    one = F.struct("config_pos", "x", "y", "width", "height", "position", "offset_x", "offset_y", "doc_width_ratio", "doc_height_ratio")
    g = matches.groupBy("image_id").agg(F.count("*").alias("n"), F.min(one).alias("m"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"))
    g = g.join(sizes.select("image_id", F.col("width").alias("iw"), F.col("height").alias("ih")), "image_id")
    m, whole = F.col("m"), lambda c: c.cast("int")  # cast cuts towards zero
    w, h = whole(m["width"] / m["doc_width_ratio"]), whole(m["height"] / m["doc_height_ratio"])
    place = F.lower(m["position"])
    x = F.when(place == "center", whole(m["x"] - w / 2)).when(place == "top-right", whole(m["x"] - w + m["width"] + m["offset_x"])).otherwise(whole(m["x"] - m["offset_x"]))
    y = F.when(place == "center", whole(m["y"] - h / 2)).otherwise(whole(m["y"] - m["offset_y"]))
    mx, my = (F.col("x1") - F.col("x0")) * 0.1, (F.col("y1") - F.col("y0")) * 0.1
    single = F.col("n") == 1
    g = g.withColumns({"dx": F.greatest(F.lit(0), F.when(single, x).otherwise(whole(F.col("x0") - mx))), "dy": F.greatest(F.lit(0), F.when(single, y).otherwise(whole(F.col("y0") - my)))})
    dw = F.least(F.when(single, w).otherwise(whole(F.col("x1") - F.col("dx") + mx)), F.col("iw") - F.col("dx"))
    dh = F.least(F.when(single, h).otherwise(whole(F.col("y1") - F.col("dy") + my)), F.col("ih") - F.col("dy"))
    return g.select("image_id", F.col("dx").alias("x"), F.col("dy").alias("y"), dw.alias("width"), dh.alias("height"))


def crop(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """image_id, image cut to its box (x, y, width, height); boxes without area yield nothing. Boxes grow with the images, so the join is left to the planner."""
    rows = images.select("image_id", "image").join(boxes.where("width > 0 AND height > 0"), "image_id")

    def of(row: object, a: np.ndarray) -> list[tuple]:
        return [(row.image_id, _packed(a[row.y : row.y + row.height, row.x : row.x + row.width], row.image["origin"]))]

    return _each(rows, of, f"image_id long, image {_IMAGE}", ("x", "y", "width", "height"))


def extract_documents(images: DataFrame, anchors: DataFrame, threshold: float = 0.7, perspective: bool = False) -> DataFrame:
    """image_id, status ("ok" or "no anchors"), matches, and the image of the document: cut to its bounds, or with
    `perspective` and four matches or more, warped to 800 x 1100 from the centres of the first four.

    All anchors are evaluated in the image's own row, so pixels meet no join."""
    details = ("position", "offset_x", "offset_y", "doc_width_ratio", "doc_height_ratio")
    rows = {r.config_pos: r for r in few_rows(anchors.select("config_pos", *details), "anchors")}
    sent = images.sparkSession.sparkContext.broadcast([(pos, name, t, tuple(rows[pos])[1:]) for pos, name, t in _anchors(anchors)])

    def of(row: object, a: np.ndarray) -> list[tuple]:
        g, found = K.grey(a), []
        for _, _, t, detail in sent.value:
            if t.shape[0] <= g.shape[0] and t.shape[1] <= g.shape[1]:
                m = K.responses(g, t)["CCOEFF_NORMED"]
                y, x = np.unravel_index(int(np.argmax(m)), m.shape)
                if m[y, x] >= threshold:
                    found.append((int(x), int(y), t.shape[1], t.shape[0], *detail))
        if not found:
            return [(row.image_id, "no anchors", 0, None)]
        if perspective and len(found) >= 4:
            centers = np.array([(x + w / 2, y + h / 2) for x, y, w, h, *_ in found[:4]])
            return [(row.image_id, "ok", len(found), _packed(K.warp(a, centers, 800, 1100), row.image["origin"]))]
        x, y, w, h = _bounds(found, a.shape[1], a.shape[0])
        return [(row.image_id, "ok", len(found), _packed(a[y : y + h, x : x + w], row.image["origin"]))]

    return _each(images, of, f"image_id long, status string, matches int, image {_IMAGE}")


def _bounds(found: list[tuple], iw: int, ih: int) -> tuple[int, int, int, int]:
    """document_bounds() for the matches of one image."""
    if len(found) == 1:
        x, y, tw, th, place, ox, oy, rw, rh = found[0]
        w, h, place = int(tw / rw), int(th / rh), (place or "").lower()
        dx = int(x - w / 2) if place == "center" else int(x - w + tw + ox) if place == "top-right" else int(x - ox)
        dy = int(y - h / 2) if place == "center" else int(y - oy)
        dx, dy = max(0, dx), max(0, dy)
        return dx, dy, min(w, iw - dx), min(h, ih - dy)
    x0, y0 = min(f[0] for f in found), min(f[1] for f in found)
    x1, y1 = max(f[0] + f[2] for f in found), max(f[1] + f[3] for f in found)
    dx, dy = max(0, int(x0 - (x1 - x0) * 0.1)), max(0, int(y0 - (y1 - y0) * 0.1))
    return dx, dy, min(iw - dx, int(x1 - dx + (x1 - x0) * 0.1)), min(ih - dy, int(y1 - dy + (y1 - y0) * 0.1))


def detect_quads(images: DataFrame, most_rows: int = 200) -> DataFrame:
    """image_id, corners (array<point>, in ring order from top-left, in the original image) of images in which one is found; the work is done on at most `most_rows` rows of pixels."""

    def of(row: object, a: np.ndarray) -> list[tuple]:
        step = max(1, -(-a.shape[0] // most_rows))
        quad = K.find_quad(K.grey(a)[::step, ::step])
        if quad is None:
            return []
        total, gap = quad.sum(1), quad[:, 1] - quad[:, 0]
        ring = quad[[int(np.argmin(total)), int(np.argmin(gap)), int(np.argmax(total)), int(np.argmax(gap))]] * step
        return [(row.image_id, [{"x": float(x), "y": float(y)} for x, y in ring])]

    return _each(images, of, "image_id long, corners array<struct<x:double,y:double>>")


def rectify(images: DataFrame, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """image_id, image: the quadrilateral `corners` of each row straightened, to the longer of opposite sides and at least 400 x 300 (or to given columns). Quads found in another table are joined on before, the small side sent."""
    from docloom.operators.geometry import distance

    c = F.col("corners")
    side = lambda a, b: distance(F.get(c, a), F.get(c, b))
    w = width if width is not None else F.greatest(F.greatest(side(0, 1), side(2, 3)).cast("int"), F.lit(400))
    h = height if height is not None else F.greatest(F.greatest(side(1, 2), side(3, 0)).cast("int"), F.lit(300))

    def of(row: object, a: np.ndarray) -> list[tuple]:
        corners = np.array([(p["x"], p["y"]) for p in row.corners])
        return [(row.image_id, _packed(K.warp(a, corners, row.out_width, row.out_height), row.image["origin"]))]

    return _each(images.where(F.size(c) == 4).withColumns({"out_width": w, "out_height": h}), of, f"image_id long, image {_IMAGE}", ("corners", "out_width", "out_height"))


def binarize(images: DataFrame, block: int = 11, c: float = 2) -> DataFrame:
    """image_id, image in black and white by a local threshold."""
    return _each(images, lambda row, a: [(row.image_id, _packed(K.adaptive(K.grey(a), block, c), row.image["origin"]))], f"image_id long, image {_IMAGE}")


def orient(images: DataFrame) -> DataFrame:
    """image_id, image turned clockwise by `rotation` (0, 90, 180, 270), after undoing a mirrored camera where `mirrored`."""
    return _each(images, lambda row, a: [(row.image_id, _packed(K.rotated(a, int(row.rotation or 0), bool(row.mirrored)), row.image["origin"]))], f"image_id long, image {_IMAGE}", ("rotation", "mirrored"))
