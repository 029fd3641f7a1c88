"""Kernels against plain loops, and image jobs on drawn pictures."""

import numpy as np
import pytest

from docloom.functions import kernels as K
from docloom.operators import images as I
from docloom.sources import io

IMAGE = "image_id long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def packed(a):
    return I._packed(a.astype(np.uint8), "x")


def drawn():
    g = np.zeros((120, 160), np.uint8)
    g[30:90, 40:130] = 255
    return g


def noise(h=60, w=80, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.uint8)


def test_laplacian_and_otsu():
    g = noise(7, 9)
    p = np.pad(g.astype(int), 1, mode="reflect")
    want = [[p[y, x + 1] + p[y + 2, x + 1] + p[y + 1, x] + p[y + 1, x + 2] - 4 * p[y + 1, x + 1] for x in range(9)] for y in range(7)]
    assert (K.laplacian(g) == want).all()

    def within(t):
        a, b = g[g <= t].astype(float), g[g > t].astype(float)
        return sum(len(x) * x.var() for x in (a, b) if len(x))

    assert within(K.otsu(g)) == pytest.approx(min(within(t) for t in range(256)))


def test_template_measures():
    g, t = noise(14, 17, 2).astype(float), noise(4, 5, 3).astype(float)
    got = K.responses(g, t)
    for y in range(11):
        for x in range(13):
            w = g[y : y + 4, x : x + 5]
            e = np.sqrt((w * w).sum() * (t * t).sum())
            a, b = w - w.mean(), t - t.mean()
            want = {"SQDIFF": ((w - t) ** 2).sum(), "SQDIFF_NORMED": ((w - t) ** 2).sum() / e, "CCORR": (w * t).sum(), "CCORR_NORMED": (w * t).sum() / e, "CCOEFF": (a * b).sum(), "CCOEFF_NORMED": (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())}
            for k, v in want.items():
                assert got[k][y, x] == pytest.approx(v, rel=1e-6, abs=1e-4)


def test_warp_and_rotation():
    a = noise(20, 30)
    corners = np.array([[0, 0], [29, 0], [29, 19], [0, 19]], float)
    assert (K.warp(a, corners, 30, 20)[:, :, 0] == a).all()
    assert (K.rotated(a, 90) == np.rot90(a, 3)).all() and (K.rotated(a, 180) == a[::-1, ::-1]).all() and (K.rotated(a, 0, True) == np.rot90(a[:, ::-1])).all()
    assert set(np.unique(K.adaptive(a))) <= {0, 255} and (K.adaptive(np.full((9, 9), 7, np.uint8)) == 255).all()


def test_component_hull_outline():
    m = np.zeros((9, 9), bool)
    m[0, 0] = m[1, 1] = m[2, 2] = m[2, 3] = True
    m[5:8, 5:7] = True
    assert K.largest_component(m).sum() == 6 and K.largest_component(m)[5:8, 5:7].all()
    ring = K.hull(np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2], [2, 0]]))
    assert len(ring) == 4 and K.polygon_area(ring) == 16
    t = np.linspace(0, 1, 20)[:-1, None]
    square = np.concatenate([a + (b - a) * t for a, b in zip(ring, np.roll(ring, -1, 0), strict=True)])
    assert len(K.simplified(square, 0.1)) == 4


def test_quality_jobs(spark):
    rows = [(1, packed(np.full((40, 40), 100))), (2, packed(noise())), (3, packed(np.full((40, 40), 250))), (4, None), (5, packed(drawn()))]
    images = spark.createDataFrame(rows, IMAGE)
    blurry = {r.image_id: r.is_blurry for r in I.blur_scores(images).collect()}
    assert blurry == {1: True, 2: False, 3: True, 5: False}
    assert {r.image_id for r in I.glare_ratio(images).where("has_glare").collect()} == {2, 3, 5}
    assert {r.image_id: r.reason for r in I.validate_document_images(images).collect()} == {1: "blurry", 2: "edges", 3: "blurry", 5: "ok"}
    edges = K.canny(drawn())
    ys, xs = np.nonzero(edges)
    assert 200 < edges.sum() < 450 and ys.min() >= 28 and ys.max() <= 91 and xs.min() >= 38 and xs.max() <= 131


def test_quad_and_rectification(spark):
    images = spark.createDataFrame([(1, packed(drawn())), (2, packed(np.zeros((50, 50))))], IMAGE)
    quads = I.detect_quads(images)
    found = {r.image_id: [(p.x, p.y) for p in r.corners] for r in quads.collect()}
    assert found == {1: [(40, 30), (129, 30), (129, 89), (40, 89)]}
    flat = I.rectify(images.join(quads, "image_id")).collect()[0].image
    assert (flat.width, flat.height) == (400, 300) and (np.frombuffer(bytes(flat.data), np.uint8) == 255).mean() > 0.97


def test_anchors(spark):
    g = noise(90, 120, 5)
    parts = {"a": (10, 12), "b": (60, 50)}
    anchors = spark.createDataFrame(
        [(k, n, p, 0.0, 0.0, 0.25, 0.25, packed(g[y : y + 12, x : x + 16])) for k, (n, (x, y), p) in enumerate((n, xy, p) for (n, xy), p in zip(parts.items(), ("top-left", "center"), strict=True))],
        "config_pos int, name string, position string, offset_x double, offset_y double, doc_width_ratio double, doc_height_ratio double, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>",
    )
    images = spark.createDataFrame([(1, packed(g)), (2, packed(noise(50, 50, 9))), (3, packed(noise(4, 4)))], IMAGE)
    found = I.find_anchors(images, anchors, 0.9)
    assert {(r.image_id, r.name, r.x, r.y) for r in found.collect()} == {(1, n, x, y) for n, (x, y) in parts.items()}
    best = {(r.method, r.name): (r.x, r.y) for r in I.match_all_methods(images.where("image_id = 1"), anchors).collect()}
    assert all(best[m, n] == xy for m in ("SQDIFF", "SQDIFF_NORMED", "CCORR_NORMED", "CCOEFF", "CCOEFF_NORMED") for n, xy in parts.items())
    assert I.find_multiple_matches(images, anchors, "SQDIFF_NORMED", 1e-9).count() == 2
    got = {r.image_id: (r.status, r.matches, r.image and (r.image.width, r.image.height)) for r in I.extract_documents(images, anchors, 0.9).collect()}
    bounds = I.document_bounds(found.join(anchors.drop("image", "name"), "config_pos"), spark.createDataFrame([(1, 120, 90)], "image_id long, width int, height int")).collect()[0]
    assert got[1] == ("ok", 2, (bounds.width, bounds.height)) and got[2] == got[3] == ("no anchors", 0, None)


def test_read_images_and_builtin_anchors(spark, tmp_path):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    pixels = bytes([0, 10, 20, 30, 0, 40, 50, 60])  # two rows of three grey pixels, each after a filter byte
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = {r.image.origin[-5:]: r for r in io.read_images(spark, str(tmp_path)).collect()}
    assert rows["a.png"].error is None and (rows["a.png"].image.width, rows["a.png"].image.height) == (3, 2) and bytes(rows["a.png"].image.data) == bytes([10, 20, 30, 40, 50, 60])
    assert rows["b.png"].error == "IMAGE_DECODE" and io.read_images(spark, str(tmp_path), drop_bad=True).count() == 1
    image = io.read_images(spark, str(tmp_path), drop_bad=True).select("image")
    pictures = image.selectExpr("explode(array('ashoka_emblem', 'aadhaar_logo', 'other')) AS name", "image")
    got = io.builtin_anchors(pictures).orderBy("config_pos").select("name", "position", "offset_x", "offset_y", "doc_width_ratio", "doc_height_ratio").collect()
    assert [tuple(r) for r in got] == list(io.ANCHORS)
    with pytest.raises(ValueError):
        io.few_rows(spark.range(1001), "anchors")
