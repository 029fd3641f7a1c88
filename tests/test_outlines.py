"""Outlines measured in batches against the same as columns, and skew of pages."""

import time

import numpy as np
from pyspark.sql import functions as F

from docloom.functions import outlines
from docloom.operators import geometry as G

POINTS = "array<struct<x:double,y:double>>"


def test_batches_against_columns(spark):
    """Lengths of all kinds, degenerate shapes, and what numpy leaves to the columns: empty, null and infinite."""
    rng = np.random.default_rng(3)
    shapes = [np.round(rng.uniform(0, 60, (int(n), 2)) * 4) / 4 for n in rng.integers(1, 70, 60)]
    shapes += [np.full((5, 2), 7.0), np.array([[0.0, 0], [1, 1], [2, 2], [3, 3]]), np.array([[0.0, 0], [4, 0], [8, 0], [8, 8], [4, 8], [0, 8]])]
    shapes = [[tuple(map(float, p)) for p in s] for s in shapes] + [None, [], [(1.0, 2.0), None, (3.0, 4.0), (5.0, 1.0)], [(1.0, None), (2.0, 2.0), (3.0, 0.0), (9.0, 9.0)], [(0.0, 0.0), (float("inf"), 1.0), (2.0, 2.0), (0.0, 2.0)]]
    rows = spark.createDataFrame([(k, 100, 80, s) for k, s in enumerate(shapes)], f"contour_id int, frame_width int, frame_height int, points {POINTS}")
    want = G.contour_metrics(rows).select("*", F.size(G.simplified(F.col("points"), F.col("c_perimeter") * 0.02)).alias("vertices"), G.area(G.hull(F.col("points"))).alias("hull"))
    want = want.withColumn("solidity", F.when(F.col("hull") > 0, F.col("c_area") / F.col("hull"))).drop("hull", "points")
    for given in (rows, G.contour_metrics(rows)):
        got = G.outline_metrics(given, 0.02).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_batches_are_fast():
    """Outlines of 64 points took 2.7 ms each as columns; in batches less than a fifth of it."""
    t = np.linspace(0, 2 * np.pi, 64, endpoint=False)
    rng = np.random.default_rng(4)
    x, y = (300 + r * f(t) + rng.uniform(-3, 3, (4000, 64)) for r, f in ((100, np.cos), (60, np.sin)))
    began = time.process_time()
    found = outlines.measures(x.ravel(), y.ravel(), np.full(4000, 64), 0.02)
    assert time.process_time() - began < 4000 * 0.0005
    assert (found["vertices"] >= 4).all() and (found["hull"] >= found["area"]).all()


def test_skew_at_its_limits(spark):
    """Of lines at whole degrees, five off are not skewed and 45 off keep their side, whatever radians make of them."""
    degrees = list(range(180))
    lines = spark.createDataFrame([(d, d * 0.017453292519943295) for d in degrees], "frame_id long, theta double")
    told = {r.frame_id: (r.angle, r.is_skewed) for r in G.page_skew(lines).collect()}
    for d in degrees:
        off = d - 90
        off = off - 90 if off > 45 else off + 90 if off < -45 else off
        assert told[d] == (off, abs(off) > 5), d
