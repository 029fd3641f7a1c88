"""Operators on scans: validation, walking the hierarchy, clean-up of templates, faces and boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import is_boilerplate


#: What is said of a scan, a block, a line and an element, in the order in which it is told; {0} is its place.
_TOLD = (
    ("Missing or invalid blocks array", "Missing or invalid text property"),
    *((whole, "Invalid boundingBox in {0}", "Missing or invalid cornerPoints array in {0}", "Missing or invalid text property in {0}", more) for whole, more in (
        ("Block {1} is not an object", "Missing or invalid lines array in {0}"), ("Line {2} in block {1} is not an object", "Missing or invalid elements array in {0}"), ("Element {3} in line {2} of block {1} is not an object", ""),
    )),
)
_PLACES = ("", "block {1}", "line {2} of block {1}", "element {3} of line {2} in block {1}")
_MOST_TOLD = 5


def _bad(items: pa.Array, children: str | None) -> np.ndarray:
    """Which complaints each item gives: a row for each, a column for each text of _TOLD. One that is null gives the first alone."""
    there = items.is_valid().to_numpy(zero_copy_only=False)
    missing = lambda *path: pc.struct_field(items, list(path)).is_null().to_numpy(zero_copy_only=False)
    box = np.logical_or.reduce([missing("boundingBox", side) for side in ("left", "top", "right", "bottom")])
    more = missing(children) if children else np.zeros(len(items), bool)
    return np.column_stack([~there, *(there & m for m in (box, missing("cornerPoints"), missing("text"), more))])


def complaints(blocks: pa.Array, texts: pa.Array) -> pa.Array:
    """What is wrong with each scan of a batch, in the order of its parts. Parts are numbered as one walks the hierarchy, and a
    complaint's text is made once for each place in a document."""
    n = len(blocks)
    bad = [np.column_stack([blocks.is_null().to_numpy(zero_copy_only=False), texts.is_null().to_numpy(zero_copy_only=False)])]
    firsts, parents, lists = [], [], blocks
    place, names = np.zeros(n, np.int64), [[()]]  # the index of each item's place in the names of its level
    places = [place]
    for children in ("lines", "elements", None):
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first, parent = np.append(0, np.cumsum(sizes)), np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(parent)) - first[parent]
        base = int(at.max(initial=0)) + 1
        keys, place = np.unique(places[-1][parent] * base + at, return_inverse=True)
        names.append([(*names[-1][k // base], k % base) for k in keys.tolist()])
        items = lists.flatten()
        bad.append(_bad(items, children))
        places.append(place)
        firsts.append(first)
        parents.append(parent)
        lists = pc.struct_field(items, children) if children else None
    # An item's number: the items of its own and of deeper levels before it, and its ancestors and those before them.
    numbers = []
    for level in range(4):
        number = at = np.arange(len(places[level]))
        for first in firsts[level:]:
            at = first[at]
            number = number + at
        up = np.arange(len(places[level]))
        for parent in reversed(parents[:level]):
            up = parent[up]
            number = number + up + 1
        numbers.append(number)
    offsets = np.cumsum([0, *(len(x) for x in names)]) * _MOST_TOLD
    told = np.full((sum(map(len, places)), _MOST_TOLD), -1, np.int64)
    for number, place, is_bad, offset in zip(numbers, places, bad, offsets):
        width = is_bad.shape[1]
        told[number, :width] = np.where(is_bad, offset + place[:, None] * _MOST_TOLD + np.arange(width), -1)
    used, of = np.unique(told[told >= 0], return_inverse=True)
    made = []
    for level, which in zip(np.searchsorted(offsets, used, "right") - 1, used.tolist()):
        name, slot = divmod(which - int(offsets[level]), _MOST_TOLD)
        where = ("", *names[level][name])
        made.append(_TOLD[level][slot].format(_PLACES[level].format(*where), *where[1:]))
    ends = np.append(0, np.cumsum((told >= 0).sum(axis=1)))[np.append(numbers[0], len(told))]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(made, pa.string()).take(pa.array(of)))


def validation_errors() -> Column:
    """What is wrong with a scan, in the order of its parts; null means missing. Judged in Arrow batches: lambdas would be
    interpreted for every part."""
    return F.arrow_udf(complaints, "array<string>")("blocks", "text")


def validate_scans(scans: DataFrame) -> DataFrame:
    """scans with errors (array of messages) and is_valid."""
    return scans.withColumn("errors", validation_errors()).withColumn("is_valid", F.size("errors") == 0)


def explode_blocks(scans: DataFrame) -> DataFrame:
    """scan_id, block_pos, block: blocks in order; a scan without blocks has one row of nulls."""
    return scans.select("scan_id", F.posexplode_outer("blocks").alias("block_pos", "block"))


def explode_lines(scans: DataFrame) -> DataFrame:
    return explode_blocks(scans).select("scan_id", "block_pos", F.posexplode_outer("block.lines").alias("line_pos", "line"))


def explode_elements(scans: DataFrame) -> DataFrame:
    return explode_lines(scans).select("scan_id", "block_pos", "line_pos", F.posexplode_outer("line.elements").alias("element_pos", "element"))


def normalize_templates(templates: DataFrame) -> DataFrame:
    """template_index, format, format_id, blocks, rules: nested fields fall back, then defaults.

    An empty top-level array of blocks doesn't fall back, a missing one does; an empty format and an id of 0 do."""
    return templates.select(
        "template_index",
        F.coalesce(F.nullif("format", F.lit("")), F.nullif(F.col("textRecognition.format"), F.lit("")), F.lit("unknown")).alias("format"),
        F.coalesce(F.nullif("formatId", F.lit(0)), F.nullif(F.col("textRecognition.formatId"), F.lit(0)), F.lit(0)).alias("format_id"),
        F.coalesce("blocks", "textRecognition.blocks", F.array()).alias("blocks"),
        F.col("extractionRules").alias("rules"),
    )


def drop_boilerplate_blocks(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Rows of blocks whose text has no header or advice word; null texts stay."""
    return blocks.where(~is_boilerplate(F.col(text)))


def first_face(faces: DataFrame) -> DataFrame:
    """image_id and the first face's probabilities in percent, rounded half up; a missing one is 0."""
    names = ("smile_prob", "left_eye_prob", "right_eye_prob")
    first = faces.groupBy("image_id").agg(F.min_by(F.struct(*names), "face_pos").alias("f"))
    return first.select("image_id", *(F.floor(F.coalesce(F.col(f"f.{n}"), F.lit(0.0)) * 100 + 0.5).cast("int").alias(n.replace("_prob", "_percent")) for n in names))


def clamp_box(df: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """left, top, right, bottom clipped to the image: x, y, w, h of the crop, each side at least 0."""
    x, y = F.greatest(F.lit(0), F.col("left")), F.greatest(F.lit(0), F.col("top"))
    w = F.least(F.col("right") - F.col("left"), F.col(width) - x)
    h = F.least(F.col("bottom") - F.col("top"), F.col(height) - y)
    return df.withColumns({"x": x, "y": y, "w": w, "h": h})
