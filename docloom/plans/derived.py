"""Capture tables derived from the driver's tables by SQL that Spark and DuckDB both run.

`spark_table` runs a derivation on Spark; in an oracle the same text stands in a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows scan_id, block_pos, text, left_, top_, right_, bottom_ of the blocks of one scan for each order.
SCAN_BLOCKS = """
SELECT o_orderkey AS scan_id, p.pos AS block_pos,
  CASE p.pos
    WHEN 0 THEN 'Government of India'
    WHEN 1 THEN CASE o_orderkey % 8 WHEN 0 THEN 'Asha' WHEN 1 THEN 'Ravi' WHEN 2 THEN 'Meena' WHEN 3 THEN 'John' WHEN 4 THEN 'Maria' WHEN 5 THEN 'Omar' WHEN 6 THEN 'Lena' ELSE 'x1' END || ' ' ||
                CASE (o_orderkey - o_orderkey % 8) / 8 % 8 WHEN 0 THEN 'Rao' WHEN 1 THEN 'Kumar' WHEN 2 THEN 'Shah' WHEN 3 THEN 'Smith' WHEN 4 THEN 'Silva' WHEN 5 THEN 'Khan' WHEN 6 THEN 'Berg' ELSE 'Das' END
    WHEN 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'DOB: ' ELSE 'Date of Birth ' END || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING)
    WHEN 3 THEN CASE o_orderkey % 3 WHEN 0 THEN 'MALE' WHEN 1 THEN 'Sex: female' ELSE 'Transgender' END
    WHEN 4 THEN substr(CAST(o_orderkey * 7919 + 100000000000 AS STRING), 1, 4) || ' ' || substr(CAST(o_orderkey * 7919 + 100000000000 AS STRING), 5, 4) || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' ' END || substr(CAST(o_orderkey * 7919 + 100000000000 AS STRING), 9, 4)
    WHEN 5 THEN 'Aadhaar issued: ' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '.' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '.' || CAST(year(o_orderdate) AS STRING)
    ELSE 'proof of identity, not of citizenship' END AS text,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN CASE p.pos WHEN 0 THEN 200 WHEN 1 THEN 100 WHEN 2 THEN 100 WHEN 3 THEN 100 WHEN 4 THEN 150 WHEN 5 THEN 520 ELSE 60 END
            ELSE CASE p.pos WHEN 0 THEN 320 WHEN 1 THEN 180 WHEN 2 THEN 180 WHEN 3 THEN 180 WHEN 4 THEN 260 WHEN 5 THEN 10 ELSE 90 END END + o_orderkey % 40 AS DOUBLE) AS left_,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN CASE p.pos WHEN 5 THEN 40 ELSE 20 + p.pos * 60 END ELSE CASE p.pos WHEN 5 THEN 100 ELSE 40 + p.pos * 110 END END + o_orderkey % 40 AS DOUBLE) AS top_,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN CASE p.pos WHEN 0 THEN 500 WHEN 1 THEN 300 WHEN 2 THEN 320 WHEN 3 THEN 200 WHEN 4 THEN 450 WHEN 5 THEN 700 ELSE 640 END
            ELSE CASE p.pos WHEN 0 THEN 640 WHEN 1 THEN 420 WHEN 2 THEN 440 WHEN 3 THEN 300 WHEN 4 THEN 560 WHEN 5 THEN 40 ELSE 700 END END + o_orderkey % 40 AS DOUBLE) AS right_,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN CASE p.pos WHEN 5 THEN 70 ELSE 60 + p.pos * 60 END ELSE CASE p.pos WHEN 5 THEN 400 ELSE 90 + p.pos * 110 END END + o_orderkey % 40 AS DOUBLE) AS bottom_
FROM orders CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) AS p(pos)
WHERE (o_orderkey + p.pos) % 11 <> 0"""

#: One frame of a camera session for each event.
FRAMES = """
SELECT user_id AS session_id, ts, event_id, event_type IN ('view', 'click', 'error', 'purchase') AS has_quad,
  event_type IN ('view', 'click', 'error') AS is_valid, event_type = 'error' AS is_blurry, event_type AS message
FROM events"""

#: Four corners in a frame of 1920 x 1080 for each event, in mixed order.
QUADS = """
SELECT event_id AS frame_id, user_id, 1920 AS frame_width, 1080 AS frame_height,
  CAST(100 + event_id % 397 AS DOUBLE) AS x0, CAST(80 + event_id % 211 AS DOUBLE) AS y0,
  CAST(100 + event_id % 397 + 200 + event_id % 1009 AS DOUBLE) AS x1, CAST(80 + event_id % 211 + event_id % 23 AS DOUBLE) AS y1,
  CAST(100 + event_id % 397 + 190 + event_id % 1009 + event_id % 31 AS DOUBLE) AS x2, CAST(80 + event_id % 211 + 150 + event_id % 541 AS DOUBLE) AS y2,
  CAST(100 + event_id % 397 + event_id % 17 AS DOUBLE) AS x3, CAST(80 + event_id % 211 + 140 + event_id % 541 + event_id % 19 AS DOUBLE) AS y3
FROM events"""

#: A line in polar form for each event; a user is a frame.
LINES = """
SELECT user_id AS frame_id, event_id AS line_id, 1000 AS frame_width, 800 AS frame_height,
  CAST(event_id % 1000 - 200 AS DOUBLE) AS rho, CAST(event_id * 7 % 180 AS DOUBLE) * 0.017453292519943295 AS theta, CAST(event_id * 7 % 180 AS DOUBLE) AS degrees
FROM events"""

#: Matches of named anchors: an order line is a match, a thousandth of all orders an image.
MATCHES = """
SELECT l_orderkey AS image_id, CAST(l_linenumber AS INT) AS config_pos, 'a' || CAST(l_linenumber AS STRING) AS name,
  CASE l_linenumber % 4 WHEN 0 THEN 'top-left' WHEN 1 THEN 'center' WHEN 2 THEN 'top-right' ELSE 'other' END AS position,
  CAST(l_partkey % 900 AS INT) AS x, CAST(l_suppkey % 700 AS INT) AS y, CAST(40 + l_orderkey % 50 AS INT) AS width, CAST(30 + l_orderkey % 40 AS INT) AS height,
  0.1 + CAST(l_orderkey % 7 AS DOUBLE) / 20 AS doc_width_ratio, 0.1 + CAST(l_orderkey % 5 AS DOUBLE) / 20 AS doc_height_ratio,
  CAST(l_orderkey % 3 AS DOUBLE) / 10 AS offset_x, CAST(l_orderkey % 4 AS DOUBLE) / 10 AS offset_y, 0.5 + CAST(l_partkey % 50 AS DOUBLE) / 100 AS confidence
FROM lineitem WHERE l_partkey % 3 <> 0"""

SOURCES = {SCAN_BLOCKS: "orders", FRAMES: "events", QUADS: "events", LINES: "events", MATCHES: "lineitem"}

_B = lambda left, top, right, bottom: {"left": float(left), "top": float(top), "right": float(right), "bottom": float(bottom)}
_DATE = {"patterns": [r"(\d{1,2}[/.]\d{1,2}[/.]\d{4})"], "confidenceScoring": {"baseScore": 0.3, "patternMatchBonus": 0.3, "dateFormatBonus": 0.1}, "extractionStrategy": {"type": "singleCapture"}}
_NUMBER = {
    "patterns": [r"^(\d{4})\s*(\d{4})\s*(\d{4})$"], "validation": {"length": 12}, "postProcess": {"format": "XXXX XXXX XXXX"},
    "confidenceScoring": {"baseScore": 0.5, "patternMatchBonus": 0.3, "validationPassBonus": 0.2}, "extractionStrategy": {"type": "multiCapture", "combineGroups": "spaceDelimited"},
}
_GENDER = {"validation": {"allowedValues": ["Male", "Transgender"]}, "confidenceScoring": {"baseScore": 0.2, "exactMatchBonus": 0.6}, "postProcess": {"normalize": {"MALE": "M", "TRANSGENDER": "T"}, "removeSpaces": True}}
_NAME = {"patterns": ["^[A-Z][a-z]+ [A-Z][a-z]+$"], "confidenceScoring": {"baseScore": 0.2, "patternMatchBonus": 0.4, "wordCountBonus": {"2": 0.2}}, "postProcess": {"capitalizeEachWord": True, "cleanText": True}}
_RULES = {"user_dob": _DATE, "user_aadhar_no": _NUMBER, "user_gender": _GENDER, "user_full_name": _NAME}


def _template(index: int, format: str, format_id: int, blocks: list[tuple], rules: dict) -> dict:
    return {"template_index": index, "format": format, "format_id": format_id, "blocks": [{"text": k, "blockType": k, "boundingBox": _B(*b)} for k, *b in blocks], "rules": rules}


#: Three templates: a card, a printout with an upright issue date, and one with few rules.
TEMPLATES = [
    _template(0, "card", 1, [("government_name", 215, 35, 515, 75), ("user_full_name", 120, 95, 320, 135), ("user_dob", 120, 160, 330, 195), ("user_gender", 120, 215, 220, 255), ("user_aadhar_no", 170, 280, 470, 320), ("issued_on", 540, 55, 720, 85)], _RULES),
    _template(1, "printout", 2, [("government_name", 340, 55, 660, 105), ("user_full_name", 200, 165, 440, 215), ("user_dob", 200, 275, 460, 325), ("user_gender", 200, 385, 320, 435), ("user_aadhar_no", 280, 495, 580, 545), ("issued_on", 20, 120, 45, 420), ("aadhar_info", 110, 715, 720, 765)], _RULES),
    _template(2, "unknown", 0, [("user_full_name", 400, 300, 600, 350), ("user_aadhar_no", 400, 500, 600, 550)], {"user_aadhar_no": _NUMBER}),
]


#: Rows of a table that one task derives from: seven blocks come of an order, and what sorts them holds them.
TASK_ROWS = 100_000


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """A table of few partitions dealt to all cores, and to more tasks the more rows it has, since a derived row takes far longer
    than reading it and small files may hold many; one of many partitions stays as it lies. Rows are counted from the files' footers.

    With a key it is always dealt, by the key, in whole rounds of the cores (nine tasks on eight take twice as long as eight): a few bytes a row are shuffled here, and what is derived of a row, many times as
    much, needn't be shuffled again to be grouped by the key."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    if key:
        cores = df.sparkSession.sparkContext.defaultParallelism
        return df.repartition(-(-wanted // cores) * cores, key)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def spark_table(spark: SparkSession, sf_dir: str, sql: str, key: str | None = None) -> DataFrame:
    """A derivation over the driver's table that it names."""
    name = SOURCES[sql]
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key)})


def scan_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_table(spark, sf_dir, SCAN_BLOCKS, "o_orderkey").select("scan_id", "block_pos", "text", *(F.col(f"{c}_").alias(c) for c in ("left", "top", "right", "bottom")))
