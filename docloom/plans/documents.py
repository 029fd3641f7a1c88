"""Queries of text, template and identity operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import FIELDS
from docloom.operators import facts, identity, matching, scans
from docloom.plans.derived import SCAN_BLOCKS, TEMPLATES, scan_blocks
from docloom.schemas import BLOCK
from docloom.sources import folders, io
from docloom.streaming.frames import stream_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL over sb (the blocks of derived scans)."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH sb AS ({SCAN_BLOCKS})" + sql
        return f

    return add


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nest(scan_blocks(spark, sf_dir))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested scans whose blocks carry what identity cards ask of their texts."""
    return matching.nest(identity.read_blocks(scan_blocks(spark, sf_dir)))


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


_BOILER = " OR ".join(f"contains(regexp_replace(lower(text), '[^A-Za-z0-9_\\s]', '', 'g'), '{w}')" for w in ("government", "proof", "identity", "citizenship", "verification", "authentication", "scanning"))
_DATE = r"(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4})"
_FIELDS = rf"""
  regexp_extract(text, '^([A-Z][A-Za-z]{{1,14}}( [A-Z][A-Za-z]{{1,14}}){{1,3}})$', 1) AS whole_name, regexp_extract(text, '^([A-Z][A-Za-z]{{1,14}} [A-Z][A-Za-z]{{1,14}})( |$)', 1) AS lead_name,
  regexp_extract(text, '(?i)dob[:\s]*{_DATE}', 1) AS d1, regexp_extract(text, '(?i)date[^:]*birth[:\s]*{_DATE}', 1) AS d2,
  CASE WHEN contains(lower(text), 'issued') THEN '' ELSE regexp_extract(text, '\b{_DATE}\b', 1) END AS d3,
  regexp_extract(text, '(?i)\b(male|female|transgender)\b', 1) AS g, regexp_extract(text, '\b(\d{{4}}\s*\d{{4}}\s*\d{{4}})\b', 1) AS id_number"""
_OF_BLOCK = rf""", raw AS (SELECT scan_id, block_pos, text, {_FIELDS} FROM sb), fields AS (
  SELECT scan_id, block_pos, text, CASE WHEN whole_name <> '' THEN whole_name ELSE lead_name END AS name,
    CASE WHEN d1 <> '' THEN d1 WHEN d2 <> '' THEN d2 ELSE d3 END AS date_of_birth, upper(substr(g, 1, 1)) || lower(substr(g, 2)) AS gender, id_number FROM raw)"""
_IDENTITY = _OF_BLOCK + f""", ident AS (SELECT scan_id, {', '.join(f"coalesce(arg_min({n}, block_pos) FILTER (WHERE {n} <> '' AND NOT ({_BOILER})), '') AS {n}" for n in FIELDS)} FROM fields GROUP BY scan_id)"""


@query(f" SELECT scan_id, block_pos, text FROM sb WHERE NOT ({_BOILER})")
def p4_drop_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.drop_boilerplate_blocks(scan_blocks(spark, sf_dir)).select("scan_id", "block_pos", "text")


@query(_OF_BLOCK + " SELECT scan_id, block_pos, name, date_of_birth, gender, id_number FROM fields")
def x1_to_x4_block_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_blocks(spark, sf_dir).select("scan_id", "block_pos", *(F.coalesce(of(F.col("text")), F.lit("")).alias(n) for n, of in FIELDS.items()))


@query(_IDENTITY + " SELECT * FROM ident")
def x5_identity_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.extract_identity_fields(cards(spark, sf_dir))


@query(_IDENTITY + " SELECT * FROM ident")
def x5_identity_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.extract_identity_fields_flat(scan_blocks(spark, sf_dir))


# SQL twins of the rules in TEMPLATES: confidence and value of a text t for each block type.
_RE_DATE, _RE_NUMBER = r"(\d{1,2}[/.]\d{1,2}[/.]\d{4})", r"^(\d{4})\s*(\d{4})\s*(\d{4})$"
_NONE = "CASE WHEN length(t) < 2 THEN 0.1::DOUBLE WHEN length(t) > 200 THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END"
_NUM = f"least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN regexp_matches(t, '{_RE_NUMBER}') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) = 12 THEN 0.2::DOUBLE ELSE 0 END)"
_CONF = {
    "user_dob": f"least(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN regexp_matches(t, '{_RE_DATE}') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(t, '{_DATE}') THEN 0.1::DOUBLE ELSE 0 END)",
    "user_aadhar_no": _NUM,
    "user_gender": "least(1.0::DOUBLE, 0.2::DOUBLE + CASE WHEN upper(t) IN ('MALE', 'TRANSGENDER') THEN 0.6::DOUBLE ELSE 0 END)",
    "user_full_name": "least(1.0::DOUBLE, 0.2::DOUBLE + CASE WHEN regexp_matches(t, '(?i)^[A-Z][a-z]+ [A-Z][a-z]+$') THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) = 2 THEN 0.2::DOUBLE ELSE 0 END)",
}
_DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"
_TWELVE = "CASE WHEN length(" + _DIGITS.format("{0}") + ") = 12 THEN substr(" + _DIGITS.format("{0}") + ", 1, 4) || ' ' || substr(" + _DIGITS.format("{0}") + ", 5, 4) || ' ' || substr(" + _DIGITS.format("{0}") + ", 9, 4) ELSE {0} END"
_CAPTURED = f"CASE WHEN regexp_matches(t, '{_RE_NUMBER}') THEN regexp_extract(t, '{_RE_NUMBER}', 1) || ' ' || regexp_extract(t, '{_RE_NUMBER}', 2) || ' ' || regexp_extract(t, '{_RE_NUMBER}', 3) ELSE t END"
_CAPITAL = "list_aggregate(list_transform(string_split(t, ' '), lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z0-9_]') THEN upper(substr(x, 1, 1)) || substr(x, 2) ELSE x END), 'string_agg', ' ')"
_VALUE = {
    "user_dob": f"CASE WHEN regexp_matches(t, '{_RE_DATE}') THEN regexp_extract(t, '{_RE_DATE}', 1) ELSE t END",
    "user_aadhar_no": _TWELVE.format(f"({_CAPTURED})"),
    "user_gender": "replace(CASE upper(t) WHEN 'MALE' THEN 'M' WHEN 'TRANSGENDER' THEN 'T' ELSE t END, ' ', '')",
    "user_full_name": f"trim(regexp_replace({_CAPITAL}, '[^A-Za-z0-9_\\s.,\\-/]', '', 'g'))",
}
_KINDS = ("government_name", "user_full_name", "user_dob", "user_gender", "user_aadhar_no", "issued_on", "aadhar_info")
_CONF_OF = "CASE" + "".join(f" WHEN kind = '{k}'{' AND tidx < 2' if k != 'user_aadhar_no' else ''} THEN {sql}" for k, sql in _CONF.items()) + f" ELSE {_NONE} END"
_VALUE_OF = "CASE" + "".join(f" WHEN kind = '{k}'{' AND tidx < 2' if k != 'user_aadhar_no' else ''} THEN {sql}" for k, sql in _VALUE.items()) + " ELSE t END"
_TB = "tb AS (SELECT * FROM (VALUES " + ", ".join(f"({t['template_index']}, {i}, '{b['blockType']}', {', '.join(f'{b["boundingBox"][k]}::DOUBLE' for k in ('left', 'top', 'right', 'bottom'))})" for t in TEMPLATES for i, b in enumerate(t["blocks"])) + ") AS v(tidx, tpos, kind, l, t_, r, b))"


@query(f", k AS (SELECT unnest([{', '.join(repr(k) for k in _KINDS)}]) AS kind), m AS (SELECT scan_id, block_pos, kind, text AS t, 0 AS tidx FROM sb, k) SELECT scan_id, block_pos, kind, round({_CONF_OF}, 6) AS confidence FROM m")
def x6_rule_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_kinds(spark, sf_dir, "score").select("scan_id", "block_pos", "kind", F.round("score", 6).alias("confidence"))


def of_kinds(spark: SparkSession, sf_dir: str, fact: str) -> DataFrame:
    """A fact of every block under the rule of every kind of block of the first template."""
    book = facts.RuleBook(TEMPLATES[:1])
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col("facts")[book.number(TEMPLATES[0]["rules"].get(k))][fact].alias(fact)) for k in _KINDS))
    rows = facts.with_facts(scan_blocks(spark, sf_dir).select("scan_id", "block_pos", "text"), book)
    return rows.select("scan_id", "block_pos", F.explode(each).alias("e")).select("scan_id", "block_pos", "e.kind", f"e.{fact}")


@query(f", k AS (SELECT unnest([{', '.join(repr(k) for k in _KINDS)}]) AS kind), m AS (SELECT scan_id, block_pos, kind, text AS t, 0 AS tidx FROM sb, k) SELECT scan_id, block_pos, kind, {_VALUE_OF} AS value FROM m")
def x7_rule_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_kinds(spark, sf_dir, "value")


_BONUSES = {
    "patterns": [r"\d{4}"], "validation": {"mustContain": ["date", "birth"], "minLength": 5, "maxLength": 30},
    "confidenceScoring": {"baseScore": 0.1, "keywordMatchBonus": 0.2, "lengthBonus": 0.1, "allCapsBonus": 0.15, "commaBonus": 0.05, "dateFormatBonus": 0.1, "formatMatchBonus": 0.07, "validationPassBonus": 0.12, "digitCountBonus": {"8": 0.03}},
}
_EACH_BONUS = {
    "contains(lower(text), 'date') AND contains(lower(text), 'birth')": 0.2, "length(text) >= 5": 0.1, "text = upper(text) AND regexp_matches(text, '[A-Z]')": 0.15, "contains(text, ',')": 0.05,
    f"regexp_matches(text, '{_DATE}')": 0.1, r"regexp_matches(text, '\d{4}')": 0.07, "length(text) BETWEEN 5 AND 30": 0.12, "length(regexp_replace(text, '[^0-9]', '', 'g')) = 8": 0.03,
}


@query(" SELECT scan_id, block_pos, round(least(1.0::DOUBLE, 0.1::DOUBLE" + "".join(f" + CASE WHEN {test} THEN {bonus}::DOUBLE ELSE 0 END" for test, bonus in _EACH_BONUS.items()) + "), 6) AS confidence FROM sb")
def x6_every_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords, length, capitals, commas, dates, format, digits and validation in one rule."""
    book = facts.RuleBook([{"rules": {"any": _BONUSES}}])
    rows = facts.with_facts(scan_blocks(spark, sf_dir).select("scan_id", "block_pos", "text"), book)
    return rows.select("scan_id", "block_pos", F.round(F.col("facts")[book.number(_BONUSES)]["score"], 6).alias("confidence"))


_LAYOUT = """, c AS (SELECT scan_id, (left_ + right_) / 2 AS x, (top_ + bottom_) / 2 AS y FROM sb), mean AS (SELECT scan_id, count(*) AS n, avg(x) AS avg_x, avg(y) AS avg_y FROM c GROUP BY scan_id),
lay AS (SELECT mean.scan_id, any_value(n) AS n, any_value(avg_x) AS avg_x, any_value(avg_y) AS avg_y, avg(CASE WHEN x < avg_x THEN 1.0::DOUBLE ELSE 0 END) AS left_ratio, avg(CASE WHEN y < avg_y THEN 1.0::DOUBLE ELSE 0 END) AS top_ratio FROM c JOIN mean USING (scan_id) GROUP BY mean.scan_id)"""


@query(_LAYOUT + " SELECT scan_id, CAST(n AS INT) AS n, round(avg_x, 6) AS avg_x, round(avg_y, 6) AS avg_y, round(left_ratio, 6) AS left_ratio, round(top_ratio, 6) AS top_ratio FROM lay")
def l1_layout_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.layout_features(nested(spark, sf_dir)).select("scan_id", "n", *map(r6, ("avg_x", "avg_y", "left_ratio", "top_ratio")))


_TEMPLATE_LAYOUT = f""", {_TB}, tc AS (SELECT tidx, (l + r) / 2 AS x FROM tb), tm AS (SELECT tidx, count(*) AS n, avg(x) AS avg_x FROM tc GROUP BY tidx),
tl AS (SELECT tm.tidx, any_value(n) AS n, any_value(avg_x) AS avg_x, avg(CASE WHEN x < avg_x THEN 1.0::DOUBLE ELSE 0 END) AS left_ratio FROM tc JOIN tm USING (tidx) GROUP BY tm.tidx),
st AS (SELECT scan_id, tidx, (1 - abs(tl.avg_x - lay.avg_x) / 1000 + 1 - abs(tl.left_ratio - lay.left_ratio) + 1 - abs(tl.n - lay.n) / CAST(greatest(tl.n, lay.n) AS DOUBLE)) / 3 AS s FROM lay, tl)"""
_SCORES = _LAYOUT + _TEMPLATE_LAYOUT + f""", fit AS (SELECT scan_id, tidx, tpos, kind, block_pos, l, t_, r, b, text AS t, left_, top_, right_, bottom_ FROM sb, tb),
conf AS (SELECT *, {_CONF_OF} AS conf FROM fit), top AS (SELECT scan_id, tidx, tpos, max(conf) AS m FROM conf GROUP BY ALL), ct AS (SELECT scan_id, tidx, avg(m) AS c FROM top GROUP BY ALL),
sc AS (SELECT scan_id, tidx, s, c, s * 0.8::DOUBLE + c * 0.2::DOUBLE AS score FROM st JOIN ct USING (scan_id, tidx)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, tidx) AS k FROM sc WHERE score > 0) WHERE k = 1)"""


@query(_SCORES + " SELECT scan_id, tidx AS template_index, round(s, 6) AS similarity FROM sc")
def l2_structural_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.structural_similarity(nested(spark, sf_dir), TEMPLATES).select("scan_id", "template_index", r6("similarity"))


@query(_SCORES + " SELECT scan_id, tidx AS template_index, round(c, 6) AS similarity FROM sc")
def l3_content_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.content_similarity(nested(spark, sf_dir), TEMPLATES).select("scan_id", "template_index", r6("similarity"))


@query(_SCORES + " SELECT scan_id, tidx AS template_index, round(score, 6) AS score FROM best")
def l4_best_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_template(nested(spark, sf_dir), TEMPLATES).select("scan_id", "template_index", r6("score"))


_RESULTS = _SCORES + f""", near AS (SELECT conf.*, conf * 0.7::DOUBLE + 0.3::DOUBLE * greatest(0, 1 - sqrt(power(((left_ + right_) / 2 - (l + r) / 2) / 1000, 2) + power(((top_ + bottom_) / 2 - (t_ + b) / 2) / 1000, 2))) AS total, best.score FROM conf JOIN best USING (scan_id, tidx)),
pick AS (SELECT *, {_VALUE_OF} AS value FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, tpos ORDER BY round(total, 9) DESC, block_pos) AS k FROM near) WHERE k = 1 AND total > 0.1),
res AS (SELECT scan_id, CAST(any_value(tidx) AS INT) AS template_index, any_value(score) AS match_score, string_agg(kind || '=' || value, ';' ORDER BY tpos) AS fields, string_agg(kind, ';' ORDER BY tpos) AS matched FROM pick GROUP BY scan_id),
full_ AS (SELECT res.*, CASE template_index WHEN 0 THEN 'card' WHEN 1 THEN 'printout' ELSE 'unknown' END AS format, CASE template_index WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS format_id FROM res)"""


def flat_results(results: DataFrame) -> DataFrame:
    """Maps and arrays as text."""
    fields = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return results.select("scan_id", "template_index", "format", "format_id", r6("match_score"), fields.alias("fields"), F.array_join("matched", ";").alias("matched"))


@query(_RESULTS + " SELECT scan_id, template_index, format, format_id, round(match_score, 6) AS match_score, fields, matched FROM full_")
def l6_process_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_results(matching.process_documents(nested(spark, sf_dir), TEMPLATES))


@query(_RESULTS + " SELECT scan_id, kind AS block_type, value FROM pick")
def l5_extract_with_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.process_documents(nested(spark, sf_dir), TEMPLATES).select("scan_id", F.explode("fields").alias("block_type", "value"))


@query(" SELECT DISTINCT o_orderkey AS scan_id FROM orders WHERE o_orderkey NOT IN (SELECT scan_id FROM sb WHERE scan_id % 4 <> 0)")
def l7_unmatched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth scan has lost its blocks."""
    rows = scan_blocks(spark, sf_dir)
    lost = rows.withColumns({c: F.when(F.col("scan_id") % 4 != 0, F.col(c)).alias(c) for c in ("block_pos", "text")})
    _, others = matching.split_documents(matching.nest(lost), TEMPLATES)
    return others.select("scan_id")


@query(
    _RESULTS + """, per AS (SELECT format, count(*) AS documents, avg(match_score) AS mean_score FROM full_ GROUP BY format)
    SELECT format, kind AS field, any_value(documents) AS documents, count(*) AS filled, round(count(*) / CAST(any_value(documents) AS DOUBLE), 6) AS fill_rate, round(any_value(mean_score), 6) AS mean_score
    FROM pick JOIN (SELECT scan_id, format FROM full_) USING (scan_id) JOIN per USING (format) WHERE value <> '' GROUP BY format, kind"""
)
def l13_extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = matching.extraction_report(matching.process_documents(nested(spark, sf_dir), TEMPLATES))
    return report.select("format", "field", "documents", "filled", r6("fill_rate"), r6("mean_score"))


_FLAGS = r""", low AS (SELECT *, lower(text) AS low FROM sb),
fl AS (SELECT scan_id, bool_or(issue AND bottom_ - top_ > right_ - left_ AND left_ < 50) AS left_issue, bool_or(top_ < 100 AND left_ > 500) AS top_right,
  bool_or(left_ < 50 AND regexp_matches(trim(text), '^\d+[A-Z]*\d*$') AND length(text) >= 6) AS compact, bool_or(issue) AS any_issue, arg_max(left_, block_pos) FILTER (WHERE contains(low, 'government') OR contains(low, 'india')) AS header_left
  FROM (SELECT *, contains(low, 'aadhaar') AND (contains(low, 'issued') OR regexp_matches(low, '\d{4}')) AS issue FROM low) GROUP BY scan_id),
flags AS (SELECT scan_id, left_issue, top_right, any_issue AND left_issue AND coalesce(header_left > 200, false) AS wide, compact FROM fl)"""


@query(_FLAGS + " SELECT * FROM flags")
def l9_scan_layout_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.scan_layout_flags(cards(spark, sf_dir))


_CARD = {
    "issued_on": (0.8, r"contains(low, 'aadhaar') OR regexp_matches(text, '\d{2}[/\-.]\d{2}[/\-.]\d{4}') OR regexp_matches(text, '\d{8}')"), "government_name": (0.8, "contains(low, 'government') OR contains(low, 'india')"),
    "user_full_name": (0.8, r"regexp_matches(trim(text), '^[A-Za-z]+(\s+[A-Za-z]+){1,3}$')"), "user_dob": (0.9, r"contains(low, 'dob') OR regexp_matches(text, '\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}')"),
    "user_gender": (0.9, "contains(low, 'male')"), "user_aadhar_no": (0.9, r"regexp_matches(trim(text), '^\d{4}\s*\d{4}\s*\d{4}$')"), "aadhar_info": (0.7, "contains(low, 'proof') AND contains(low, 'identity')"),
}
_TFLAGS = "tf AS (SELECT * FROM (VALUES " + ", ".join(f"({t['template_index']}, '{t['format']}', {', '.join(str(f[k]).lower() for k in ('left_issue', 'top_right', 'wide', 'compact'))})" for t in TEMPLATES for f in (identity.template_flags(t),)) + ") AS v(tidx, format, a, b, c, d))"
_ID_SCORES = (_IDENTITY + _FLAGS + f", {_TB}, {_TFLAGS}" + ", cs AS (SELECT scan_id, tidx, tpos, max(CASE WHEN base > 0 THEN base * 0.8::DOUBLE + 0.2::DOUBLE * greatest(0, 1 - sqrt(power(((left_ + right_) / 2 - (l + r) / 2) / 800, 2) + power(((top_ + bottom_) / 2 - (t_ + b) / 2) / 800, 2))) ELSE 0 END) AS m FROM (SELECT *, CASE " + " ".join(f"WHEN kind = '{k}' THEN CASE WHEN {sql} THEN {v}::DOUBLE ELSE 0 END" for k, (v, sql) in _CARD.items()) + """ ELSE 0 END AS base FROM low, tb) GROUP BY ALL),
cc AS (SELECT scan_id, tidx, avg(m) AS content FROM cs GROUP BY ALL),
ids AS (SELECT scan_id, cc.tidx AS template_index, format, (0.25::DOUBLE * (CAST(left_issue = a AS INT) + CAST(top_right = b AS INT) + CAST(wide = c AS INT) + CAST(compact = d AS INT)) + content
  + CASE WHEN name <> '' THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN date_of_birth <> '' THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN gender <> '' THEN 0.07::DOUBLE ELSE 0 END + CASE WHEN id_number <> '' THEN 0.07::DOUBLE ELSE 0 END
  + CASE WHEN format = 'printout' AND wide OR format = 'card' AND compact THEN 0.2::DOUBLE ELSE 0 END) / 2.5::DOUBLE AS score, name, date_of_birth, gender, id_number FROM cc JOIN flags USING (scan_id) JOIN ident USING (scan_id) JOIN tf ON tf.tidx = cc.tidx)""")  # fmt: skip




def scan_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each derived scan: the same boxes, with block types by position."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), F.col("block_pos") + 1)
    block = F.struct("block_pos", kind.alias("blockType"), F.struct("left", "top", "right", "bottom").alias("boundingBox"))
    rows = scan_blocks(spark, sf_dir).groupBy(F.col("scan_id").alias("template_index")).agg(F.array_sort(F.collect_list(block)).alias("b"))
    return rows.select("template_index", F.transform("b", lambda x: F.struct(x["blockType"].alias("text"), x["blockType"].alias("blockType"), x["boundingBox"].alias("boundingBox"))).alias("blocks"))


@query(""", per AS (SELECT scan_id, bool_or(block_pos = 5 AND bottom_ - top_ > right_ - left_ AND left_ < 50) AS left_issue, bool_or(top_ < 100 AND left_ > 500) AS top_right,
  bool_or(block_pos = 5) AND bool_or(block_pos = 0) AS paired, coalesce(max(CASE WHEN block_pos = 0 THEN left_ END), 0) AS header_left FROM sb GROUP BY scan_id)
SELECT scan_id AS template_index, left_issue, top_right, paired AND left_issue AND header_left > 180 AS wide, paired AND NOT (left_issue AND header_left > 180) AND header_left < 250 AS compact FROM per""")
def l8_template_layout_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.template_layout_flags(scan_templates(spark, sf_dir))


@query(_ID_SCORES + " SELECT scan_id, CAST(template_index AS INT) AS template_index, round(score, 6) AS score FROM ids")
def l10_id_template_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.id_template_score(cards(spark, sf_dir), TEMPLATES).select("scan_id", "template_index", r6("score"))


_BEST_ID = _ID_SCORES + ", win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY round(score, 9) DESC, template_index) AS k FROM ids WHERE score > 0) WHERE k = 1)"


@query(_BEST_ID + " SELECT scan_id, CAST(template_index AS INT) AS template_index, round(score, 6) AS score FROM win")
def l11_best_id_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.best_id_template(cards(spark, sf_dir), TEMPLATES).select("scan_id", "template_index", r6("score"))


@query(_BEST_ID + " SELECT scan_id, CAST(template_index AS INT) AS template_index, format, CASE template_index WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS format_id, round(score, 6) AS score, name, date_of_birth, gender, id_number FROM win")
def l12_process_id_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.process_id_documents(cards(spark, sf_dir), TEMPLATES).select("scan_id", "template_index", "format", "format_id", r6("score"), *FIELDS)


_MESSY = """, messy AS (SELECT scan_id, block_pos, CASE WHEN (scan_id + block_pos) % 5 = 0 THEN NULL ELSE text END AS text, (scan_id + block_pos) % 7 = 0 AS no_side, (scan_id + block_pos) % 3 = 0 AS no_corners, scan_id % 6 = 0 AS no_text FROM sb),
num AS (SELECT *, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY block_pos) - 1 AS STRING) AS i FROM messy),
msg AS (SELECT scan_id, block_pos, 1 AS k, 'Invalid boundingBox in block ' || i AS m FROM num WHERE no_side UNION ALL SELECT scan_id, block_pos, 2, 'Missing or invalid cornerPoints array in block ' || i FROM num WHERE no_corners
  UNION ALL SELECT scan_id, block_pos, 3, 'Missing or invalid text property in block ' || i FROM num WHERE text IS NULL UNION ALL SELECT scan_id, block_pos, 4, 'Missing or invalid lines array in block ' || i FROM num
  UNION ALL SELECT DISTINCT scan_id, -1, 0, 'Missing or invalid text property' FROM num WHERE no_text)
SELECT scan_id, string_agg(m, '; ' ORDER BY block_pos, k) AS errors, false AS is_valid FROM msg GROUP BY scan_id"""


def messy_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans whose blocks lack lines, and some of their other parts."""
    key = F.col("scan_id") + F.col("block_pos")
    box = F.struct("left", "top", F.when(key % 7 != 0, F.col("right")).alias("right"), "bottom")
    corners = F.when(key % 3 != 0, F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))))
    part = F.struct("block_pos", F.when(key % 5 != 0, F.col("text")).alias("text"), box.alias("boundingBox"), corners.alias("cornerPoints"), F.lit(None).cast("array<struct<text:string,boundingBox:struct<left:double,top:double,right:double,bottom:double>,cornerPoints:array<struct<x:double,y:double>>,elements:array<struct<text:string,boundingBox:struct<left:double,top:double,right:double,bottom:double>,cornerPoints:array<struct<x:double,y:double>>>>>>").alias("lines"))
    rows = scan_blocks(spark, sf_dir).groupBy("scan_id").agg(F.array_sort(F.transform(F.collect_list(F.struct("block_pos", part.alias("p"))), lambda x: x), lambda a, b: (a["block_pos"] - b["block_pos"]).cast("int")).alias("b"))
    return rows.select("scan_id", F.when(F.col("scan_id") % 6 != 0, "text").alias("text"), F.transform("b", lambda x: x["p"]).alias("blocks"))


@query(_MESSY)
def p1_validate_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.validate_scans(messy_scans(spark, sf_dir)).select("scan_id", F.array_join("errors", "; ").alias("errors"), "is_valid")


@query(" SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY block_pos) - 1 AS INT) AS block_pos, text, left_ AS left FROM sb")
def p2_explode_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.explode_blocks(nested(spark, sf_dir)).select("scan_id", "block_pos", "block.text", "block.boundingBox.left")


def _lists(values: pa.Array, like: pa.Array) -> pa.ListArray:
    """Lists of `values` as long as those of `like`, null where they are."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(like), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), values, mask=like.is_null())


def in_letters(texts: pa.Array) -> pa.Array:
    """Blocks of lists of texts: every word is a line, and every letter (code point) of it an element; a null text has null lines."""
    split = pc.split_pattern(texts.flatten(), " ")
    words = split.flatten()
    if not len(words):
        elements = pa.array([], pa.list_(pa.struct({"text": pa.string()})))
    else:
        ends, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1], words.buffers()[2]
        first = (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] & 0xC0) != 0x80  # the first byte of a letter in UTF-8
        starts = np.append(np.flatnonzero(first) + ends[0], ends[-1]).astype(np.int32)
        letters = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), data)
        of_word = np.append(0, np.cumsum(first))[ends - ends[0]].astype(np.int32)
        elements = pa.ListArray.from_arrays(pa.array(of_word), pa.StructArray.from_arrays([letters], ["text"]))
    lines = _lists(pa.StructArray.from_arrays([words, elements], ["text", "elements"]), split)
    return _lists(pa.StructArray.from_arrays([texts.flatten(), lines], ["text", "lines"]), texts)


def lined_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived scans in which every word is a line, and every letter of it an element; made in Arrow batches, since lambdas copy every
    letter anew for each level that they nest it in."""
    lettered = F.arrow_udf(in_letters, "array<struct<text:string,lines:array<struct<text:string,elements:array<struct<text:string>>>>>>")
    return nested(spark, sf_dir).select("scan_id", lettered(F.col("blocks.text")).alias("blocks"))


_LINES = ", w AS (SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY block_pos) - 1 AS INT) AS block_pos, string_split(text, ' ') AS w FROM sb), ln AS (SELECT scan_id, block_pos, CAST(unnest(range(len(w))) AS INT) AS line_pos, unnest(w) AS text FROM w)"


@query(_LINES + " SELECT scan_id, block_pos, line_pos, text FROM ln")
def p2_explode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.explode_lines(lined_scans(spark, sf_dir)).select("scan_id", "block_pos", "line_pos", "line.text")


@query(_LINES + " SELECT scan_id, block_pos, line_pos, CAST(unnest(range(length(text))) AS INT) AS element_pos, unnest(string_split(text, '')) AS text FROM ln")
def p2_explode_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.explode_elements(lined_scans(spark, sf_dir)).select("scan_id", "block_pos", "line_pos", "element_pos", "element.text")


_RAW = """SELECT CAST(o_orderkey AS INT) AS k, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('f', CAST(o_orderkey % 3 AS {text})) END AS format, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE CAST(o_orderkey % 7 AS INT) END AS format_id,
  CASE WHEN o_orderkey % 5 <> 0 THEN concat('n', CAST(o_orderkey % 2 AS {text})) WHEN o_orderkey % 10 = 0 THEN '' END AS inner_format, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 4 AS INT) END AS inner_id FROM """


@query(f", raw AS ({_RAW.format(text='VARCHAR')} orders) SELECT k AS template_index, coalesce(nullif(format, ''), nullif(inner_format, ''), 'unknown') AS format, coalesce(nullif(format_id, 0), nullif(inner_id, 0), 0) AS format_id, CAST(CASE k % 6 WHEN 0 THEN CASE WHEN inner_format IS NULL THEN 0 ELSE 2 END WHEN 1 THEN 0 ELSE 1 END AS INT) AS n_blocks FROM raw")
def p3_normalize_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each order; a third of them have their parts under textRecognition only."""
    raw = spark.sql(_RAW.format(text="STRING") + "{orders}", orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    box = "array<struct<text:string,blockType:string,boundingBox:struct<left:double,top:double,right:double,bottom:double>>>"
    some = lambda n: F.array_repeat(F.struct(F.lit("t").alias("text"), F.lit("user_dob").alias("blockType"), F.lit(None).cast("struct<left:double,top:double,right:double,bottom:double>").alias("boundingBox")), n).cast(box)
    inner = F.when(F.col("inner_format").isNotNull(), F.struct(some(2).alias("blocks"), F.col("inner_format").alias("format"), F.col("inner_id").alias("formatId")))
    blocks = F.when(F.col("k") % 6 == 1, some(0)).when(F.col("k") % 6 > 1, some(1))
    rows = raw.select(F.col("k").alias("template_index"), "format", F.col("format_id").alias("formatId"), blocks.alias("blocks"), inner.alias("textRecognition"), F.lit(None).cast("map<string,string>").alias("extractionRules"))
    return scans.normalize_templates(rows).select("template_index", "format", "format_id", F.size("blocks").alias("n_blocks"))


_DEEP = """, b AS (SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY block_pos) - 1 AS INT) AS i FROM sb),
ln AS (SELECT scan_id, i, j, scan_id + i + j AS key, concat('line ', CAST(j AS VARCHAR), ' of block ', CAST(i AS VARCHAR)) AS name FROM b, (VALUES (0), (1)) AS t(j)),
el AS (SELECT scan_id, i, j, k, key + k AS key, concat('element ', CAST(k AS VARCHAR), ' of line ', CAST(j AS VARCHAR), ' in block ', CAST(i AS VARCHAR)) AS name FROM ln, (VALUES (0), (1)) AS t(k) WHERE key % 11 <> 0 AND key % 4 <> 0),
msg AS (SELECT scan_id, i, j, -1 AS k, 0 AS n, concat('Line ', CAST(j AS VARCHAR), ' in block ', CAST(i AS VARCHAR), ' is not an object') AS m FROM ln WHERE key % 11 = 0
  UNION ALL SELECT scan_id, i, j, -1, 1, 'Invalid boundingBox in ' || name FROM ln WHERE key % 11 <> 0 AND key % 7 = 0 UNION ALL SELECT scan_id, i, j, -1, 2, 'Missing or invalid cornerPoints array in ' || name FROM ln WHERE key % 11 <> 0 AND key % 3 = 0
  UNION ALL SELECT scan_id, i, j, -1, 3, 'Missing or invalid text property in ' || name FROM ln WHERE key % 11 <> 0 AND key % 5 = 0 UNION ALL SELECT scan_id, i, j, -1, 4, 'Missing or invalid elements array in ' || name FROM ln WHERE key % 11 <> 0 AND key % 4 = 0
  UNION ALL SELECT scan_id, i, j, k, 1, 'Invalid boundingBox in ' || name FROM el WHERE key % 7 = 0 UNION ALL SELECT scan_id, i, j, k, 2, 'Missing or invalid cornerPoints array in ' || name FROM el WHERE key % 3 = 0
  UNION ALL SELECT scan_id, i, j, k, 3, 'Missing or invalid text property in ' || name FROM el WHERE key % 5 = 0)
SELECT s.scan_id, coalesce(string_agg(m, '; ' ORDER BY i, j, k, n), '') AS errors, count(m) = 0 AS is_valid FROM (SELECT DISTINCT scan_id FROM sb) AS s LEFT JOIN msg ON s.scan_id = msg.scan_id GROUP BY s.scan_id"""


def in_messy_lines(ids: pa.Array, blocks: pa.Array) -> pa.Array:
    """Blocks of scans with two lines each and two elements in a line; by their numbers, lines and elements lack some of their parts."""
    items = blocks.flatten()
    sizes = pc.fill_null(pc.list_value_length(blocks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    scan = np.repeat(np.arange(len(sizes)), sizes)
    key = ids.to_numpy(zero_copy_only=False)[scan] + np.arange(len(scan)) - (np.cumsum(sizes) - sizes)[scan]

    def part(of: np.ndarray, lacks: Callable[[int], np.ndarray], gone: np.ndarray | None = None, **more: pa.Array) -> pa.Array:
        taken = lambda *path, bad=None: pc.if_else(pa.array(np.zeros(len(of), bool) if bad is None else bad), None, pc.struct_field(items, list(path)).take(pa.array(of)))
        sides = {"left": None, "top": None, "right": lacks(7), "bottom": None}
        box = pa.StructArray.from_arrays([taken("boundingBox", s, bad=bad) for s, bad in sides.items()], list(sides))
        zeros = pa.array(np.zeros(int((~lacks(3)).sum())))
        corners = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(~lacks(3))).astype(np.int32)), pa.StructArray.from_arrays([zeros, zeros], ["x", "y"]), mask=pa.array(lacks(3)))
        parts = {"text": taken("text", bad=lacks(5)), "boundingBox": box, "cornerPoints": corners, **more}
        return pa.StructArray.from_arrays(list(parts.values()), list(parts), mask=None if gone is None else pa.array(gone))

    every = np.arange(len(key))
    line_of, line_key = np.repeat(every, 2), (key[:, None] + np.arange(2)).ravel()
    has = line_key % 4 != 0
    element_key = (line_key[has][:, None] + np.arange(2)).ravel()
    elements = part(np.repeat(line_of[has], 2), lambda m: element_key % m == 0)
    elements = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has * 2)).astype(np.int32)), elements, mask=pa.array(~has))
    lines = part(line_of, lambda m: line_key % m == 0, line_key % 11 == 0, elements=elements)
    lines = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * np.int32(2)), lines)
    return _lists(part(every, lambda m: np.zeros(len(key), bool), lines=lines), blocks)


def messy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans whose blocks are whole, and whose lines and elements lack some of their parts; made in Arrow batches as in `lined_scans`."""
    messy = F.arrow_udf(in_messy_lines, f"array<{BLOCK}>")
    return nested(spark, sf_dir).select("scan_id", F.lit("text").alias("text"), messy("scan_id", "blocks").alias("blocks"))


@query(_DEEP)
def p1_validate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.validate_scans(messy_lines(spark, sf_dir)).select("scan_id", F.array_join("errors", "; ").alias("errors"), "is_valid")


@query(" SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY block_pos) - 1 AS INT) AS block_pos, text, left_ AS left, right_ AS right FROM sb")
def s1_read_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived scans, written as JSON and read back."""
    path = folders.new_folder(spark, "scans")
    nested(spark, sf_dir).write.json(path)
    return scans.explode_blocks(io.read_scans(spark, path)).select("scan_id", "block_pos", "block.text", "block.boundingBox.left", "block.boundingBox.right")


@query(""" SELECT CAST(o_orderkey % 4 AS INT) AS kind, CASE o_orderkey % 4 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'wrong type' WHEN 3 THEN 'cut off' END AS reason, count(*) AS records FROM orders GROUP BY ALL""")
def s1_rejected_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order: some aren't JSON, some have a part of a wrong type, some are cut off."""
    key = F.col("o_orderkey")
    whole = F.concat(F.lit('{"scan_id": '), key.cast("string"), F.lit(', "text": "k'), (key % 4).cast("string"), F.lit('", "blocks": [{"text": "a", "boundingBox": {"left": '), F.when(key % 4 == 2, '"x"').otherwise("1.5"), F.lit("}}]}"))
    raw = F.when(key % 4 == 1, F.concat(F.lit("k1 "), key.cast("string"))).when(key % 4 == 3, F.concat(F.lit('{"k3": '), key.cast("string"))).otherwise(whole)
    path = folders.new_folder(spark, "records")
    spark.read.parquet(f"{sf_dir}/orders.parquet").select(raw.alias("value")).write.text(path)
    scans_, rejects = io.read_scans_checked(spark, path)
    told = rejects.select(F.when(F.col("reason") == "wrong type", 2).when(F.col("reason") == "cut off", 3).otherwise(1).alias("kind"), "reason")
    good = scans_.where("scan_id % 4 = 0 AND blocks[0].boundingBox.left = 1.5").select(F.lit(0).alias("kind"), F.lit(None).cast("string").alias("reason"))
    return told.unionByName(good).groupBy("kind", "reason").agg(F.count("*").alias("records"))


@query(""", per AS (SELECT p_brand, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand)
SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INT) AS template_index, p_brand AS format, CAST(n % 5 AS INT) AS format_id, CAST(lo AS DOUBLE) AS left, CAST(hi AS DOUBLE) AS right FROM per""")
def s2_read_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each brand of parts, written as one file with a JSON array and read back."""
    per = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    box = F.struct(F.col("lo").cast("double").alias("left"), F.lit(0.0).alias("top"), F.col("hi").cast("double").alias("right"), F.lit(1.0).alias("bottom"))
    inner = F.struct(F.col("p_brand").alias("format"), F.lit(0).alias("formatId"))
    whole = F.struct("p_brand", F.array(F.struct(F.lit("t").alias("text"), F.lit("user_dob").alias("blockType"), box.alias("boundingBox"))).alias("blocks"), (F.col("n") % 5).cast("int").alias("formatId"), inner.alias("textRecognition"))
    path = folders.new_folder(spark, "templates")
    per.agg(F.to_json(F.array_sort(F.collect_list(whole))).alias("value")).write.text(path)
    rows = scans.normalize_templates(io.read_templates(spark, path))
    return rows.select(F.col("template_index").cast("int").alias("template_index"), "format", "format_id", F.col("blocks")[0]["boundingBox"]["left"].alias("left"), F.col("blocks")[0]["boundingBox"]["right"].alias("right"))


@query(""" SELECT l_orderkey AS anchor, CAST(l_linenumber AS INT) AS config_pos, CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_partkey % 90 AS DOUBLE) ELSE 0 END AS offset_x, CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_suppkey % 90 AS DOUBLE) ELSE 0 END AS offset_y,
  CASE WHEN l_orderkey % 5 = 0 THEN 0.25 ELSE 0.1 END AS doc_width_ratio, CASE WHEN l_orderkey % 7 = 0 THEN 0.5 ELSE 0.1 END AS doc_height_ratio FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_partkey % 4 <> 0""")
def s6_normalize_anchor_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anchor for each order line: some without a picture, some whose picture can't be read, some without numbers."""
    key, image = F.col("l_orderkey"), F.struct(F.when(F.col("l_partkey") % 4 != 0, 4).otherwise(-1).alias("height"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        key.alias("anchor"), F.col("l_linenumber").cast("int").alias("config_pos"), F.when(key % 2 == 0, F.col("l_partkey") % 90).alias("offset_x"), F.when(key % 3 == 0, F.col("l_suppkey") % 90).alias("offset_y"),
        F.when(key % 5 == 0, 0.25).alias("doc_width_ratio"), F.when(key % 7 == 0, 0.5).alias("doc_height_ratio"), F.when(F.col("l_linenumber") % 3 != 0, image).alias("image"),
    )
    return io.normalize_anchor_configs(rows).drop("image")


@query(_RESULTS + " SELECT scan_id, template_index, format, format_id, round(match_score, 6) AS match_score, fields, matched FROM full_")
def s7_write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written in two batches by format, the first of them twice, as a replay does, and read back."""
    results = folders.written(matching.process_documents(nested(spark, sf_dir), TEMPLATES), "results")
    path = folders.new_folder(spark, "sink")
    for batch in (0, 1, 0):
        io.write_batch(results.where(F.col("scan_id") % 2 == batch), batch, path)
    return flat_results(io.read_batches(spark, path, results.schema))


@query(_RESULTS + " SELECT scan_id, template_index, format, format_id, round(match_score, 6) AS match_score, fields, matched FROM full_")
def t4_stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived scans arrive as a stream of files; the results are what its sink holds when all have been read."""
    arriving, sink, state = (folders.new_folder(spark, name) for name in ("arriving", "results", "state"))
    stored = nested(spark, sf_dir)
    stored.write.parquet(arriving)
    known = matching.known_facts(spark.read.schema(stored.schema).parquet(arriving), TEMPLATES)
    results = stream_documents(spark.readStream.schema(stored.schema).parquet(arriving), TEMPLATES, known)
    results.writeStream.format("parquet").option("checkpointLocation", state).option("path", sink).trigger(availableNow=True).start().awaitTermination()
    return flat_results(spark.read.schema(results.schema).parquet(sink))
