"""Identity cards: fields by position-free patterns, layout flags, and the card-specific template score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import FIELDS, SPACE, is_boilerplate, let, once, trimmed_column
from docloom.operators.matching import center_x, center_y


_DATE = r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}"
#: What is asked of a text besides the fields, each a bit of `said`: for the flags, and for the types of blocks that have a score.
_KINDS = {"issued_on": 0.8, "government_name": 0.8, "user_full_name": 0.8, "user_dob": 0.9, "user_gender": 0.9, "user_aadhar_no": 0.9, "aadhar_info": 0.7}
_BITS = {name: 1 << k for k, name in enumerate(("issue", "header", "short", *_KINDS))}


def _read_text(text: Column) -> Column:
    return F.struct(F.lower(text).alias("low"), trimmed_column(text).alias("plain"), (~is_boilerplate(text)).alias("useful"))


def _card(text: Column, read: Column) -> Column:
    """struct<said, name, date_of_birth, gender, id_number> of a text and what `_read_text` gives: all that identity cards ask
    of it. Boilerplate has no fields; a null or empty text has a null."""
    low, plain = read["low"], read["plain"]
    has = lambda word: F.contains(low, F.lit(word))
    tests = {
        "issue": has("aadhaar") & (has("issued") | low.rlike(r"\d{4}")),
        "header": has("government") | has("india"),
        "short": (F.length(text) >= 6) & plain.rlike(r"^\d+[A-Z]*\d*$"),
        "issued_on": has("aadhaar") | text.rlike(r"\d{2}[/\-.]\d{2}[/\-.]\d{4}") | text.rlike(r"\d{8}"),
        "government_name": has("government") | has("india"),
        "user_full_name": plain.rlike(f"^[A-Za-z]+({SPACE}+[A-Za-z]+){{1,3}}$"),
        "user_dob": has("dob") | text.rlike(_DATE),
        "user_gender": has("male") | has("female"),
        "user_aadhar_no": plain.rlike(rf"^\d{{4}}{SPACE}*\d{{4}}{SPACE}*\d{{4}}$"),
        "aadhar_info": has("proof") & has("identity"),
    }
    said = sum((F.when(tests[name], bit).otherwise(0) for name, bit in _BITS.items()), F.lit(0))
    fields = (F.when(read["useful"], F.nullif(of(text), F.lit(""))).alias(n) for n, of in FIELDS.items())
    return F.when(text.isNotNull() & (text != ""), F.struct(said.alias("said"), *fields))


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Rows of blocks with `card`, what identity cards ask of a text. Read from rows, it is compiled code; where nested blocks don't
    carry it, it is worked out inside the row, block by block."""
    rows = once(blocks, "__x", _read_text(F.col("text")))
    return rows.select(*blocks.columns, _card(F.col("text"), F.col("__x")).alias("card"))


def _read(scans: DataFrame) -> DataFrame:
    """scans with __cards: of each block with a text its card and boundingBox, in order; null without blocks."""
    carried = "card" in scans.selectExpr("blocks[0] AS b").schema["b"].dataType.names
    card = lambda b: b["card"] if carried else let(_read_text(b["text"]), lambda x: _card(b["text"], x))
    cards = F.transform("blocks", lambda b: F.struct(card(b).alias("card"), b["boundingBox"].alias("boundingBox")))
    return once(scans, "__cards", F.filter(cards, lambda b: b["card"].isNotNull()))


def _says(block: Column, name: str) -> Column:
    return block["card"]["said"].bitwiseAND(_BITS[name]) != 0


def identity(cards: Column) -> Column:
    """A struct with, for each field, the value of the first block that yields it, '' without one."""
    first = lambda name: F.get(F.filter(F.transform(cards, lambda b: b["card"][name]), lambda v: v.isNotNull()), 0)
    return F.struct(*(F.coalesce(first(n), F.lit("")).alias(n) for n in FIELDS))


def extract_identity_fields(scans: DataFrame) -> DataFrame:
    """scan_id, name, date_of_birth, gender, id_number."""
    return once(_read(scans), "__i", identity(F.col("__cards"))).select("scan_id", "__i.*")


def extract_identity_fields_flat(blocks: DataFrame) -> DataFrame:
    """The same from rows scan_id, block_pos, text, by one grouped arg-min for each field."""
    rows = once(blocks.select("scan_id", "block_pos", "text"), "__useful", F.col("text").isNotNull() & ~is_boilerplate(F.col("text")))
    rows = rows.select("scan_id", "block_pos", *(F.when(F.col("__useful"), of(F.col("text"))).alias(n) for n, of in FIELDS.items()))
    return rows.groupBy("scan_id").agg(*(F.coalesce(F.min_by(n, F.when(F.col(n).isNotNull() & (F.col(n) != ""), F.col("block_pos"))), F.lit("")).alias(n) for n in FIELDS))


def template_flags(template: dict) -> dict[str, bool]:
    """left_issue, top_right, wide, compact of a template; the last block of a type counts."""
    blocks = [b for b in template["blocks"] or () if b and b["boundingBox"]]
    size = lambda b: (b["boundingBox"]["right"] - b["boundingBox"]["left"], b["boundingBox"]["bottom"] - b["boundingBox"]["top"])
    upright = lambda b: size(b)[1] > size(b)[0] and b["boundingBox"]["left"] < 50
    issued, header = ([b for b in blocks if b["blockType"] == k][-1:] for k in ("issued_on", "government_name"))
    flags = {"left_issue": any(upright(b) for b in blocks if b["blockType"] == "issued_on"), "top_right": any(b["boundingBox"]["top"] < 100 and b["boundingBox"]["left"] > 500 for b in blocks), "wide": False, "compact": False}
    if issued and header:
        left = header[0]["boundingBox"]["left"]
        flags["wide"] = upright(issued[0]) and left > 180
        flags["compact"] = not flags["wide"] and left < 250
    return flags


def template_layout_flags(templates: DataFrame) -> DataFrame:
    """template_index, left_issue, top_right, wide, compact, from normalised templates."""
    box = lambda b: b["boundingBox"]
    upright = lambda b: (box(b)["bottom"] - box(b)["top"] > box(b)["right"] - box(b)["left"]) & (box(b)["left"] < 50)
    boxed = F.filter("blocks", lambda b: b["boundingBox"].isNotNull())
    of = lambda kind: F.filter(boxed, lambda b: b["blockType"] == kind)
    last = lambda kind: F.try_element_at(of(kind), F.lit(-1))
    both = last("issued_on").isNotNull() & last("government_name").isNotNull()
    wide = F.coalesce(both & upright(last("issued_on")) & (box(last("government_name"))["left"] > 180), F.lit(False))
    return templates.select(
        "template_index",
        F.exists(of("issued_on"), upright).alias("left_issue"),
        F.exists(boxed, lambda b: (box(b)["top"] < 100) & (box(b)["left"] > 500)).alias("top_right"),
        wide.alias("wide"),
        F.coalesce(both & ~wide & (box(last("government_name"))["left"] < 250), F.lit(False)).alias("compact"),
    )


def flags(cards: Column) -> Column:
    """A struct of the same flags from recognised text."""
    box = lambda b: b["boundingBox"]
    seen = F.filter(F.coalesce(cards, F.array()), lambda b: box(b).isNotNull())

    def told(seen: Column) -> Column:
        header = F.filter(seen, lambda b: _says(b, "header"))
        left_issue = F.exists(seen, lambda b: _says(b, "issue") & (box(b)["bottom"] - box(b)["top"] > box(b)["right"] - box(b)["left"]) & (box(b)["left"] < 50))
        wide = left_issue & F.coalesce(box(F.try_element_at(header, F.lit(-1)))["left"] > 200, F.lit(False))
        found = {"left_issue": left_issue, "top_right": F.exists(seen, lambda b: (box(b)["top"] < 100) & (box(b)["left"] > 500)), "wide": wide, "compact": F.exists(seen, lambda b: _says(b, "short") & (box(b)["left"] < 50))}
        return F.struct(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in found.items()))

    return let(seen, told)


def scan_layout_flags(scans: DataFrame) -> DataFrame:
    return once(_read(scans), "__f", flags(F.col("__cards"))).select("scan_id", "__f.*")


def _card_content(cards: Column, template: dict) -> Column:
    typed = [b for b in template["blocks"] or () if b and b["text"] and b["blockType"]]
    if not typed:
        return F.lit(0.0)

    def score(t: dict) -> callable:
        base = _KINDS[t["blockType"]]

        def of(b: Column) -> Column:
            if not t["boundingBox"]:
                return F.lit(base)
            box = t["boundingBox"]
            dx, dy = (center_x(b["boundingBox"]) - (box["left"] + box["right"]) / 2) / 800, (center_y(b["boundingBox"]) - (box["top"] + box["bottom"]) / 2) / 800
            near = F.greatest(F.lit(0.0), 1 - F.sqrt(dx * dx + dy * dy))
            return F.when(b["boundingBox"].isNotNull(), F.lit(base) * 0.8 + near * 0.2).otherwise(F.lit(base))

        # A block that doesn't say what its type asks for scores 0, and isn't measured.
        return lambda b: F.when(_says(b, t["blockType"]), of(b)).otherwise(0.0)

    total = F.lit(0.0)
    for t in typed:
        if t["blockType"] in _KINDS:
            total = total + F.coalesce(F.array_max(F.transform(cards, score(t))), F.lit(0.0))
    return total / len(typed)


def with_id_scores(scans: DataFrame, templates: list[dict]) -> DataFrame:
    """scans with the identity fields and scores: array of struct<template_index, score>."""
    rows = once(_read(scans), "__k", F.struct(flags(F.col("__cards")).alias("f"), identity(F.col("__cards")).alias("i")))
    rows = rows.select("*", *(F.col(f"__k.f.{n}").alias(f"__{n}") for n in ("left_issue", "top_right", "wide", "compact")), "__k.i.*").drop("__k")
    bonus = sum((F.when(F.col(n) != "", w).otherwise(0.0) for n, w in (("name", 0.08), ("date_of_birth", 0.08), ("gender", 0.07), ("id_number", 0.07))), F.lit(0.0))
    entries = []
    for t in templates:
        own = template_flags(t)
        layout = sum((F.when(F.col(f"__{n}") == own[n], 0.25).otherwise(0.0) for n in ("left_issue", "compact", "wide", "top_right")), F.lit(0.0))
        kind = {"printout": F.col("__wide"), "card": F.col("__compact")}.get(t["format"], F.lit(False))
        score = (layout + _card_content(F.col("__cards"), t) + bonus + F.when(kind, 0.2).otherwise(0.0)) / 2.5
        entries.append(F.struct(F.lit(t["template_index"]).alias("template_index"), score.alias("score")))
    out = F.array(*entries) if entries else F.array().cast("array<struct<template_index:int,score:double>>")
    return once(rows, "scores", out).drop("__left_issue", "__top_right", "__wide", "__compact", "__cards")


def id_template_score(scans: DataFrame, templates: list[dict]) -> DataFrame:
    """scan_id, template_index, score for every scan and template."""
    return with_id_scores(scans, templates).select("scan_id", F.explode("scores").alias("s")).select("scan_id", "s.template_index", "s.score")


def process_id_documents(scans: DataFrame, templates: list[dict]) -> DataFrame:
    """scan_id, template_index, format, format_id, score and the four fields; the first of equal scores above 0 wins, without one there is no row."""
    rows = with_id_scores(scans.where("blocks IS NOT NULL"), templates)
    best = F.array_max(F.transform("scores", lambda s: F.struct(s["score"].alias("score"), (-s["template_index"]).alias("last"))))
    rows = once(rows, "best", let(best, lambda b: F.when(b["score"] > 0, b)))
    index = -F.col("best.last")
    of = lambda key, kind: F.create_map(*(F.lit(x) for t in templates for x in (t["template_index"], t[key])))[index] if templates else F.lit(None).cast(kind)
    return rows.where("best IS NOT NULL").select("scan_id", index.alias("template_index"), of("format", "string").alias("format"), of("format_id", "int").alias("format_id"), F.col("best.score").alias("score"), *FIELDS)


def best_id_template(scans: DataFrame, templates: list[dict]) -> DataFrame:
    """scan_id, template_index, score of the best template."""
    return process_id_documents(scans, templates).select("scan_id", "template_index", "score")
