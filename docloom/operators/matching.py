"""Template matching and field extraction on nested scans.

Rules become columns once (operators.facts), worked out for blocks as rows by compiled code; templates are data: a scan's
best one is found by an index (operators.templates) and its fields are picked in numpy, a batch of scans at a time
(operators.picking). A scan's blocks stay together from the generator on, so nothing is shuffled. The plan's size depends on the
number of distinct rules, not on that of templates. Flat tables of blocks are nested by one shuffle (`nest`), by none where
they lie by scan_id, with their facts where rules are given.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.rules import checked_rules
from docloom.functions.text import let, once
from docloom.operators import facts
from docloom.operators.facts import RuleBook, row_facts, with_facts
from docloom.operators.picking import Judge, measured
from docloom.operators.scans import normalize_templates
from docloom.operators.templates import TemplateIndex, content, structural, template_table  # noqa: F401
from docloom.sources.folders import written
from docloom.sources.io import MOST_CONFIGS, few_rows

#: Templates that may be read to the driver.
MOST_TEMPLATES = 200_000


def nest(blocks: DataFrame, templates: list[dict] | None = None) -> DataFrame:
    """scan_id, blocks from rows scan_id, block_pos, text, left, top, right, bottom; with templates, blocks carry the facts that
    their rules ask for, and what `identity.read_blocks` has read of them. A row without a block_pos has no block: a scan of such rows
    alone has an empty array."""
    rows = blocks if templates is None else with_facts(blocks, RuleBook(templates))
    carried = [c for c in ("facts", "card") if c in rows.columns]
    parts = ["text", F.struct("left", "top", "right", "bottom").alias("boundingBox"), *carried]
    item = F.when(F.col("block_pos").isNotNull(), F.struct("block_pos", *parts))
    ordered = F.array_sort(F.collect_list(item))
    names = ["text", "boundingBox", *carried]
    return rows.groupBy("scan_id").agg(F.transform(ordered, lambda b: F.struct(*(b[n].alias(n) for n in names))).alias("blocks"))


def load_templates(templates: DataFrame) -> list[dict]:
    """Templates as plain dicts in index order. They are configuration: read to the driver, at most MOST_TEMPLATES (checked)."""
    rows = [r.asDict(recursive=True) for r in few_rows(normalize_templates(templates).orderBy("template_index"), "templates", MOST_TEMPLATES)]
    return [r | {"rules": checked_rules(r["rules"])} for r in rows]


def center_x(box: Column) -> Column:
    return (box["left"] + box["right"]) / 2


def center_y(box: Column) -> Column:
    return (box["top"] + box["bottom"]) / 2


def layout(blocks: Column) -> Column:
    """struct<n, avg_x, avg_y, left_ratio, top_ratio> of blocks that have a whole box."""
    boxes = F.filter(F.transform(blocks, lambda b: F.struct(center_x(b["boundingBox"]).alias("x"), center_y(b["boundingBox"]).alias("y"))), lambda c: c["x"].isNotNull() & c["y"].isNotNull())

    def of(c: Column) -> Column:
        n = F.size(c)
        mean = lambda k: F.aggregate(c, F.lit(0.0), lambda a, p: a + p[k]) / n
        share = lambda k, m: F.size(F.filter(c, lambda p: p[k] < m)) / n
        means = F.struct(mean("x").alias("x"), mean("y").alias("y"))
        return F.when(n > 0, let(means, lambda m: F.struct(n.alias("n"), m["x"].alias("avg_x"), m["y"].alias("avg_y"), share("x", m["x"]).alias("left_ratio"), share("y", m["y"]).alias("top_ratio"))))

    return let(boxes, of)


def layout_features(scans: DataFrame, blocks: str = "blocks") -> DataFrame:
    """scans with n, avg_x, avg_y, left_ratio, top_ratio; nulls for a scan without boxes."""
    return once(scans, "__l", layout(F.col(blocks))).select(*scans.columns, "__l.*")


def _book(templates: list[dict]) -> RuleBook:
    book = RuleBook(templates)
    if len(book.rules) > MOST_CONFIGS:
        raise ValueError(f"more than {MOST_CONFIGS} distinct rules: each becomes a part of the plan")
    return book


def _blocks(scans: DataFrame, book: RuleBook, known: DataFrame | None = None) -> DataFrame:
    """scan_id, pos, x, y, seen, facts: the blocks of each scan in order, one row without a pos for a scan that has none. Blocks get
    their facts where they don't carry them; `known` as in facts.with_facts."""
    b = F.col("b")
    carried = "facts" in scans.selectExpr("blocks[0] AS b").schema["b"].dataType.names
    own = [F.coalesce(b["facts"], row_facts(F.lit(None).cast("string"), book)).alias("facts")] if carried else []
    rows = scans.select("scan_id", F.posexplode_outer("blocks").alias("pos", "b"))
    rows = rows.select("scan_id", "pos", center_x(b["boundingBox"]).alias("x"), center_y(b["boundingBox"]).alias("y"), b["text"].isNotNull().alias("seen"), b["text"].alias("text"), *own)
    return (rows if carried else with_facts(rows, book, known)).drop("text")


def known_facts(scans: DataFrame, templates: list[dict]) -> DataFrame | None:
    """The facts of texts that are common in a table of scans, to be used on others (a stream's)."""
    return facts.known_facts(scans.select(F.explode("blocks").alias("b")).select("b.text"), _book(templates))


def _of_ids(scans: DataFrame, more: str) -> str:
    return f"scan_id {scans.schema['scan_id'].dataType.simpleString()}, {more}"


def _measured(scans: DataFrame, book: RuleBook) -> DataFrame:
    """scan_id, __l (layout) and __best (best fit of any block, by rule) of each scan."""
    rows = _blocks(scans, book).mapInArrow(partial(measured, len(book.rules)), _of_ids(scans, "avg_x double, left_ratio double, n int, __best array<double>"))
    return rows.select("scan_id", F.struct("n", "avg_x", "left_ratio").alias("__l"), "__best")


def scored(scans: DataFrame, templates: list[dict]) -> DataFrame:
    """scan_id, template_index, structure, content, score for every scan and every template with blocks."""
    book = _book(templates)
    table = template_table(scans.sparkSession, templates, book).select("template_index", F.struct("n", "avg_x", "left_ratio", "kinds").alias("__t"))
    rows = _measured(scans, book).crossJoin(F.broadcast(table))  # what is asked for are all pairs; templates were read to the driver
    t = F.col("__t")
    pairs = rows.select("scan_id", "template_index", structural(F.col("__l"), t["n"], t["avg_x"], t["left_ratio"]).alias("structure"), content(F.col("__best"), t["kinds"]).alias("content"))
    return pairs.withColumn("score", F.col("structure") * 0.8 + F.col("content") * 0.2)


def structural_similarity(scans: DataFrame, templates: list[dict]) -> DataFrame:
    """scan_id, template_index, similarity for every scan and template with blocks."""
    return scored(scans, templates).select("scan_id", "template_index", F.col("structure").alias("similarity"))


def content_similarity(scans: DataFrame, templates: list[dict]) -> DataFrame:
    return scored(scans, templates).select("scan_id", "template_index", F.col("content").alias("similarity"))


def best_template(scans: DataFrame, templates: list[dict]) -> DataFrame:
    """scan_id, template_index, score of scans with blocks that some template fits: the highest score above 0, the lowest index among equals."""
    book = _book(templates)
    return _blocks(scans, book).mapInArrow(Judge(templates, book).chosen, _of_ids(scans, "template_index int, score double"))


def judged_documents(scans: DataFrame, templates: list[dict], known: DataFrame | None = None) -> DataFrame:
    """Every scan with its outcome: `matched`, `no_blocks` (null or empty), `no_template` (there is none with blocks) or `no_fit` (no score
    above 0); and, where matched, template_index, format, format_id, match_score, fields (map), matched (array), else nulls.

    Of typed blocks of a template, those whose best block by fit and nearness (the first of equals) has a score above 0.1 have its
    value. Of template blocks of one kind a later one overwrites the value, `matched` keeps both. `known`: see facts.with_facts."""
    book = _book(templates)
    told = "empty boolean, template_index int, format string, format_id int, match_score double, fields map<string,string>, matched array<string>"
    rows = _blocks(scans, book, known).mapInArrow(Judge(templates, book).judged, _of_ids(scans, told))
    matched = F.col("template_index").isNotNull()
    outcome = F.when(matched, "matched").when(F.col("empty"), "no_blocks").when(F.lit(not any(t["blocks"] for t in templates)), "no_template").otherwise("no_fit")
    return rows.select("scan_id", outcome.alias("outcome"), "template_index", "format", "format_id", "match_score", *(F.when(matched, F.col(c)).alias(c) for c in ("fields", "matched")))


_RESULT = ("scan_id", "template_index", "format", "format_id", "match_score", "fields", "matched")


def process_documents(scans: DataFrame, templates: list[dict], known: DataFrame | None = None) -> DataFrame:
    """scan_id, template_index, format, format_id, match_score, fields (map), matched (array): one row for each scan that has blocks and a template that fits."""
    return judged_documents(scans, templates, known).where("outcome = 'matched'").select(*_RESULT)


def split_documents(scans: DataFrame, templates: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(results, the other scans with their outcome), both read from one written table: no scan is worked on twice."""
    told = written(judged_documents(scans, templates), "judged")
    return told.where("outcome = 'matched'").select(*_RESULT), told.where("outcome <> 'matched'").select("scan_id", "outcome")


def unmatched_documents(scans: DataFrame, results: DataFrame) -> DataFrame:
    """Scans without a result."""
    return scans.join(results.select("scan_id"), "scan_id", "left_anti")


def report_parts(results: DataFrame, *by: str) -> DataFrame:
    """Sums from which a report is made: format, the columns `by` (a day, say), field, rows, filled, score. Parts of several batches,
    stored as they come, add up (`merged_parts`) to those of all."""
    # One pass: a document is a row of its own (without a field) next to its fields.
    none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    rows = results.select("format", *by, "match_score", F.explode(F.concat(none, F.coalesce(F.map_entries("fields"), F.array().cast("array<struct<key:string,value:string>>")))).alias("e"))
    return rows.groupBy("format", *by, F.col("e.key").alias("field")).agg(F.count("*").alias("rows"), F.count_if(F.col("e.value") != "").alias("filled"), F.sum("match_score").alias("score"))


def merged_parts(*parts: DataFrame) -> DataFrame:
    """The sums of several tables of parts, as parts again."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*(c for c in every.columns if c not in ("rows", "filled", "score"))).agg(*(F.sum(c).alias(c) for c in ("rows", "filled", "score")))


def report_of(parts: DataFrame) -> DataFrame:
    """format, the parts' own columns, field, documents, filled, fill_rate, mean_score."""
    keys = [c for c in parts.columns if c not in ("field", "rows", "filled", "score")]
    counts = merged_parts(parts)
    # Of a handful of rows, a format's document row tells all its field rows.
    every, document = Window.partitionBy(*keys), F.col("field").isNull()
    told = counts.withColumns({"documents": F.max(F.when(document, F.col("rows"))).over(every), "mean_score": F.max(F.when(document, F.col("score") / F.col("rows"))).over(every)})
    return told.where("field IS NOT NULL AND filled > 0 AND format IS NOT NULL").select(*keys, "field", "documents", "filled", (F.col("filled") / F.col("documents")).alias("fill_rate"), "mean_score")


def extraction_report(results: DataFrame, *by: str) -> DataFrame:
    """How often each format's documents yield each field."""
    return report_of(report_parts(results, *by))
