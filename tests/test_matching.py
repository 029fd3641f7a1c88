"""Rules and templates: the worked example, every kind of bonus and post-processing, ties, and odd input."""

import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.rules import checked_rules, rule_confidence, rule_extract
from docloom.operators import facts, picking
from docloom.operators import matching as M
from docloom.operators import scans as S
from docloom.plans import documents
from docloom.schemas import SCAN as SCAN_SCHEMA
from docloom.sources import io
from docloom.sources.folders import written

BOX = "struct<left:double,top:double,right:double,bottom:double>"
SCAN = f"scan_id long, blocks array<struct<text:string,boundingBox:{BOX}>>"
NUMBER = {"patterns": [r"(\d{4})\s*(\d{4})\s*(\d{4})"], "confidenceScoring": {"baseScore": 0.5, "patternMatchBonus": 0.3, "validationPassBonus": 0.2}, "validation": {"length": 12}, "extractionStrategy": {"type": "multiCapture", "combineGroups": "spaceDelimited"}}
TEMPLATE = {
    "template_index": 0, "format": "card", "format_id": 3, "rules": {"user_aadhar_no": NUMBER},
    "blocks": [{"text": "", "blockType": "user_full_name", "boundingBox": {"left": 100.0, "top": 100.0, "right": 300.0, "bottom": 140.0}}, {"text": "", "blockType": "user_aadhar_no", "boundingBox": {"left": 100.0, "top": 300.0, "right": 400.0, "bottom": 340.0}}],
}
BLOCKS = [("Asha Rao", (120.0, 110.0, 320.0, 150.0)), ("123412341234", (110.0, 310.0, 410.0, 350.0)), ("Government of India", (200.0, 20.0, 500.0, 50.0))]


def test_worked_example(spark):
    scan = spark.createDataFrame([(1, BLOCKS), (2, []), (3, None)], SCAN)
    r = M.process_documents(scan, [TEMPLATE]).collect()
    assert len(r) == 1 and r[0].match_score == pytest.approx(0.792889, abs=1e-6) and r[0].format == "card" and r[0].format_id == 3
    assert r[0].fields == {"user_full_name": "Asha Rao", "user_aadhar_no": "1234 1234 1234"} and r[0].matched == ["user_full_name", "user_aadhar_no"]
    s = M.scored(scan.where("scan_id = 1"), [TEMPLATE]).first()
    assert (s.structure, s.content) == (pytest.approx(0.816111, abs=1e-6), pytest.approx(0.7))
    assert {r.scan_id: r.outcome for r in M.judged_documents(scan, [TEMPLATE]).collect()} == {1: "matched", 2: "no_blocks", 3: "no_blocks"}


def test_ties_negative_and_nothing(spark):
    scan = spark.createDataFrame([(1, BLOCKS), (2, [("far away", (9000.0, 9.0, 9100.0, 20.0))])], SCAN)
    twice = [TEMPLATE | {"template_index": 5}, TEMPLATE | {"template_index": 2}]
    assert {r.scan_id: r.template_index for r in M.best_template(scan, twice).collect()} == {1: 2}
    assert M.structural_similarity(scan, [TEMPLATE]).where("scan_id = 2").collect()[0].similarity < 0
    assert M.process_documents(scan, []).collect() == []
    same = spark.createDataFrame([(1, [(b["text"], tuple(b["boundingBox"].values())) for b in TEMPLATE["blocks"]])], SCAN)
    assert M.structural_similarity(same, [TEMPLATE]).collect()[0].similarity == pytest.approx(1)


def many_templates(n, seed=1):
    """Templates with random layouts and one of a few sets of rules; some have no boxes, some no blocks."""
    rng, out = random.Random(seed), []
    rules = [{}, {"user_aadhar_no": NUMBER}, documents.TEMPLATES[0]["rules"]]
    for k in range(n):
        blocks = []
        for _ in range(rng.randint(0 if k % 50 == 0 else 1, 9)):
            left, top = rng.uniform(0, 900), rng.uniform(0, 700)
            box = {"left": left, "top": top, "right": left + 100, "bottom": top + 30} if k % 70 else None
            blocks.append({"text": "", "blockType": rng.choice(["user_full_name", "user_aadhar_no", "user_dob", "other", None]), "boundingBox": box})
        out.append({"template_index": k, "format": f"f{k % 5}", "format_id": k, "blocks": blocks, "rules": rng.choice(rules)})
    return out


def test_index_against_all_templates(spark):
    """The same winners and scores as all pairs give, from a few templates a scan, under a plan that doesn't grow."""
    scans = documents.nested(spark, "/root/testdata/sf0.001").where("scan_id % 5 = 0")
    templates = many_templates(10_000)
    got = {r.scan_id: (r.template_index, r.score) for r in M.best_template(scans, templates).collect()}
    book = M.RuleBook(templates)
    index = M.TemplateIndex(templates, book)
    rows = M._measured(scans, book).select("scan_id", "__l.avg_x", "__l.left_ratio", "__l.n", "__best").collect()
    layouts, fits = np.array([(r.avg_x, r.left_ratio, r.n) for r in rows], float), np.array([r["__best"] for r in rows])
    content = index.contents(fits)
    for k, r in enumerate(rows):
        scores = index._layout(layouts[k][None], index.points) * 0.8 + content[k, index.signature] * 0.2
        assert got[r.scan_id] == (int(index.index[scores.argmax()]), scores.max())
    found, _, met = index.best(layouts, fits)
    assert (found >= 0).all() and met < len(rows) * len(templates) * 0.05
    plan = lambda ts: len(M.process_documents(scans, ts)._jdf.queryExecution().optimizedPlan().toString())
    assert plan(templates) < 1.2 * plan(templates[:200])


def test_index_agrees_with_columns(spark):
    scans, templates = documents.nested(spark, "/root/testdata/sf0.001").where("scan_id % 40 = 0"), many_templates(120, 3)
    best = {}
    for r in M.scored(scans, templates).collect():
        best[r.scan_id] = max(best.get(r.scan_id, (0, 0)), (round(r.score, 9), -r.template_index))
    got = {r.scan_id: (round(r.score, 9), -r.template_index) for r in M.best_template(scans, templates).collect()}
    assert got == {k: v for k, v in best.items() if v[0] > 0}


def test_facts_by_text_and_by_row(spark, monkeypatch):
    """The same results from facts of distinct texts (sent, and met by a shuffle with hot texts apart) as from facts worked out in the row."""
    blocks = documents.scan_blocks(spark, "/root/testdata/sf0.001").unionByName(spark.createDataFrame([(-1, 0, None, 1.0, 1.0, 2.0, 2.0), (-1, 1, "", 1.0, 1.0, 2.0, 2.0), (-2, None, None, None, None, None, None)], "scan_id long, block_pos int, text string, left double, top double, right double, bottom double"))
    rows = lambda scans: sorted(map(tuple, documents.flat_results(M.process_documents(scans, documents.TEMPLATES)).collect()))
    want = rows(M.nest(blocks))
    assert len(want) > 1000 and rows(M.nest(blocks, documents.TEMPLATES)) == want
    monkeypatch.setattr(facts, "SENT_TEXTS", 0)
    monkeypatch.setattr(facts, "HOT", 0.01)
    assert rows(M.nest(blocks, documents.TEMPLATES)) == want


def test_outcomes_in_one_pass(spark):
    scans = spark.createDataFrame([(1, BLOCKS), (2, []), (3, None), (4, [("far away", (90000.0, 9.0, 90100.0, 20.0))])], SCAN)
    results, others = M.split_documents(scans, [TEMPLATE])
    assert [r.scan_id for r in results.collect()] == [1] and {(r.scan_id, r.outcome) for r in others.collect()} == {(2, "no_blocks"), (3, "no_blocks"), (4, "no_fit")}
    assert {r.outcome for r in M.split_documents(scans, [TEMPLATE | {"blocks": []}])[1].collect()} == {"no_blocks", "no_template"}


def test_merged_report(spark):
    """The parts of two halves add up to the report of the whole, by day too."""
    results = M.process_documents(documents.nested(spark, "/root/testdata/sf0.001"), documents.TEMPLATES).withColumn("day", F.col("scan_id") % 3)
    results = written(results, "results")
    halves = [M.report_parts(results.where(f"scan_id % 2 = {k}"), "day") for k in (0, 1)]
    tell = lambda df: sorted((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, df.collect()))
    want = tell(M.extraction_report(results, "day"))
    assert len(want) > 20 and tell(M.report_of(M.merged_parts(*halves))) == want == tell(M.report_of(halves[0].unionByName(halves[1])))


def test_scans_across_batches(spark, monkeypatch):
    """Batches of two rows, and few pairs at once, cut scans apart: the same results; odd boxes and blocks are told as they were."""
    nan, box = float("nan"), (120.0, 110.0, 320.0, 150.0)
    odd = [(1, BLOCKS), (2, []), (3, None), (4, [None, ("Asha Rao", None), ("Asha Das", (120.0, None, 320.0, 150.0)), (None, box)]), (5, [("Asha Rao", box), ("Omar Rao", (nan, 110.0, 320.0, 150.0))])]
    scans = spark.createDataFrame(odd, SCAN).unionByName(documents.nested(spark, "/root/testdata/sf0.001").where("scan_id % 20 = 9").selectExpr("scan_id + 100 AS scan_id", "blocks"))
    tell = lambda: sorted((str(r) for r in M.judged_documents(scans.coalesce(1), [TEMPLATE, *documents.TEMPLATES]).collect()))
    want = tell()
    assert len(want) == scans.count() and {r.scan_id: r.fields for r in M.process_documents(scans, [TEMPLATE]).where("scan_id IN (4, 5)").collect()} == {4: {"user_full_name": "Asha Rao", "user_aadhar_no": "Asha Rao"}, 5: {"user_full_name": "Omar Rao", "user_aadhar_no": "Omar Rao"}}
    monkeypatch.setattr(picking, "PAIRS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert tell() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_are_not_shuffled(spark):
    """Orders are dealt by their key; what is derived of them, and the facts of their texts, meets no shuffle."""
    plan = documents.l6_process_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_spaces_of_all_kinds(spark):
    """Texts of printable ASCII take a shorter way than others: both as the longer way has it."""
    texts = ["", " ", "a", " a  b ", "a\tb", "\u00a0a\u2003b c", "mr ravi_x 3y", "é a", "A-b c", "x\n", "a:b  c*"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    clean, none = {"postProcess": {"capitalizeEachWord": True, "cleanText": True}}, {"postProcess": {"removeSpaces": True}}
    got = rows.select("t", T.n_words(F.col("t")).alias("n"), F.size(T.words(F.col("t"))).alias("m"), rule_extract(F.col("t"), clean).alias("c"), rule_extract(F.col("t"), none).alias("s")).collect()
    assert [r.n for r in got] == [r.m for r in got]
    space = re.compile(T.SPACE.replace("\\s", "\\t\\n\\f\\r "))
    for r in got:
        t = re.sub(f"^{space.pattern}+|{space.pattern}+$", "", r.t)
        up = re.sub(r"(?<![A-Za-z0-9_])[a-z]", lambda m: m[0].upper(), t)
        kept = re.sub(r"[^A-Za-z0-9_ .,\-/]", "", space.sub(" ", re.sub(f"{space.pattern}+", " ", up)))
        assert r.c == re.sub("^ +| +$", "", kept) and r.s == space.sub("", t), r


def confidence(spark, text, rule):
    return spark.createDataFrame([(text,)], "t string").select(rule_confidence(F.col("t"), rule)).collect()[0][0]


@pytest.mark.parametrize(
    "text,rule,want",
    [
        (None, None, 0), ("  ", {"patterns": ["x"]}, 0), ("a", None, 0.1), ("ab", None, 0.4), ("a" * 201, None, 0.3), ("abc", {"patterns": []}, 0.5),
        ("abc", {"confidenceScoring": {"baseScore": 0}}, 0.5), ("ABC d", {"patterns": ["zz", "abc"], "confidenceScoring": {"baseScore": 0.1, "patternMatchBonus": 0.2, "formatMatchBonus": 0.15}}, 0.45),
        ("one two three", {"confidenceScoring": {"baseScore": 0.1, "wordCountBonus": {"3": 0.3, "2": 0.9}}}, 0.4), ("a1b22", {"confidenceScoring": {"baseScore": 0.1, "digitCountBonus": {"3": 0.2}}}, 0.3),
        ("male", {"validation": {"allowedValues": ["MALE"]}, "confidenceScoring": {"baseScore": 0.1, "exactMatchBonus": 0.4}}, 0.5), ("Date of Birth", {"validation": {"mustContain": ["date", "birth"]}, "confidenceScoring": {"baseScore": 0.1, "keywordMatchBonus": 0.4}}, 0.5),
        ("HELLO, X", {"confidenceScoring": {"baseScore": 0.1, "allCapsBonus": 0.2, "commaBonus": 0.1, "lengthBonus": 0.05}}, 0.45), ("on 1/2/1990", {"confidenceScoring": {"baseScore": 0.1, "dateFormatBonus": 0.2}}, 0.3),
        ("one two", {"validation": {"minWords": 3}, "confidenceScoring": {"baseScore": 0.1, "validationPassBonus": 0.2}}, 0.1), ("one two", {"validation": {"maxWords": 2, "minLength": 7, "maxLength": 7}, "confidenceScoring": {"baseScore": 0.1, "validationPassBonus": 0.2}}, 0.3),
        ("x", {"confidenceScoring": {"baseScore": 0.9, "lengthBonus": 0.5}}, 1.0),
    ],
)
def test_confidence(spark, text, rule, want):
    assert confidence(spark, text, rule) == pytest.approx(want)


@pytest.mark.parametrize(
    "text,rule,want",
    [
        (" a b ", None, "a b"), ("", {"patterns": ["x"]}, ""), ("No: AB12", {"patterns": [r"no:\s*(\w+)"], "extractionStrategy": {"type": "singleCapture"}}, "AB12"), ("keep me", {"patterns": [r"(z)?me"], "extractionStrategy": {"type": "singleCapture"}}, "keep me"),
        ("keep me", {"patterns": [r"(z)?me"], "extractionStrategy": {"type": "singleCapture", "fallbackToFullMatch": True}}, "me"), ("Asha 12 Rao", {"patterns": ["(.*)"], "extractionStrategy": {"type": "singleCapture", "cleanAlphabetic": True}}, "Asha Rao"),
        ("ab cd", {"patterns": ["(a)(b) (c)?"], "extractionStrategy": {"type": "multiCapture", "combineGroups": "concatenate", "groupSeparator": "-"}}, "a-b-c"), ("01021990", {"patterns": [r"(\d\d)(\d\d)(\d{4})"], "extractionStrategy": {"type": "multiCapture", "combineGroups": "dateFormat"}}, "01/02/1990"),
        ("no 1234567", {"patterns": ["no"], "extractionStrategy": {"type": "multiCapture", "fallbackToDigitsOnly": True, "formatLength": 7}}, "12 34 567"), ("no 12x34", {"patterns": ["no"], "extractionStrategy": {"type": "multiCapture", "fallbackToDigitsOnly": True, "formatLength": 7}}, "1234"),
        ("has all", {"patterns": ["H.S"], "extractionStrategy": {"type": "fullMatch"}}, "has"), ("x y", {"patterns": ["x"], "postProcess": {"standardize": "Z"}}, "Z"),
        ("Mr ravi KUMAR", {"postProcess": {"removeNoiseWords": ["mr"], "capitalizeEachWord": True}}, "Ravi KUMAR"), ("male", {"postProcess": {"normalize": {"MALE": "M", "M": "Q"}}}, "M"),
        ("1234-56789012", {"postProcess": {"format": "XXXX XXXX XXXX"}}, "1234 5678 9012"), ("01 02 1990", {"postProcess": {"convertEightDigits": True}}, "01/02/1990"), ("a  b*c ", {"postProcess": {"cleanText": True}}, "a bc"), ("a  b", {"postProcess": {"removeExtraSpaces": True}}, "a b"), ("a  b", {"postProcess": {"removeSpaces": True}}, "ab"),
    ],
)
def test_extract(spark, text, rule, want):
    assert spark.createDataFrame([(text,)], "t string").select(rule_extract(F.col("t"), rule)).collect()[0][0] == want


def test_bad_pattern_is_left_out(spark):
    rules = checked_rules({"x": {"patterns": ["(", "ok"]}})
    assert rules["x"]["patterns"] == ["ok"] and confidence(spark, "ok", rules["x"]) == 0.5


def test_letters_of_lines(spark):
    """Letters are code points, whatever an array's offset; lists and texts may be null or empty."""
    letters = lambda w: [{"text": c} for c in w]
    lines = lambda t: t if t is None else [{"text": w, "elements": letters(w)} for w in t.split(" ")]
    lists = [["left out"], ["ab cd", None, "", " x"], None, [], ["é 😀z", "日本 語"], [None]]
    want = [x if x is None else [{"text": t, "lines": lines(t)} for t in x] for x in lists]
    assert documents.in_letters(pa.array(lists, pa.list_(pa.string()))).to_pylist() == want
    assert documents.in_letters(pa.array(lists, pa.list_(pa.string())).slice(1)).to_pylist() == want[1:]
    for few in ([], [None], [[]], [[None]]):
        assert documents.in_letters(pa.array(few, pa.list_(pa.string()))).to_pylist() == [x if x is None else [{"text": None, "lines": None} for _ in x] for x in few]


def test_letters_without_lambdas(spark):
    """No lambda makes letters: each level of nesting copied them anew."""
    plan = documents.p2_explode_elements(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "in_letters" in plan and "sequence(" not in plan


def test_complaints_by_plain_walk(spark):
    """Complaints of a batch against a walk through each scan; parts, boxes, sides and lists are missing at random."""
    rnd = random.Random(3)
    maybe = lambda v, p=0.2: None if rnd.random() < p else v
    box = lambda: maybe({s: maybe(1.0, 0.1) for s in ("left", "top", "right", "bottom")})
    part = lambda **more: maybe({"text": maybe("t"), "boundingBox": box(), "cornerPoints": maybe([{"x": 1.0, "y": 2.0}] * rnd.randrange(2)), **more}, 0.1)
    some = lambda of, most: maybe([of() for _ in range(rnd.randrange(most))])
    rows = [(i, maybe("x"), some(lambda: part(lines=some(lambda: part(elements=some(part, 4)), 4)), 13)) for i in range(300)] + [(300, None, None), (301, "x", [])]

    def walk(item, whole, place, children):
        if item is None:
            return [whole]
        b = item["boundingBox"]
        bad = [(b is None or None in b.values(), "Invalid boundingBox in "), (item["cornerPoints"] is None, "Missing or invalid cornerPoints array in "), (item["text"] is None, "Missing or invalid text property in "), (children and item[children] is None, f"Missing or invalid {children} array in ")]
        return [m + place for is_bad, m in bad if is_bad]

    def want(text, blocks):
        found = ["Missing or invalid blocks array"] * (blocks is None) + ["Missing or invalid text property"] * (text is None)
        for i, b in enumerate(blocks or []):
            found += walk(b, f"Block {i} is not an object", f"block {i}", "lines")
            for j, x in enumerate((b or {}).get("lines") or []):
                found += walk(x, f"Line {j} in block {i} is not an object", f"line {j} of block {i}", "elements")
                for k, e in enumerate((x or {}).get("elements") or []):
                    found += walk(e, f"Element {k} in line {j} of block {i} is not an object", f"element {k} of line {j} in block {i}", None)
        return found

    scans = spark.createDataFrame(rows, SCAN_SCHEMA).repartition(3)
    got = {r.scan_id: (r.errors, r.is_valid) for r in S.validate_scans(scans).collect()}
    assert got == {i: (want(t, b), not want(t, b)) for i, t, b in rows}
    assert S.validate_scans(scans.where("false")).count() == 0
    assert "lambda" not in S.validate_scans(scans)._jdf.queryExecution().optimizedPlan().toString()


def test_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"blocks": [], "format": "", "formatId": 0, "textRecognition": {"blocks": [{"text": "a", "blockType": "b"}], "format": "card", "formatId": 4}}, {"textRecognition": {"blocks": [{"text": "a", "blockType": "b"}]}}]))
    one, two = M.load_templates(io.read_templates(spark, str(tmp_path / "t.json")))
    assert (one["format"], one["format_id"], one["blocks"]) == ("card", 4, []) and (two["format"], two["format_id"], len(two["blocks"])) == ("unknown", 0, 1)
    (tmp_path / "s.json").write_text(json.dumps({"scan_id": 1, "text": "x", "blocks": [{"text": "a", "lines": [{"text": "l", "elements": [{"text": "e"}, None]}]}]}) + "\n" + json.dumps({"scan_id": 2}))
    scans = io.read_scans(spark, str(tmp_path / "s.json"))
    errors = {r.scan_id: r.errors for r in S.validate_scans(scans).collect()}
    assert errors[2] == ["Missing or invalid blocks array", "Missing or invalid text property"]
    assert errors[1][:2] == ["Invalid boundingBox in block 0", "Missing or invalid cornerPoints array in block 0"] and errors[1][-1] == "Element 1 in line 0 of block 0 is not an object" and "Invalid boundingBox in element 0 of line 0 in block 0" in errors[1]
    assert S.explode_elements(scans).where("scan_id = 1").count() == 2
    rows = io.decode_base64(spark.createDataFrame([("data:image/png;base64,aGk=",), ("%%",), (None,)], "b string"), "b").collect()
    assert [(r.data and bytes(r.data), r.is_bad) for r in rows] == [(b"hi", False), (None, True), (None, False)]
    faces = spark.createDataFrame([(1, 1, 0.9, 0.9, 0.9), (1, 0, 0.125, None, 0.5)], "image_id long, face_pos int, smile_prob double, left_eye_prob double, right_eye_prob double")
    assert tuple(S.first_face(faces).collect()[0]) == (1, 13, 0, 50)
