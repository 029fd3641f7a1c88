"""What identity cards ask of texts: read from rows and inside the row, and tables dealt to tasks by their rows."""

import re

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import identity, matching
from docloom.plans import derived, documents

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  ", "Asha Rao", "  Asha  Rao \n", "x\nRavi Kumar Das", "Gov-ern.ment of India", "GO VERNMENT", "proo_f", "péroof", "scan,ning", "1234 5678 9012\n", " Male　", "123456AB9", "Aadhaar 2012"]
BLOCKS = "scan_id long, block_pos int, text string, left double, top double, right double, bottom double"


def test_cards_by_row_and_in_the_row(spark):
    """The same fields, flags and scores from cards read from rows, which blocks carry, as from those worked out in nested blocks."""
    odd = spark.createDataFrame([(-1 - k // 3, k % 3, t, 10.0 + k, 9.0, 40.0, 80.0) for k, t in enumerate(ODD)] + [(-90, None, None, None, None, None, None)], BLOCKS)
    blocks = documents.scan_blocks(spark, SF).unionByName(odd)
    plain, carried = matching.nest(blocks), matching.nest(identity.read_blocks(blocks))
    assert "card" in carried.selectExpr("blocks[0] AS b").schema["b"].dataType.names
    for of in (identity.extract_identity_fields, identity.scan_layout_flags, lambda s: identity.id_template_score(s, derived.TEMPLATES), lambda s: identity.process_id_documents(s, derived.TEMPLATES)):
        want = sorted(map(str, of(plain).collect()))
        assert len(want) > 1000 and sorted(map(str, of(carried).collect())) == want
    flat = sorted(map(str, identity.extract_identity_fields_flat(blocks.where("block_pos IS NOT NULL")).collect()))
    assert flat == sorted(map(str, identity.extract_identity_fields(carried.where("scan_id <> -90")).collect()))


def test_cheaper_tests_of_texts(spark):
    """Boilerplate, trimming and names by one search first, against the plain definitions."""
    rows = spark.createDataFrame([(t,) for t in ODD], "text string")
    cleaned = F.regexp_replace(F.lower("text"), r"[^A-Za-z0-9_\s]", "")
    told = rows.select("text", T.is_boilerplate(F.col("text")).alias("b"), F.coalesce(cleaned.rlike("|".join(T.BOILERPLATE)), F.lit(False)).alias("b2"), T.trimmed_column(F.col("text")).alias("t"), T.trimmed(F.col("text")).alias("t2"), T.extract_name(F.col("text")).alias("n"))
    names = {"Asha Rao": "Asha Rao", "GO VERNMENT": "GO VERNMENT", "  Asha  Rao \n": "Asha  Rao", "x\nRavi Kumar Das": "Ravi Kumar Das"}
    for r in told.collect():
        assert r.b == r.b2 and r.t == r.t2 and r.n == names.get(r.text), r
    assert any(re.search("ment", r.text or "") and r.b for r in told.collect())


def test_tasks_grow_with_rows(spark, tmp_path):
    """A small file of many rows goes to as many tasks as its rows ask for, not to one for each core."""
    spark.range(derived.TASK_ROWS * 9).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert derived.spread(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() == 9


def test_tasks_fill_the_cores(spark, tmp_path):
    """Tables dealt by a key go to whole rounds of the cores."""
    spark.range(derived.TASK_ROWS * 4 + 1).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert derived.spread(spark.read.parquet(str(tmp_path / "t")), "id").rdd.getNumPartitions() == 8
