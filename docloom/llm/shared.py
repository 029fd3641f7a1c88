"""Written tables and small helpers used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.folders import clear, new_folder, shared_dir, written  # noqa: F401

#: Rows of a few numbers that a join may send to every task; more are met by a shuffle join.
SENT_ROWS = 2_000_000
#: Rows of texts that go to a Python worker at once.
ARROW_ROWS = 1500
#: Words of a text, as the operators count them.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows, where the session has more: a batch of long texts is held several times, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residue(col: str, base: int) -> Column:
    """crc32 of an id as text, modulo base: how rows are held out."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(base))


def sent_if_few(df: DataFrame) -> DataFrame:
    """A written table of ids and numbers, marked for broadcast if it has at most SENT_ROWS rows."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def with_row_ids(docs: DataFrame, id: str = "doc_id") -> tuple[DataFrame, str]:
    """docs and the name of a column that tells its rows apart: the id itself, or, where ids are null or repeat, a
    copy in which every null and every repetition has a number above all ids (one of equal ids keeps it).

    Rows are numbered where they lie, so that texts cross no shuffle and no id draws rows to one task."""
    ids = docs.agg(F.count("*").alias("rows"), F.count_distinct(id).alias("ids"), F.max(id).alias("top")).first()
    if ids.rows == ids.ids:
        return docs, id
    rows = written(docs.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    twice = rows.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("__twice")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    joined = rows.join(sent_if_few(written(twice, "repeated")), F.col(id) == F.col("__twice"), "left")
    own = F.col(id).isNotNull() & (F.col("__first").isNull() | (F.col("__first") == F.col("__at")))
    unique = F.when(own, F.col(id)).otherwise((ids.top or 0) + 1 + F.col("__at"))
    return joined.withColumn("__row", unique.cast("long")).drop("__at", "__twice", "__first"), "__row"
