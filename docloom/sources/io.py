"""Sources and sinks of capture tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType

from docloom.schemas import SCAN, TEMPLATE


def read_scans(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Scans from JSON: one object a line, or (multi_line) files that hold an array. Missing parts are null."""
    return spark.read.schema(SCAN).option("multiLine", multi_line).json(path)


def _reason(raw: Column) -> Column:
    body = F.rtrim(F.regexp_replace(raw, r"\s+$", ""))
    return F.when(F.try_parse_json(raw).isNotNull(), "wrong type").when(body.rlike(r"^\s*[\[{]") & ~body.rlike(r"[\]}]$"), "cut off").otherwise("not JSON")


def _read_checked(records: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the schema, rejects: file, position, reason, raw) from rows file, position, raw."""
    parsed = records.withColumn("r", F.from_json("raw", f"struct<{schema},__bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull()
    good = parsed.where(~bad).select("position", "r.*").drop("__bad")
    return good, parsed.where(bad).select("file", "position", _reason(F.col("raw")).alias("reason"), "raw")


def _records(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """file, position, raw: every record of JSON files. An array file that isn't JSON is one record, at position null."""
    if not multi_line:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.lit(None).cast("int").alias("position"), F.col("value").alias("raw"))
        return lines.where(F.trim("raw") != "")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parts = F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", "array<string>"))
    found = files.select("file", "value", parts.alias("p")).select("file", "value", F.col("p").isNull().alias("whole"), F.posexplode_outer("p").alias("position", "raw"))
    return found.where("whole OR raw IS NOT NULL").select("file", F.when(~F.col("whole"), F.col("position")).alias("position"), F.when(F.col("whole"), F.col("value")).otherwise(F.col("raw")).alias("raw"))


def read_scans_checked(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scans, rejects): like read_scans, but records that aren't JSON, are cut off, or have a part of a wrong type don't become rows
    of nulls: they are told with their file, their reason and the raw text. Empty lines are no records."""
    good, bad = _read_checked(_records(spark, path, multi_line), SCAN)
    return good.drop("position"), bad.drop("position")


def read_templates_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(templates, rejects): like read_templates; a broken template leaves the others and their indexes as they are."""
    good, bad = _read_checked(_records(spark, path, True), TEMPLATE.removeprefix("struct<").removesuffix(">"))
    return good.withColumnRenamed("position", "template_index"), bad


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """template_index (place in the array, from 0) and the template's fields, from a file with one JSON array."""
    whole = spark.read.text(path, wholetext=True)
    each = whole.select(F.posexplode(F.from_json("value", f"array<{TEMPLATE}>")).alias("template_index", "t"))
    return each.select("template_index", "t.*")


def read_images(spark: SparkSession, path: str, drop_bad: bool = False) -> DataFrame:
    """image_id (hash of the path), image, error ("IMAGE_DECODE" for a file that isn't one, unless dropped)."""
    rows = spark.read.format("image").option("dropInvalid", drop_bad).load(path)
    return rows.select(F.xxhash64("image.origin").alias("image_id"), "image", F.when(F.col("image.mode") < 0, "IMAGE_DECODE").alias("error"))


def decode_base64(df: DataFrame, column: str, to: str = "data") -> DataFrame:
    """df with the bytes of a base64 column, a leading data URI stripped; null and is_bad where it doesn't decode."""
    body = F.regexp_replace(F.col(column), r"^data:image/[A-Za-z0-9.+-]+;base64,", "")
    out = df.withColumn(to, F.try_to_binary(body, F.lit("base64")))
    return out.withColumn("is_bad", F.col(column).isNotNull() & F.col(to).isNull())


#: The built-in anchors (name, position, offsets in pixels, share of the document's width and height).
ANCHORS = (("ashoka_emblem", "top-left", 30.0, 20.0, 0.08, 0.12), ("aadhaar_logo", "top-right", 150.0, 20.0, 0.06, 0.10))
#: Rows of a configuration table (templates, anchors) that may be read to the driver.
MOST_CONFIGS = 1000


def few_rows(df: DataFrame, what: str, most: int = MOST_CONFIGS) -> list[Row]:
    """The rows of a configuration table; one with more than `most` is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}: a configuration is meant to be a small table")
    return rows


def builtin_anchors(pictures: DataFrame) -> DataFrame:
    """The built-in anchors with their pictures (name, image), config_pos 0 and 1; one without a readable picture is left out."""
    rows = [(k, *a) for k, a in enumerate(ANCHORS)]
    known = pictures.sparkSession.createDataFrame(rows, "config_pos int, name string, position string, offset_x double, offset_y double, doc_width_ratio double, doc_height_ratio double")
    return normalize_anchor_configs(pictures.select("name", "image").join(F.broadcast(known), "name"))


def normalize_anchor_configs(anchors: DataFrame) -> DataFrame:
    """Anchors with their defaults: offsets 0, ratios 0.1; those whose picture can't be read are dropped."""
    defaults = {"offset_x": 0.0, "offset_y": 0.0, "doc_width_ratio": 0.1, "doc_height_ratio": 0.1}
    return anchors.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in defaults.items()}).where("image IS NOT NULL AND image.height > 0")


def results_to_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Every row as one JSON string."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def write_results(df: DataFrame, path: str, by: str | Column = "format", mode: str = "errorifexists") -> None:
    """Parquet, one folder for each format."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def write_batch(df: DataFrame, batch_id: int, path: str, by: str = "format") -> None:
    """A micro-batch of results, once: its folder is written anew whenever the batch is replayed, and counts only when it is listed
    as committed, which is the last step."""
    write_results(df, f"{path}/results/batch_id={batch_id}", by, "overwrite")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/results/batch_id={batch_id}").count()
    df.sparkSession.createDataFrame([(rows,)], "rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/committed/batch_id={batch_id}")


def write_stream(results: DataFrame, path: str, checkpoint: str, by: str = "format") -> DataStreamWriter:
    """A stream of results into such batches; start() it."""
    return results.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch_id: write_batch(df, batch_id, path, by))


def read_batches(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The results of all committed batches, with batch_id."""
    wide = StructType([*(schema if isinstance(schema, StructType) else StructType.fromDDL(schema)), StructField("batch_id", LongType())])
    committed = spark.read.schema("rows long, batch_id long").parquet(f"{path}/committed")
    return spark.read.schema(wide).parquet(f"{path}/results").join(F.broadcast(committed.select("batch_id")), "batch_id", "left_semi")  # a row a micro-batch
