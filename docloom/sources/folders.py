"""The folder that driver and executors share, for tables that a job writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has made and not removed.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset and all runs in one process (tests), one of our own is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts lineage, and lost executors cost nothing that was written."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, keep: tuple[DataFrame | str, ...] = ()) -> None:
    """Remove the folders made so far, but for those in `keep` (their names, or tables read from them).

    Results are lazy: call it when what was asked for has been written or shown."""
    names = [x if isinstance(x, str) else "\n".join(x.inputFiles()) for x in keep]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in [f for f in _made if not any(f.rsplit("/", 1)[1] in x for x in names)]:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        _made.remove(folder)
