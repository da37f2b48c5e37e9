"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode, where all is one machine, is a folder made and set if the session names none."""
    known = spark.conf.get("spark.checkpoint.dir", "")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = f"file://{tempfile.mkdtemp(prefix='citeloom-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def fresh_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/citeloom-scratch/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, its lineage cut, no executor's loss undoes it."""
    path = fresh_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the table behind a written frame that nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/citeloom-scratch/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)
