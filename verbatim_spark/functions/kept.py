"""Tables kept between jobs in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own, removed at the end, only where
    that is unset, as in tests on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = tempfile.mkdtemp(prefix="verbatim-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back. Later jobs read files
    that outlive any executor, and the plan behind them is cut off. What nothing
    reads any more can be given to ``drop``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def drop(kept: DataFrame) -> None:
    """Deletes a kept table that no plan in use reads."""
    spark = kept.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(kept.kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
