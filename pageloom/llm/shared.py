"""Session facts that several operators need: the shared folder, table paths, sizes."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pageloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Tables:
    """Written tables that cut lineage: they outlive any executor, and go when ``drop`` is called. Those that a result is read from stay until the
    driver ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at = spark, f"{folder(spark)}/tables-{uuid.uuid4().hex}"
        atexit.register(_remove, self.at)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self) -> None:
        """Lets the driver notice plans that are gone, so that their shuffle files are removed. Listeners hold a plan until they have heard of its
        end, a little after a write returns; so this is done twice."""
        gc.collect()
        for _ in range(2):
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)


def _remove(at: str) -> None:
    """Deletes a folder when the driver ends, if it still has a session or the folder is its own machine's."""
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            return
    except Exception:  # noqa: BLE001  the gateway may be gone
        pass
    if at.startswith(("file:", "/")):
        shutil.rmtree(at.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_id(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that most scans need, under fixed names."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
