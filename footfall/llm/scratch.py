"""Intermediate tables in the folder that driver and executors share.

Cutting lineage with a written table keeps a lost executor from costing more
than its own tasks: what was written stays readable for every later job.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Written tables after which the driver tidies up.
TIDY = 2


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a local folder in local mode and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def tidy(spark: SparkSession) -> None:
    """Let the driver forget plans, generated classes, shuffles and broadcasts of finished rounds.

    Spark drops them only once the driver's garbage is collected, which in a
    run of many small jobs comes late.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Named Parquet tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.written = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read from the shared folder."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.written += 1
        if self.written % TIDY == 0:
            tidy(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
