"""Tables between the steps of one call, in a folder of their own below the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it works below its warehouse, a cluster must name a shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return root.rstrip("/")


class Work:
    """Frames that an operator returns may read its tables, so they stay until ``close``, or until the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept = False

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def held(self) -> str:
        """The folder itself, made and marked to go when the driver ends."""
        if not self.kept:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            files = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
            files.mkdirs(p)
            self.kept = files.deleteOnExit(p)
        return self.root

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df once and returns a frame that reads it: lineage ends here."""
        df.write.mode("overwrite").parquet(self.path(name))
        self.held()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def close(self) -> None:
        """Deletes all tables of this call."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
