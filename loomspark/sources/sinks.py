"""Writers: split tables, JSON lines, manifests, model weights, cached indexes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists


def save_table(df: DataFrame, path: str, split: str | None = "split") -> None:
    """Parquet; by split, so that reading one split reads only its files."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(split) if split and split in df.columns else writer).parquet(path)


def save_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_predictions(df: DataFrame, path: str, model: str) -> None:
    """Predictions as the harness reads them."""
    save_jsonl(df.select(F.col("id").alias("instance_id"), F.col("patch").alias("model_patch"), "patch", F.lit(model).alias("model_name_or_path")), path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text of the driver's, through Spark's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def save_manifest(spark: SparkSession, path: str, values: dict) -> None:
    write_text(spark, path, json.dumps(values, ensure_ascii=False, indent=2))


def save_run_manifest(spark: SparkSession, path: str, values: dict) -> None:
    """key=value lines, with Spark's version and settings."""
    conf = {f"conf.{k}": v for k, v in spark.sparkContext.getConf().getAll()}
    write_text(spark, path, "".join(f"{k}={v}\n" for k, v in sorted({"spark.version": spark.version, **conf, **values}.items())))


def save_weights(weights: DataFrame, path: str, buckets: int) -> None:
    """A model's weights (bucket -1: the bias) with its number of buckets."""
    weights.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> tuple[DataFrame, float, int]:
    """Weights, bias and number of buckets."""
    saved = spark.read.parquet(path)
    head = saved.where("bucket = -1").first()
    if head is None:
        raise ValueError(f"no model in {path}")
    return saved.where("bucket >= 0").select("bucket", "weight"), head.weight, head.buckets


def repository_signature(files: DataFrame) -> str:
    """A hash of paths, times and sizes (columns of the repository source), whatever their order: two sums over the files' hashes, and their number."""
    part = lambda *seed: F.xxhash64(*seed, "path", "changed", "n_bytes")
    row = files.agg(F.count("*").alias("n"), F.bit_xor(part()).alias("x"), F.sum(part(F.lit("second")).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{row.n}|{row.x}|{row.s}".encode()).hexdigest()


def cached_table(spark: SparkSession, root: str, signature: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table kept under its signature: built and written once, read afterwards."""
    path = f"{root}/{signature}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
