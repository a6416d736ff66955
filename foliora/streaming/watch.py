"""Folder watch and job updates as streams (an extension: the batch functions work unchanged on whole documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliora.functions.text import clean, extract_strengths
from foliora.operators.document import latest_jobs


def watch_regions(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New region files of a folder, with cleaned text and strengths; stateless, so no watermark is needed."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("clean", clean(F.col("text"))).withColumn("strengths", extract_strengths(F.col("text")))


#: Jobs are kept in so many buckets by the hash of their id; a batch rewrites only the buckets that it touches.
BUCKETS = 64


def _latest_buckets(spark: SparkSession, target: str, before: int | None = None) -> dict[int, str]:
    """Bucket to the folder of its newest finished version, of those before a batch if one is named; an absent target has none, any other failure is raised."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    newest: dict[int, tuple[int, str]] = {}
    for version in fs.listStatus(path):
        name = version.getPath().getName()
        if not name.startswith("v=") or not fs.exists(jvm.org.apache.hadoop.fs.Path(version.getPath(), "_SUCCESS")):
            continue
        v = int(name[2:])
        if before is not None and v > before:
            raise ValueError(f"{target} holds a later version than batch {before}: the stream must go on from its own checkpoint")
        if v == before:
            continue
        for b in fs.listStatus(version.getPath()):
            folder = b.getPath().getName()
            if folder.startswith("bucket="):
                k = int(folder[7:])
                if k not in newest or v > newest[k][0]:
                    newest[k] = (v, b.getPath().toString())
    return {k: folder for k, (_, folder) in newest.items()}


def read_jobs(spark: SparkSession, target: str, schema) -> DataFrame:
    """The last state of every job kept in ``target``; empty where nothing is."""
    folders = _latest_buckets(spark, target)
    return spark.read.schema(schema).parquet(*folders.values()) if folders else spark.createDataFrame([], schema)


def upsert_jobs(stream: DataFrame, target: str, checkpoint: str):
    """Keeps the last state of every job in ``target``, read by read_jobs. Each batch writes a new version of the buckets it touches beside the old ones, so a repeated batch does no harm and a failed read of old state ends the batch instead of losing it."""
    schema = stream.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).cast("int")).persist()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
        folders = _latest_buckets(spark, target, batch_id)
        old = [folders[k] for k in touched if k in folders]
        rows = new.drop("bucket")
        if old:
            rows = rows.unionByName(spark.read.schema(schema).parquet(*old))
        latest_jobs(rows).withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={batch_id}")
        new.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
