"""Shared plumbing of the corpus operators: inputs, shared storage, the held-out fold."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, that Spark hands to a Python worker at once; its own bound on rows alone lets a batch of long texts
#: take gigabytes.
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 22


def bounded_batches(spark: SparkSession) -> None:
    """Hand over small batches, where the session has Spark's defaults: results are the same, workers need less memory."""
    for key, default, ours in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", None, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) in (default, str(64 << 20), str((1 << 31) - 1), str((1 << 63) - 1)):
            spark.conf.set(key, str(ours))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (tests) uses a temporary folder, removed at its end; a cluster is
    refused, as each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"{tempfile.gettempdir()}/forerun-{spark.sparkContext.applicationId}"
    if not os.path.isdir(own):
        os.makedirs(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.step_path = path
    return out


def discard(*steps: DataFrame) -> None:
    """Remove materialised steps that nothing reads any more: what was made of them is written too."""
    for step in steps:
        path = step.sparkSession._jvm.org.apache.hadoop.fs.Path(step.step_path)
        path.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the evaluation fold: crc32 of the id as text, modulo 5, is 0 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of the learning fold, thinned by hash to about ``max_rows`` rows for each class.

    Both classes are thinned alike only beyond the bound, so small label tables are used whole. Rows whose label
    or id is null take no part; several labels of one id count as the largest.
    """
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    sizes = {r["label"]: r["n"] for r in picked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    grain = 1 << 20
    keep = F.lit(False)
    for value, n in sizes.items():
        limit = grain if n <= max_rows else int(grain * max_rows / n)
        keep = keep | ((F.col("label") == value) & (F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < limit))
    # at most about 2 * max_rows rows of two numbers: small whatever the input
    chosen = F.broadcast(picked.where(keep))
    return docs.select("doc_id", "text").join(chosen, "doc_id")
