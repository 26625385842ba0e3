"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, name: str = "veilwork", **settings: str) -> SparkSession:
    """A session with the settings the jobs expect; the cluster's own settings win elsewhere."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **settings}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local session may go without that setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="veilwork-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write a result once to the work folder and go on from there; ``paths`` gets the folder.

    What is staged may hold originals in clear text, so the caller should drop the folders when done.

    For frames that several branches of a plan are built on: detection is the costly part and must
    not be planned into each branch. Readers of the written table also survive lost executors
    without running it again.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.parquet(path)
