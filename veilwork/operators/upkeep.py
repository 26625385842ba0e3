"""Clean-up of written store tables: only the folders that hold rows to go are written anew or dropped."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..sources import tables as tb
from . import stores


def erase(spark: SparkSession, path: str, table: str, erased: DataFrame) -> int:
    """Delete the rows of some identities (``uuid``) from a store table; how many rows went.

    The folders that hold such rows are found first. Where the table is looked up by uuid, only the folders of the
    erased uuids are looked into at all.
    """
    gone = erased.select("uuid").distinct()
    by_uuid = tb.LOOKED_UP_BY.get(table) == ["uuid"]
    rows = tb.read_store(spark, path, table, gone if by_uuid else None)
    folder = tb.folders_of(table)[0].name
    hit = {r[folder]: r["count"] for r in rows.join(gone, "uuid", "left_semi").groupBy(folder).count().collect()}
    if hit:
        where = F.col(folder).isin(list(hit))
        kept = tb.read_store(spark, path, table).filter(where)
        tb.replace_folders(stores.erase(kept, gone).select(kept.columns), path, table, where)
    return sum(hit.values())


def expire(spark: SparkSession, path: str, table: str, now: datetime.datetime,
           days: int | None = None) -> int:
    """Delete the rows of a table by day that are older than its retention period; how many rows went.

    Folders of earlier days are dropped; the cutoff's own day is written anew if it holds earlier rows.
    """
    if days is None:
        days = vocab.AUDIT_RETENTION_DAYS if table == "audit" else vocab.RETENTION_DAYS
    cutoff = now - datetime.timedelta(days=days)
    day, at = cutoff.date(), F.lit(cutoff)
    old = tb.read_store(spark, path, table).filter(F.col("day") <= F.lit(day)).filter(F.col("created_at") < at)
    by_day = {r["day"]: r["count"] for r in old.groupBy("day").count().collect()}
    if day in by_day:
        where = F.col("day") == F.lit(day)
        kept = tb.read_store(spark, path, table).filter(where).filter(F.col("created_at") >= at)
        tb.replace_folders(kept, path, table, where)
    for d in by_day:
        if d < day:
            tb.drop_folders(spark, path, f"day={d}")
    return sum(by_day.values())


def drop_orphans(spark: SparkSession, path: str, identities: str) -> int:
    """Delete the mappings whose identity isn't registered; how many rows went."""
    registry = tb.read_store(spark, identities, "identities")
    orphans = stores.orphan_mappings(tb.read_store(spark, path, "mappings"), registry)
    return erase(spark, path, "mappings", orphans.select("uuid"))


def compact(spark: SparkSession, path: str, table: str, keys: DataFrame | None = None) -> None:
    """Write the folders of a mapping or identity table (of some keys, or all) anew: few files, and each row once.

    Writers at the same time can insert a mapping twice; the earliest stays. Rows are sorted within files by what they are
    looked up by, so that readers skip row groups.
    """
    where = F.lit(True) if keys is None else F.col("bucket").isin(tb.touched_buckets(keys, table))
    rows = tb.read_store(spark, path, table).filter(where)
    if table == "mappings":
        rows = stores.dedup_mappings(rows, F.struct("created_at", "original", "fake")).select(rows.columns)
    elif table == "identities":
        first = rows.groupBy("identity", "identity_type").agg(F.min_by(F.struct(*rows.columns), F.struct(
            "created_at", "uuid")).alias("r"))
        rows = first.select("r.*")
    tb.replace_folders(rows.sort("bucket", *tb.LOOKED_UP_BY[table]), path, table, where)
