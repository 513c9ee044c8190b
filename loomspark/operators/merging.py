"""Snapshot merges: upserts, replaced sets, guarded appends, due rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import last_writes
from .recurrence import occurrences, rolled

__all__ = ["attach_if_none", "due_sources", "insert_missing", "occurrences", "replace_sets", "rolled", "upsert"]


def upsert(old: DataFrame, batch: DataFrame, key: list[str], seq: str, overwrite_nulls: bool = True) -> DataFrame:
    """The new snapshot: the last write of each key over the old row; with overwrite_nulls absent values clear old ones.

    A batch merged twice changes nothing more.
    """
    new = last_writes(batch, key, seq).drop(seq)
    values = [c for c in old.columns if c not in key]
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("_new"))
    on = [F.col(c) == F.col(f"n_{c}") for c in key]
    joined = old.withColumn("_old", F.lit(True)).join(n, on, "full")
    pick = lambda c: F.when(F.col("_new"), F.col(f"n_{c}") if overwrite_nulls else F.coalesce(F.col(f"n_{c}"), F.col(c))).otherwise(F.col(c))
    return joined.select(*[F.coalesce(F.col(c), F.col(f"n_{c}")).alias(c) for c in key], *[(pick(c) if f"n_{c}" in n.columns else F.col(c)).alias(c) for c in values])


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and the rows of new whose key is not there yet, each key once."""
    fresh = new.dropDuplicates(key).join(old.select(*key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def replace_sets(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Link rows where owners named in new have exactly new's links, and the others theirs."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new.distinct())


def attach_if_none(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Link rows where owners without any link get new's."""
    return old.unionByName(new.join(old.select(owner).distinct(), owner, "left_anti").distinct())


def due_sources(sources: DataFrame, as_of: Column) -> DataFrame:
    """Active sources with an owner that were never crawled or whose period has passed."""
    passed = F.col("last_crawled_at") + F.make_dt_interval(F.col("crawl_period_days")) <= as_of
    return sources.filter(F.col("is_active") & F.col("deleted_at").isNull() & F.col("organizer_id").isNotNull() & (F.col("last_crawled_at").isNull() | passed))
