"""Structured Streaming jobs: live run log, windowed metrics, continuous import, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators import merging, reports
from loomspark.sources.snapshots import Snapshot
from loomspark.sources.tables import RUN_LOG


def live_run_log(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """Counts by tier of a growing JSON log, each organisation once within the delay."""
    rows = spark.readStream.schema(RUN_LOG).json(path).filter("org_id is not null").withWatermark("ts", delay)
    return rows.dropDuplicatesWithinWatermark(["org_id"]).groupBy("tier").agg(F.count("*").alias("n"))


def windowed_metrics(rows: DataFrame, ts: str = "ts", size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """run_metrics per window; rows later than the delay are dropped, and a window comes out once it is complete."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return reports.run_metrics(rows.withWatermark(ts, delay).withColumn("window", window), "window")


def sessions(rows: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Start, end and number of events of each key's sessions."""
    timed = rows.withWatermark(ts, delay) if rows.isStreaming else rows
    out = timed.groupBy(F.session_window(ts, gap).alias("session"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def progress(rows: DataFrame, work: DataFrame, run: str, ts: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each run's results as they are complete, with the size of the run's work list: run, start, end, n, n_items.

    work (run, item), which does not change meanwhile, is counted and joined with the stream. Runs without a list have no size.
    """
    sizes = work.select(run, "item").distinct().groupBy(run).agg(F.count("*").alias("n_items"))
    return sessions(rows, run, ts, gap, delay).join(sizes, run, "left")


def estimates(done: DataFrame, run: str, gap: str = "30 minutes") -> DataFrame:
    """What progress() has given out so far, with results so far, those pending, the rate and the minutes left.

    The rate is results a minute of working time so far: from each session's first to its last
    result (the gap at its end is no work), one second at least. Minutes left are pending results by the rate, which counts as
    a tenth a minute at least. Without a work list both are null.
    """
    w = W.partitionBy(run).orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    seconds = F.unix_micros(F.col("end") - F.expr(f"interval {gap}")) / 1e6 - F.unix_micros("start") / 1e6
    rows = done.withColumns({"done": F.sum("n").over(w), "_s": F.sum(seconds).over(w)})
    rate = F.col("done") / F.greatest(F.col("_s"), F.lit(1.0)) * 60
    pending = F.when(F.col("n_items").isNotNull(), F.greatest(F.col("n_items") - F.col("done"), F.lit(0)))
    return rows.withColumns({"pending": pending, "rate": rate, "minutes_left": pending / F.greatest(rate, F.lit(0.1))}).drop("_s")


def continuous_import(stream: DataFrame, spark: SparkSession, table: str, key: list[str], seq: str, checkpoint: str, buckets: int = 64, keep: int | None = None):
    """Merges micro-batches into a bucketed snapshot, one version for each; a replayed batch changes nothing.

    Only buckets that hold a key of the batch are read and written (key[0] deals rows into them). With `keep` the
    versions before the last so many are dropped after each batch.
    """
    store = Snapshot(spark, table, {"rows": (stream.drop(seq).schema, key[0])}, buckets)

    def merge(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            store.commit(epoch, batch.select(key[0]), lambda old: {"rows": merging.upsert(old["rows"], batch, key, seq)})
        finally:
            batch.unpersist()
        if keep is not None:
            store.drop_before(epoch - keep + 1)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def read_snapshot(spark: SparkSession, table: str, schema: str, buckets: int = 64) -> DataFrame:
    """The version of a continuous import that is in force; empty before the first."""
    return Snapshot(spark, table, {"rows": (schema, "")}, buckets).read("rows")
