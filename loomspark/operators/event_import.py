"""Event import: one batch of payloads becomes rows of four tables, which change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.rules import event_status
from loomspark.sources.snapshots import Snapshot

from .merging import upsert

#: What an event keeps of its payload, besides keys and status.
KEPT = ["title", "description", "attendance_mode", "online_url", "event_page_url", "rrule_string", "target_audience", "score"]
TABLES = {
    "events": (
        "event_id string, organizer_id string, source_reference string, organization_id string, title string, description string, attendance_mode string, "
        "online_url string, event_page_url string, rrule_string string, target_audience array<string>, score double, status string",
        "event_id",
    ),
    "categories": ("event_id string, category_id string", "event_id"),
    "venues": ("event_id string, venue_id string", "event_id"),
    "instances": ("event_id string, start_datetime string, end_datetime string, status string", "event_id"),
}
PAYLOAD = (
    "seq long, organizer_id string, source_reference string, title string, description string, attendance_mode string, online_url string, event_page_url string, "
    "rrule_string string, target_audience array<string>, score double, decision string, works_with_elderly boolean, category_codes array<string>, "
    "venue_ids array<string>, start_datetime string, end_datetime string"
)


def event_id(organizer: Column, reference: Column) -> Column:
    """An id that organiser and reference alone decide, so that a replay makes no second event."""
    h = F.md5(F.concat_ws("\n", organizer, reference).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def replaced_sets(old: DataFrame, payloads: DataFrame, keys: str, known: DataFrame | None, value: str) -> DataFrame:
    """(event_id, value) links, where events whose payloads name any key have the last such payload's set and others what they had.

    known (key, value) turns keys into values; keys that it lacks go, so that a set can become empty.
    """
    named = payloads.filter(F.size(keys) > 0).groupBy("event_id").agg(F.max_by(keys, "seq").alias("_keys"))
    new = named.select("event_id", F.explode("_keys").alias("key")).filter("key is not null")
    new = new.select("event_id", F.col("key").alias(value)) if known is None else new.join(known, "key").select("event_id", value)
    return old.join(named.select("event_id"), "event_id", "left_anti").unionByName(new.distinct())


def imported(old: dict[str, DataFrame], payloads: DataFrame, organizers: DataFrame, categories: DataFrame) -> dict[str, DataFrame]:
    """The four tables after a batch.

    Of payloads with one organiser and reference the last in order of seq decides all fields (absent values
    clear old ones); status follows from decision, score and flag, and a missing decision is an acceptance.
    organizers (organizer_id, organization_id) tells which organiser is an organisation's. Category codes are codes or slugs of
    `categories` (category_id, code, slug); lists that are null or empty leave the sets alone. Each payload's
    start and end make an instance, once; without either, none. Payloads without organiser, reference or title
    are left out.
    """
    rows = payloads.filter("trim(organizer_id) <> '' and trim(source_reference) <> '' and trim(title) <> ''")
    rows = rows.withColumn("event_id", event_id(F.col("organizer_id"), F.col("source_reference")))
    status = event_status(F.col("decision"), F.col("score"), F.col("works_with_elderly"))
    owners = organizers.groupBy("organizer_id").agg(F.min("organization_id").alias("organization_id"))
    fields = rows.select("event_id", "organizer_id", "source_reference", *KEPT, status.alias("status"), "seq").join(owners, "organizer_id", "left")
    known = categories.select("category_id", F.explode(F.array_distinct(F.array_compact(F.array("code", "slug")))).alias("key")).distinct()
    made = rows.filter("start_datetime is not null and end_datetime is not null").select("event_id", "start_datetime", "end_datetime").distinct()
    fresh = made.join(old["instances"], ["event_id", "start_datetime", "end_datetime"], "left_anti").withColumn("status", F.lit("scheduled"))
    return {
        "events": upsert(old["events"], fields, ["event_id"], "seq"),
        "categories": replaced_sets(old["categories"], rows, "category_codes", known, "category_id"),
        "venues": replaced_sets(old["venues"], rows, "venue_ids", None, "venue_id"),
        "instances": old["instances"].unionByName(fresh),
    }


def store(spark: SparkSession, root: str, buckets: int = 64) -> Snapshot:
    """The imported tables below a folder."""
    return Snapshot(spark, root, TABLES, buckets)


def import_batch(at: Snapshot, epoch: int, payloads: DataFrame, organizers: DataFrame, categories: DataFrame) -> bool:
    """Merges a batch into all four tables as version `epoch`; one that is there already changes nothing.

    Events and what hangs on them lie in buckets by event, so that a batch reads and writes those of its events only.
    """
    ids = payloads.select(event_id(F.col("organizer_id"), F.col("source_reference")).alias("event_id")).filter("event_id is not null")
    return at.commit(epoch, ids, lambda old: imported(old, payloads, organizers, categories))


def continuous(stream: DataFrame, at: Snapshot, organizers: DataFrame, categories: DataFrame, checkpoint: str):
    """Micro-batches of payloads, each a version of all four tables."""

    def merge(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            import_batch(at, epoch, batch, organizers, categories)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
