"""Nested cards of organisations: every child set is aggregated by organisation before it is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import first_per


def children(rows: DataFrame, owner: str, name: str, fields: list[str], order: list[str], newest: Column | None = None, most: int | None = None) -> DataFrame:
    """(owner, name): each owner's rows as structs of `fields`, sorted by `order`; with `most` only so many, newest first.

    The cut to `most` is made in each task before the shuffle, so that an owner of very many rows does not meet them all in
    one place; without it all of an owner's rows are in its list.
    """
    if most is not None:
        rows = first_per(rows, [owner], [newest.desc_nulls_last(), *order], most)
        at = [F.col("_rank")]
    else:
        at = [F.col(c) for c in order]
    listed = F.array_sort(F.collect_list(F.struct(*[c.alias(f"_{k}") for k, c in enumerate(at)], F.struct(*fields).alias("_row"))))
    return rows.groupBy(owner).agg(F.transform(listed, lambda x: x["_row"]).alias(name))


def organization_cards(orgs: DataFrame, id_col: str, sets: dict[str, DataFrame], lists: list[DataFrame]) -> DataFrame:
    """orgs with a list for each dictionary in sets ((owner, id, name) rows, repeated ones once) and each of lists (from children()).

    Owners without rows have empty lists. Every side has one row for each owner when it is joined, so that no two child sets ever meet.
    """
    out = orgs
    sides = [(name, children(df.distinct(), id_col, name, ["id", "name"], ["id"])) for name, df in sets.items()]
    sides += [(next(c for c in df.columns if c != id_col), df) for df in lists]
    for name, side in sides:
        out = out.join(side, id_col, "left").withColumn(name, F.coalesce(name, F.array().cast(side.schema[name].dataType)))
    return out


def events_of(events: DataFrame, instances: DataFrame, owner: str, most: int = 10) -> DataFrame:
    """Each owner's newest approved events, with the start of their first instance.

    events: id, title, attendance_mode, status, created_at; instances: event_id, start_datetime. Instances are looked up for the events that are kept only.
    """
    kept = first_per(events.filter("status = 'approved'"), [owner], [F.col("created_at").desc_nulls_last(), "id"], most).drop("_rank")
    first = instances.join(kept.select(F.col("id").alias("event_id")), "event_id", "left_semi").groupBy(F.col("event_id").alias("id")).agg(F.min("start_datetime").alias("start_datetime"))
    return children(kept.join(first, "id", "left"), owner, "events", ["id", "title", "attendance_mode", "start_datetime"], ["id"], F.col("created_at"), most)


def articles_of(articles: DataFrame, owner: str, most: int = 5) -> DataFrame:
    """Each owner's newest published articles. articles: id, title, slug, excerpt, status, published_at."""
    return children(articles.filter("status = 'published'"), owner, "articles", ["id", "title", "slug", "excerpt"], ["id"], F.col("published_at"), most)


def venues_of(venues: DataFrame, links: DataFrame, owner: str) -> DataFrame:
    """Each owner's venues with the headquarters flag of the link; several links to one venue are one."""
    one = links.groupBy(owner, "venue_id").agg(F.bool_or(F.coalesce("is_headquarters", F.lit(False))).alias("is_headquarters"))
    rows = one.join(venues.withColumnRenamed("id", "venue_id"), "venue_id").withColumnRenamed("venue_id", "id")
    return children(rows, owner, "venues", ["id", "address", "fias_id", "is_headquarters"], ["id"])
