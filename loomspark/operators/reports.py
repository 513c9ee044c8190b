"""Quality and run reports: single passes over flags and partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Price of a million input and output tokens.
INPUT_PRICE, OUTPUT_PRICE = 0.014, 0.28


def run_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Totals, success rate, decisions, confidence, cost and mean stage time of results.

    rows: ok BOOLEAN, decision, confidence, tokens_in, tokens_out, seconds. Rates are null without rows; a time of 0 is none.
    """
    total, good = F.count("*"), F.count_if("ok")
    conf = F.when(F.col("ok"), F.col("confidence"))
    return rows.groupBy(*keys).agg(
        total.alias("total"),
        good.alias("success"),
        F.bround(F.try_divide(good.cast("double"), total), 4).alias("success_rate"),
        *[F.count_if(F.col("decision") == d).alias(d) for d in ("accepted", "rejected", "needs_review")],
        F.bround(F.avg(conf), 4).alias("avg_confidence"),
        F.min(conf).alias("min_confidence"),
        F.max(conf).alias("max_confidence"),
        F.bround((F.sum("tokens_in") * INPUT_PRICE + F.sum("tokens_out") * OUTPUT_PRICE) / 1e6, 6).alias("cost"),
        F.bround(F.avg(F.when(F.col("seconds") > 0, F.col("seconds"))), 4).alias("avg_seconds"),
    )


def flagged(base: DataFrame, key: str, sides: dict[str, DataFrame]) -> DataFrame:
    """base's keys with a flag per side: whether the key is there. Sides are made distinct before they meet."""
    out = base.select(key)
    for name, side in sides.items():
        out = out.join(side.select(key).distinct().withColumn(name, F.lit(True)), key, "left")
    return out.na.fill(False, list(sides))


def counted(base: DataFrame, key: str, sides: dict[str, DataFrame]) -> DataFrame:
    """base's keys with a count per side; sides are counted before they meet."""
    out = base.select(key)
    for name, side in sides.items():
        out = out.join(side.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.na.fill(0, list(sides))


def duplicate_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per column: how many values occur more than once, and the surplus rows. Blank values don't count."""
    out = None
    for k in keys:
        groups = rows.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != "")).groupBy(k).agg(F.count("*").alias("n")).filter("n > 1")
        part = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus")).select(F.lit(k).alias("column"), "groups", "surplus")
        out = part if out is None else out.union(part)
    return out


def coverage(flags: DataFrame, names: list[str]) -> DataFrame:
    """Count and percent of rows with each flag."""
    rows = flags.agg(F.count("*").alias("total"), *[F.count_if(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("n")) for n in names])
    return rows.select("total", F.explode(pairs).alias("p")).select("p.flag", "p.n", F.bround(F.try_divide(F.col("p.n") * F.lit(100.0), F.col("total")), 2).alias("percent"))


def combinations(flags: DataFrame, names: list[str], top: int = 15) -> DataFrame:
    """The most frequent combinations of flags."""
    return flags.groupBy(*names).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *names).limit(top)


def wide(eav: DataFrame, id_col: str, key: str, value: str, keys: list[str]) -> DataFrame:
    """One row per entity from (entity, key, value) rows, for the named keys."""
    return eav.groupBy(id_col).pivot(key, keys).agg(F.max(value))


def bucket(n_organizers: Column, n_venues: Column, n_sources: Column) -> Column:
    """The one class of an organisation's completeness."""
    return (
        F.when(n_organizers == 0, "no_organizer").when(n_venues == 0, "no_venue").when(n_venues > 1, "many_venues")
        .when(n_sources == 0, "no_source").when(n_sources > 1, "many_sources").otherwise("ideal")
    )


def approved_pages(pages: DataFrame, owner: str, order: str, url: str, is_match: Column, confidence: Column, least: float = 0.6) -> DataFrame:
    """Per owner how many pages were verified, those approved (a match of at least `least`), in order, and whether there are any."""
    good = F.coalesce(is_match & (confidence >= least), F.lit(False))
    listed = F.array_sort(F.collect_list(F.when(good, F.struct(F.col(order).alias("at"), F.col(url).alias("url")))))
    return pages.groupBy(owner).agg(F.count("*").alias("n_pages"), F.transform(listed, lambda x: x["url"]).alias("approved"), F.bool_or(good).alias("has_approved"))
