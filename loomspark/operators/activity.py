"""Activity tables: events and reach by region and month, as bitmaps that add up to years and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SCHEMA = "region string, bucket long, bits binary, n long, month string"


def month_cells(events: DataFrame, region: str, ts: str, member: str) -> DataFrame:
    """(region, month, bucket, bits, n): for each region and month the members' numbers as bitmaps of 32,768 bits, and the events.

    Members are whole numbers. Events without a member count, in a row without bits; those without a time go. A region that
    is null is a region of its own.
    """
    month = F.date_format(F.col(ts), "yyyy-MM")
    rows = events.filter(F.col(ts).isNotNull()).select(F.col(region).cast("string").alias("region"), month.alias("month"), F.col(member).cast("long").alias("_m"))
    rows = rows.withColumn("bucket", F.bitmap_bucket_number("_m"))
    bits = F.bitmap_construct_agg(F.when(F.col("_m").isNotNull(), F.bitmap_bit_position("_m")))
    out = rows.groupBy("region", "month", "bucket").agg(bits.alias("bits"), F.count("*").alias("n"))
    return out.select("region", "bucket", F.when(F.col("bucket").isNotNull(), F.col("bits")).alias("bits"), "n", "month")


def refresh(events: DataFrame, at: str, region: str, ts: str, member: str, first: str, last: str) -> None:
    """Rewrites the cells of the months from `first` to `last` (yyyy-MM) in the table at `at`, and reads no events but theirs.

    Other months' files stay as they are. A month that has lost all its events keeps its old cells: months are only ever replaced.
    """
    begin, end = F.to_date(F.lit(f"{first}-01")), F.add_months(F.to_date(F.lit(f"{last}-01")), 1)
    kind = events.schema[ts].dataType.simpleString()
    new = month_cells(events.filter((F.col(ts) >= begin.cast(kind)) & (F.col(ts) < end.cast(kind))), region, ts, member)
    new.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(at)


def periods(cells: DataFrame) -> DataFrame:
    """(region, period, level, n, reach) for months and years, by region and in total (level: region or total).

    Reach, the number of different members, is exact: bitmaps of a bucket are or-ed, so that nobody counts
    twice in a year or in the total.
    """
    region, month = F.struct(F.lit("region").alias("level"), "region"), F.col("month")
    total = F.struct(F.lit("total").alias("level"), F.lit(None).cast("string").alias("region"))
    scopes = F.array(*[F.struct(s.alias("s"), p.alias("period")) for s in (region, total) for p in (month, F.substring(month, 1, 4))])
    rows = cells.select(F.explode(scopes).alias("x"), "bucket", "bits", "n").select("x.s.level", "x.s.region", "x.period", "bucket", "bits", "n")
    each = rows.groupBy("level", "region", "period", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("n").alias("n"))
    members = F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits")).otherwise(0)
    return each.groupBy("level", "region", "period").agg(F.sum("n").alias("n"), F.sum(members).alias("reach"))


def dynamics(table: DataFrame) -> DataFrame:
    """periods() of months on a calendar without gaps, with the change of both numbers against the month before.

    The calendar runs from the first to the last month of all regions; months without events have 0, and the first one no change.
    """
    months = table.filter(F.length("period") == 7)
    ends = months.agg(F.to_date(F.concat(F.min("period"), F.lit("-01"))).alias("a"), F.to_date(F.concat(F.max("period"), F.lit("-01"))).alias("b"))
    days = ends.filter("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("_d")).select(F.date_format("_d", "yyyy-MM").alias("period"), F.lit(1).alias("_one"))
    scopes = months.select("level", "region").distinct().withColumn("_one", F.lit(1))
    grid = scopes.join(F.broadcast(days), "_one").select(F.col("level").alias("l"), F.col("region").alias("r"), F.col("period").alias("p"))
    on = (F.col("l") == F.col("level")) & F.col("r").eqNullSafe(F.col("region")) & (F.col("p") == F.col("period"))
    rows = grid.join(months, on, "left").select(F.col("l").alias("level"), F.col("r").alias("region"), F.col("p").alias("period"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("reach", F.lit(0)).alias("reach"))
    w = W.partitionBy("level", "region").orderBy("period")
    return rows.withColumns({f"{c}_change": F.col(c) - F.lag(c).over(w) for c in ("n", "reach")})
