"""Recurrence rules: occurrences within a horizon, by counting and not by walking from the start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]


def parsed(rule: Column) -> Column:
    """struct(freq, every, count, until, days) of a rule; days are numbers from Monday, 0, null without BYDAY.

    An interval that is missing is 1, one below 1 null. Unknown weekdays are left out.
    """
    parts = F.str_to_map(F.regexp_replace(rule, "^RRULE:", ""), F.lit(";"), F.lit("="))
    every = F.when(parts["INTERVAL"].isNull(), 1).otherwise(parts["INTERVAL"].try_cast("int"))
    until = F.to_date(F.try_to_timestamp(F.substring(parts["UNTIL"], 1, 8), F.lit("yyyyMMdd")))
    names = F.array(*[F.lit(d) for d in DAYS])
    days = F.filter(F.transform(F.split(parts["BYDAY"], ","), lambda d: (F.array_position(names, d) - 1).cast("int")), lambda d: d >= 0)
    return F.struct(parts["FREQ"].alias("freq"), F.when(every >= 1, every).alias("every"), parts["COUNT"].try_cast("int").alias("count"), until.alias("until"), F.array_distinct(days).alias("days"))


def _upto(days: Column, limit: Column) -> Column:
    """How many of the weekdays are not after `limit`."""
    return F.size(F.filter(days, lambda d: d <= limit))


def _sum(steps: int, of) -> Column:
    """of(k) added up for k from 0 to steps - 1."""
    return F.aggregate(F.array(*[F.lit(k) for k in range(steps)]), F.lit(0), lambda total, k: total + of(k).cast("int"))


def ordinal(start: Column, rule: Column, day: Column) -> Column:
    """The place of `day`, from 1, among the occurrences of a rule since its start; null if it is none.

    All by division with remainder: weeks are counted from the Monday of the first; a daily rule on some
    weekdays repeats after seven steps; a monthly one keeps the start's day of the month, and its lengths of months repeat after
    twelve steps but for leap years.
    """
    every, days = rule["every"], rule["days"]
    passed = F.datediff(day, start)
    # weekly
    own = F.coalesce(days, F.array(F.weekday(start)))
    weeks = F.floor(F.datediff(day, F.date_trunc("week", start).cast("date")) / 7).cast("int")
    weekly = F.when((weeks % every == 0) & F.array_contains(own, F.weekday(day)), F.floor(weeks / every) * F.size(own) - _upto(own, F.weekday(start) - 1) + _upto(own, F.weekday(day)))
    # daily
    steps = F.floor(passed / every).cast("int")
    hit = lambda k: F.array_contains(days, F.pmod(F.weekday(start) + k * every, F.lit(7)))
    some = F.floor((steps + 1) / 7) * _sum(7, hit) + _sum(7, lambda k: (k < (steps + 1) % 7) & hit(k))
    daily = F.when((passed % every == 0) & days.isNull(), steps + 1).when((passed % every == 0) & F.array_contains(days, F.weekday(day)), some)
    # monthly
    first = F.year(start) * 12 + F.month(start) - 1
    gone = F.year(day) * 12 + F.month(day) - 1 - first
    turn, wanted = F.floor(gone / every).cast("int"), F.dayofmonth(start)
    leap = lambda y: ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)

    def months(k: Column) -> Column:
        """Turns k, k + 12, ... up to this one whose month has the day."""
        at = first + k * every
        month = F.pmod(at, F.lit(12)) + 1
        there = F.when(k <= turn, F.floor((turn - k) / 12).cast("int") + 1).otherwise(0)
        long = F.when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        years = F.sequence(F.lit(0), F.greatest(there, F.lit(1)) - 1)
        leaps = F.when(there == 0, 0).otherwise(F.size(F.filter(years, lambda j: leap(F.floor(at / 12) + j * every))))
        return F.when(month != 2, F.when(wanted <= long, there).otherwise(0)).when(wanted <= 28, there).when(wanted == 29, leaps).otherwise(0)

    monthly = F.when((gone % every == 0) & (F.dayofmonth(day) == wanted) & days.isNull(), F.when(wanted <= 28, turn + 1).otherwise(_sum(12, months)))
    return F.when(day >= start, F.when(rule["freq"] == "WEEKLY", weekly).when(rule["freq"] == "DAILY", daily).when(rule["freq"] == "MONTHLY", monthly)).cast("int")


def occurrences(events: DataFrame, as_of: Column, days: int = 90, made_until: str | None = None) -> DataFrame:
    """(event_id, start_date) of daily, weekly and monthly rules from as_of to `days` after it.

    events: event_id, start_date, rule, like FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,TH;COUNT=20 or with UNTIL=20250301.
    COUNT counts from the start, before the horizon cuts; UNTIL is included; without BYDAY the start's weekday, or day
    of the month, holds, and months that lack the day have none. Monthly rules with BYDAY, other
    rules, intervals below 1 and null starts give no rows. Only days of the horizon are made, and no
    rows are shuffled; with the column made_until only those after it (null: all).
    """
    last = F.date_add(as_of, days)
    rows = events.select("event_id", "start_date", parsed(F.col("rule")).alias("r"), *([made_until] if made_until else []))
    begin = F.greatest(F.col("start_date"), as_of, *([F.date_add(made_until, 1)] if made_until else []))
    end = F.least(last, F.coalesce("r.until", last))
    rows = rows.filter(F.col("start_date").isNotNull() & F.col("r.every").isNotNull() & (begin <= end))
    rows = rows.select("event_id", "start_date", "r", F.explode(F.sequence(begin, end)).alias("day"))
    rows = rows.withColumn("n", ordinal(F.col("start_date"), F.col("r"), F.col("day")))
    return rows.filter(F.col("n").isNotNull() & (F.col("r.count").isNull() | (F.col("n") <= F.col("r.count")))).select("event_id", F.col("day").alias("start_date"))


def rolled(instances: DataFrame, events: DataFrame, as_of: Column, days: int = 90, made_until: str | None = None) -> DataFrame:
    """instances (event_id, start_date) and those of the rolling horizon that are not there yet; a second run adds none.

    A daily job whose events say in made_until how far they are made creates the days since then only, and
    compares them with the instances of those days only.
    """
    new = occurrences(events, as_of, days, made_until).distinct()
    there = instances.filter(F.col("start_date") >= as_of).select("event_id", "start_date")
    return instances.unionByName(new.join(there, ["event_id", "start_date"], "left_anti"), allowMissingColumns=True)
