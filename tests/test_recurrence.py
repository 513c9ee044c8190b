"""Recurrence by counting against walking from the start."""

import datetime as dt
import itertools

from pyspark.sql import functions as F

from loomspark.operators import recurrence

D = dt.date
NAMES = recurrence.DAYS


def walked(start, rule, first, last):
    """Occurrences within first to last, one day after another from the start."""
    parts = dict(p.split("=") for p in rule.removeprefix("RRULE:").split(";"))
    every, count = int(parts.get("INTERVAL", 1)), int(parts.get("COUNT", 10**9))
    until = dt.datetime.strptime(parts["UNTIL"][:8], "%Y%m%d").date() if "UNTIL" in parts else D.max
    days = parts["BYDAY"].split(",") if "BYDAY" in parts else None
    monday, n, out, day = start - dt.timedelta(days=start.weekday()), 0, [], start
    while day <= min(last, until):
        if parts["FREQ"] == "WEEKLY":
            hit = (day - monday).days // 7 % every == 0 and NAMES[day.weekday()] in (days or [NAMES[start.weekday()]])
        elif parts["FREQ"] == "DAILY":
            hit = (day - start).days % every == 0 and (days is None or NAMES[day.weekday()] in days)
        else:
            hit = day.day == start.day and ((day.year - start.year) * 12 + day.month - start.month) % every == 0
        n += hit
        if hit and n <= count and day >= first:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


def made(spark, events, as_of, days):
    df = spark.createDataFrame(events, "event_id int, start_date date, rule string")
    return sorted(map(tuple, recurrence.occurrences(df, F.lit(as_of).cast("date"), days).collect()))


def test_equal_to_walking(spark):
    starts = [D(2015, 12, 31), D(2016, 2, 29), D(2023, 1, 30), D(2024, 2, 3), D(2019, 5, 29), D(2024, 3, 9)]
    rules = ["FREQ=WEEKLY;BYDAY=TU,TH,SU", "FREQ=WEEKLY;BYDAY=MO", "FREQ=WEEKLY", "FREQ=DAILY", "FREQ=DAILY;BYDAY=MO,WE,FR", "FREQ=MONTHLY"]
    events = []
    for start, rule, every, count in itertools.product(starts, rules, (1, 2, 3, 7, 12), (None, 3, 24, 60, 400)):
        events.append((len(events), start, rule + f";INTERVAL={every}" + (f";COUNT={count}" if count else "")))
    events += [(len(events), D(2024, 1, 1), "RRULE:FREQ=DAILY;UNTIL=20240305T000000Z"), (len(events) + 1, D(2024, 3, 20), "FREQ=DAILY;COUNT=2;BYDAY=MO,XX")]
    for as_of, days in ((D(2024, 2, 20), 45), (D(2024, 3, 1), 0)):
        want = sorted((k, d) for k, start, rule in events for d in walked(start, rule, as_of, as_of + dt.timedelta(days=days)))
        assert len(want) > 40 and made(spark, events, str(as_of), days) == want


def test_leap_days_over_a_century(spark):
    """The 29th of February, by months: 1900 and 2100 are no leap years."""
    for start, every, as_of in ((D(1896, 2, 29), 12, "2104-02-29"), (D(1896, 1, 29), 1, "2101-01-29"), (D(2000, 1, 31), 5, "2031-05-31")):
        rule = f"FREQ=MONTHLY;INTERVAL={every}"
        n = len(walked(start, rule, start, D.fromisoformat(as_of)))
        for count, hit in ((n, 1), (n - 1, 0)):
            assert len(made(spark, [(1, start, f"{rule};COUNT={count}")], as_of, 0)) == (hit if walked(start, rule, D.fromisoformat(as_of), D.fromisoformat(as_of)) else 0)


def test_no_rows(spark):
    odd = [(1, D(2024, 1, 1), None), (2, None, "FREQ=DAILY"), (3, D(2024, 1, 1), ""), (4, D(2024, 1, 1), "FREQ=YEARLY"), (5, D(2024, 1, 1), "FREQ=DAILY;INTERVAL=0"), (6, D(2024, 1, 1), "FREQ=MONTHLY;BYDAY=MO"), (7, D(2025, 1, 1), "FREQ=DAILY"), (8, D(2024, 1, 1), "FREQ=DAILY;INTERVAL=x"), (9, D(2024, 1, 1), "FREQ=WEEKLY;BYDAY=XX")]
    assert made(spark, odd, "2024-02-01", 30) == [] and made(spark, [], "2024-02-01", 30) == []


def test_plan_makes_only_the_horizon(spark):
    """No window and no shuffle; a rule ten years old makes no more rows than a new one."""
    df = spark.createDataFrame([(1, D(2014, 1, 1), "FREQ=DAILY;COUNT=9999"), (2, D(2024, 1, 1), "FREQ=DAILY")], "event_id int, start_date date, rule string")
    out = recurrence.occurrences(df, F.lit("2024-01-01").cast("date"), 9)
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan
    assert [r["count"] for r in out.groupBy("event_id").count().collect()] == [10, 10]


def test_rolling(spark):
    events = [(1, D(2020, 1, 1), "FREQ=DAILY"), (2, D(2024, 1, 5), "FREQ=WEEKLY;COUNT=2")]
    schema = "event_id int, start_date date, rule string, made_until date"
    none = spark.createDataFrame([], "event_id int, start_date date, status string")
    fresh = spark.createDataFrame([(*e, None) for e in events], schema)
    first = recurrence.rolled(none, fresh, F.lit("2024-01-01").cast("date"), 9, "made_until")
    assert first.count() == 11  # ten days of the one; a Friday of the other
    done = spark.createDataFrame([(*e, D(2024, 1, 10)) for e in events] + [(3, D(2024, 1, 3), "FREQ=DAILY;INTERVAL=4", None)], schema)
    second = recurrence.rolled(first, done, F.lit("2024-01-03").cast("date"), 9, "made_until")
    new = sorted((r.event_id, str(r.start_date)) for r in second.exceptAll(first).collect())
    assert new == [(1, "2024-01-11"), (1, "2024-01-12"), (2, "2024-01-12"), (3, "2024-01-03"), (3, "2024-01-07"), (3, "2024-01-11")]
    assert second.exceptAll(recurrence.rolled(second, fresh, F.lit("2024-01-03").cast("date"), 9)).count() == 0
    assert recurrence.rolled(second, done, F.lit("2024-01-03").cast("date"), 9, "made_until").count() == second.count()
