"""Dates written in Russian, and how fresh a page is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as they stand after a day, and alone.
MONTHS_OF = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
MONTHS = ["январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь"]


ISO = "yyyy-MM-dd'T'HH:mm:ss'+03:00'"


def _number(col: Column) -> Column:
    return F.nullif(col, F.lit("")).try_cast("int")


def _month(word: Column, names: list[str]) -> Column:
    """Number of the month that a word names; null if none."""
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in names]), word), F.lit(0)).cast("int")


def _minutes(clock: Column) -> Column:
    """Minutes since midnight of a clock time such as 9.30; null where it is none."""
    hour, minute = (_number(F.element_at(F.split(clock, "[.:]"), k)) for k in (1, 2))
    return F.when((hour < 24) & (minute < 60), hour * 60 + minute)


def date_text_range(text: Column, as_of: Column) -> Column:
    """struct(start, end) as ISO text in Moscow time; nulls where no date is told.

    The text is read as words. The month is the first of the calendar that is named after a
    day (or else alone), the day the number before it (or the first word), the year
    that of as_of unless one is given. A word with two clock times is start and
    end; one time, or none, means an hour.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s*[–—-]\s*", "-")
    plain = F.regexp_replace(plain, r"(?<=\d)(?=\p{L})|(?<=\p{L})(?=\d)", " ")
    words = F.filter(F.split(plain, r"[^\p{L}\p{N}.:-]+"), lambda w: w != "")
    words = F.transform(words, lambda w: F.regexp_replace(w, r"^[.:-]+|[.:-]+$", ""))
    after = F.transform(words, lambda w: _month(w, MONTHS_OF))
    alone = F.transform(words, lambda w: _month(w, MONTHS))
    month = F.coalesce(F.array_min(after), F.array_min(alone))
    at = F.array_position(F.transform(after, lambda m: m.isNotNull()), True).cast("int")
    day = F.coalesce(_number(F.regexp_extract(F.get(words, at - 2), r"(?:^|\D)(\d{1,2})$", 1)), _number(F.regexp_extract(F.get(words, F.lit(0)), r"^(\d{1,2})$", 1)))
    year = F.coalesce(_number(F.get(F.filter(words, lambda w: w.rlike(r"^20\d{2}$")), 0)), F.year(as_of))
    clocks = F.split(F.get(F.filter(words, lambda w: w.rlike(r"^\d{1,2}[.:]\d{2}(-\d{1,2}[.:]\d{2})?$")), 0), "-")
    start, last = F.when(clocks.isNull(), 0).otherwise(_minutes(F.get(clocks, 0))), _minutes(F.get(clocks, 1))
    end = F.when(F.coalesce(F.size(clocks), F.lit(0)) < 2, start + 60).when(start == last, start + 60).otherwise(last)
    date = F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0))
    at_time = [F.date_format(F.when(start.isNotNull() & end.isNotNull(), date + F.make_dt_interval(mins=m)), ISO) for m in (start, end)]
    return F.struct(at_time[0].alias("start"), at_time[1].alias("end"))


def schedule_range(date: Column, time: Column) -> Column:
    """struct(start, end) from a date and a time like 10.00: an hour from there; nulls where the two are no time."""
    start = F.try_to_timestamp(F.concat_ws(" ", date, F.replace(F.coalesce(time, F.lit("00:00")), F.lit("."), F.lit(":"))), F.lit("yyyy-MM-dd HH:mm"))
    return F.struct(F.date_format(start, ISO).alias("start"), F.date_format(start + F.expr("interval 1 hour"), ISO).alias("end"))


def freshness_days(content: Column, as_of: Column) -> Column:
    """Days from the first date in the first 500 characters to as_of, not under 0; null if unknown.

    A date is a day, then a month as a word or number, then perhaps a year. Month names
    count in lower case only; a capital makes the date unknown.
    """
    words = F.split(F.substring(F.coalesce(content, F.lit("")), 1, 500), r"[\s.]+")
    names = F.array(*[F.lit(m) for m in MONTHS_OF])

    def date_at(word: Column, k: Column) -> Column:
        month = F.regexp_extract(F.get(words, k + 1), r"^(\p{L}+|\d{1,2})(?![\p{L}\p{N}])", 1)
        fits = month.rlike(r"^\d") | F.array_contains(names, F.lower(month))
        return F.when(word.rlike(r"(?:^|\D)\d{1,2}$") & fits, F.struct(F.regexp_extract(word, r"(\d{1,2})$", 1).alias("day"), month.alias("month"), F.regexp_extract(F.get(words, k + 2), r"^\d{4}", 0).alias("year")))

    first = F.get(F.filter(F.transform(words, date_at), lambda d: d.isNotNull()), 0)
    month = F.coalesce(_number(first["month"]), _month(first["month"], MONTHS_OF))
    told = F.to_date(F.try_make_timestamp_ntz(F.coalesce(_number(first["year"]), F.year(as_of)), month, _number(first["day"]), F.lit(0), F.lit(0), F.lit(0)))
    return F.when(told.isNotNull(), F.greatest(F.lit(0), F.datediff(as_of, told)))
