"""Labelled sections of project cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import REGISTRATION_ID, TAX_ID

# Labels of a card's sections.
SECTIONS = {
    "description": ["Краткое описание", "Описание проекта"],
    "goals": ["Цель", "Цели проекта"],
    "social_significance": ["Обоснование социальной значимости"],
    "geography": ["География проекта"],
    "target_groups": ["Целевые группы"],
}


# What ends a section, after its lines (Java's mark of the text's end is \z); the line that tells the site.
SECTION_END = r"(?=\n#{1,3}\s|\n\*\*[А-Я]|\z)"
SITE = r"(?:Веб-сайт|Сайт)[:\s]*(https?://\S+)"


def labelled(text: Column, labels: list[str]) -> Column:
    """What stands on the lines under a label, up to the next heading or bold label; null if nothing does."""
    found = F.regexp_extract(text, r"(?isu)(?:" + "|".join(labels) + r")[:\s]*\n(.*?)" + SECTION_END, 1)
    return F.nullif(F.trim(found), F.lit(""))


def card(text: Column) -> Column:
    """struct of a card's sections, site, tax_id and registration_id; null where the text does not tell."""
    t = F.coalesce(text, F.lit(""))
    site = F.rtrim(F.regexp_extract(t, "(?iu)" + SITE, 1), F.lit(")"))
    ids = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (TAX_ID, REGISTRATION_ID)]
    return F.struct(*[labelled(t, v).alias(k) for k, v in SECTIONS.items()], F.nullif(site, F.lit("")).alias("site"), ids[0].alias("tax_id"), ids[1].alias("registration_id"))


# Words of an address; starts of lines that end an organisation's name.
ADDRESS_WORDS = r"(?iu)\b\d{6}\b|область|край|респ|район|г\.|ул\.|д\.|пер\."
NAME_ENDS = ["[", "*", "8 ", "для слабовидящих"]


def run_of(lines: Column, begins, belongs) -> Column:
    """The first run of lines that belong, after the first line that begins it; empty if there is none."""
    start = F.array_position(F.transform(lines, begins), True)
    after = F.when(start > 0, F.slice(lines, start.cast("int") + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    first = F.array_position(F.transform(after, belongs), True).cast("int")
    rest = F.when(first > 0, F.slice(after, first, F.size(lines))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(rest, belongs), False).cast("int")
    return F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest)


def platform_page(text: Column, suffix: str) -> Column:
    """struct of what a page on a shared platform tells, by the platform's layout; lists may be empty, texts null.

    The name is the lines after the logo; the short name stands in the footer; the address
    is under its heading. E-mails of the platform itself are left out.
    """
    from .texts import EMAIL, PHONE, distinct_phones

    t = F.coalesce(text, F.lit(""))
    lines = F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(x))

    def named(x: Column) -> Column:
        out = x != ""
        for end in NAME_ENDS:
            out = out & ~x.startswith(end)
        return out

    def told(pattern: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(F.replace(t, F.lit("**"), F.lit("")), pattern, 1)), F.lit(""))

    name = F.array_join(run_of(lines, lambda x: x.rlike(r"^\[!\[.*\]\(.*\)$"), named), " ")
    place = run_of(lines, lambda x: x.rlike(r"^#{1,4}\s*(Адрес|Контакты)\s*$"), lambda x: (x != "") & ~x.startswith("[") & ~x.startswith("#"))
    place = F.transform(place, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[*\\]+", ""), "^Адрес:", "")))
    at = F.array_position(F.transform(place, lambda x: x.rlike(ADDRESS_WORDS)), True).cast("int")
    address = F.when(at > 0, F.array_join(F.slice(place, at, F.size(place)), ", "))
    mails = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(EMAIL), F.lit(0)), lambda m: F.lower(m)))
    link = lambda host: F.nullif(F.regexp_extract(t, rf"(https?://(?:www\.)?{host}/[^\s)\]]+)", 1), F.lit(""))
    own = suffix.lstrip(".").replace(".", r"\.")
    return F.struct(
        F.nullif(F.regexp_replace(name, r"\s+", " "), F.lit("")).alias("title"), F.btrim(told(rf"(?m)^© ((?:(?!{own})[^\n])+?)\s*\."), F.lit('"«» ')).alias("short_title"), address.alias("address_raw"),
        distinct_phones(F.regexp_extract_all(t, F.lit(PHONE), F.lit(0))).alias("phones"), F.filter(mails, lambda m: ~m.endswith("@" + suffix.lstrip("."))).alias("emails"),
        told(r"(?imu)^[ \t]*Директор[ \t]*:[ \t]*\n?([^\n]*)").alias("director"), labelled(t, ["Режим работы", "График работы"]).alias("work_schedule"), link(r"vk\.com").alias("vk_url"), link(r"ok\.ru").alias("ok_url"),
    )
