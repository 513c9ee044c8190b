"""Text columns: keywords, ids, addresses, contacts, sections, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stems in the names of organisations that work with the elderly.
NAME_STEMS = [
    r"пожил", r"старш\w+\s+(?:поколен|возраст|людей|граждан)", r"долголет", r"серебрян", r"пенсион", r"престарел", r"ветеран",
    r"геронто", r"деменц", r"альцгейм", r"дом\w*\s+(?:для\s+)?престарел", r"интернат", r"хоспис", r"паллиат",
    r"соц\w*\s*обслуж", r"реабилит", r"уход\w*\s+за", r"инвалид", r"маломоб", r"людей\s+(?:с\s+)?ограничен",
]
# Stems in the titles of projects for the elderly.
TOPIC_STEMS = [
    r"пожил", r"старш", r"долголет", r"серебрян", r"55\+", r"60\+", r"пенсион", r"геронто", r"деменц", r"альцгейм", r"уход\s+за",
    r"старост", r"престарел", r"ветеран", r"бабуш", r"дедуш", r"людям?\s+старш", r"граждан\w*\s+старш", r"возраст\w*\s+старш",
    r"третий\s+возраст", r"третьего\s+возраста", r"старш\w+\s+поколен", r"активн\w+\s+долголет", r"здоров\w+\s+долголет",
]
# Activity codes, narrow and broad; directions; evaluations that exclude.
CARE_CODES, BROADER_CODES = ["87", "88"], ["86", "93", "96"]
DIRECTIONS = [
    "охрана здоровья граждан, пропаганда здорового образа жизни", "социальное обслуживание, социальная поддержка и защита граждан",
    "поддержка семьи, материнства, отцовства и детства", "поддержка проектов в области культуры и искусства",
    "поддержка проектов в области науки, образования, просвещения",
]
BAD_EVALUATIONS = ["проект реализован неудовлетворительно", "проект, к реализации которого победитель конкурса не приступал (грант не использовался)"]
WITHDRAWN_STEM = "отозван"
# Words of event notes, and of notes that are none.
EVENT_WORDS = [
    "масленица", "мастер-класс", "мастеркласс", "концерт", "школа ухода", "фестиваль", "акция", "вебинар", "лекция", "семинар",
    "тренинг", "выставка", "экскурсия", "занятие", "кружок", "конкурс", "приглашаем", "состоится", "приглашает",
    "день открытых дверей", "активное долголетие", "серебряный возраст", "для пенсионеров", "55+", "60+", "старшего поколения",
    "клуб общения", "праздник", "встреча", "викторина", "спартакиада",
]
OTHER_MARKERS = ["тендер", "закупк", "вакансия", "вакансий", "прием на работу", "итоги аукциона", "протокол", "план-график"]
# Parts of paths that lead to no facts about an organisation, and that do; and their ranks.
BLOCKED_PATHS = [
    "/news", "/novosti", "/press", "/media", "/photo", "/foto", "/video", "/gallery", "/galereya", "/vacancy", "/vakansii",
    "/tenders", "/zakupki", "/login", "/register", "/admin", "/sitemap", "/rss", "/feed", "/wp-", "/bitrix",
]
FACT_PATHS = [
    "kontakt", "contact", "o-nas", "about", "uslugi", "service", "svedeniya", "struktur", "otdelen", "rekvizit", "requisit",
    "spetsialist", "specialist", "filial", "podrazd", "inform", "obshchie", "general",
]
PATH_RANKS = [(100, ["kontakt", "contact", "rekvizit", "requisit"]), (50, ["o-nas", "about", "svedeniya", "uslugi", "service"]), (25, ["struktur", "otdelen", "spetsialist", "specialist", "filial"])]


def has_stem(text: Column, stems: list[str]) -> Column:
    """Any stem, whatever the case: the flags make Java fold and class Cyrillic letters."""
    return text.rlike("(?iuU)" + "|".join(stems))


def contains_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def code_group(code: Column) -> Column:
    return F.split_part(code, F.lit("."), F.lit(1))


def digits_of_length(value: Column, *lengths: int) -> Column:
    """The digits of an id if their number is one of the lengths, else null."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(F.length(digits).isin(list(lengths)), digits)


def list_of(value: Column) -> Column:
    """A comma list as an array, without blanks and None."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "None"))


def region_of(address: Column) -> Column:
    """The first comma part that names a region, else the second part, else empty."""
    parts = F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda x: F.trim(x))
    named = F.filter(parts, lambda x: x.rlike("(?iuU)область|край|республика|округ|москва|санкт-петербург|севастополь"))
    return F.coalesce(F.get(named, 0), F.get(parts, 1), F.lit(""))


def city_of(address: Column) -> Column:
    """The name after "г." or "город", else one or two leading words before the first comma; empty if neither."""
    a = F.coalesce(address, F.lit(""))
    named = F.trim(F.regexp_extract(a, r"(?iuU)(?:^|[\s,])(?:г\.|город)\s*([^,]+)", 1))
    lead = F.trim(F.regexp_extract(a, r"(?U)^\s*([\w-]+(?:\s+[\w-]+)?)\s*(?:,|$)", 1))
    return F.coalesce(F.nullif(named, F.lit("")), lead)


# Forms of contacts in page texts.
PHONE = r"(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
TAX_ID, REGISTRATION_ID = r"(?iuU)\bИНН[\s:]*(\d{10,12})\b", r"(?iuU)\bОГРН[\s:]*(\d{13,15})\b"


def contacts(text: Column) -> Column:
    """struct(phones, emails, tax_id, registration_id) of a page's text; lists are distinct, in order; ids are the first told."""
    found = [F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for p in (PHONE, EMAIL)]
    ids = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (TAX_ID, REGISTRATION_ID)]
    return F.struct(found[0].alias("phones"), found[1].alias("emails"), ids[0].alias("tax_id"), ids[1].alias("registration_id"))


def distinct_phones(phones: Column) -> Column:
    """Phones whose digits differ, with at least 11 digits; the first spelling stays."""
    digits = F.transform(phones, lambda p: F.regexp_replace(p, r"\D", ""))
    return F.filter(phones, lambda p, i: (F.length(F.get(digits, i)) >= 11) & (F.array_position(digits, F.get(digits, i)) == i + 1))


def page_rank(path: Column, label: Column) -> Column:
    """Rank of a sub-page for facts about an organisation."""
    text = F.concat_ws(" ", F.lower(path), F.lower(label))
    out = None
    for rank, parts in PATH_RANKS:
        out = F.when(contains_any(text, parts), rank) if out is None else out.when(contains_any(text, parts), rank)
    return out.otherwise(10)


def is_fact_page(path: Column, label: Column) -> Column:
    return ~contains_any(F.lower(path), BLOCKED_PATHS) & contains_any(F.concat_ws(" ", F.lower(path), F.lower(label)), FACT_PATHS)


def is_event_note(title: Column, content: Column) -> Column:
    """A section that announces an event: no other marker at its start, an event word near it, and 50 characters in all."""
    head = F.lower(F.concat_ws(" ", title, F.substring(content, 1, 300)))
    more = F.lower(F.concat_ws(" ", title, F.substring(content, 1, 500)))
    whole = F.trim(F.concat(F.lit("# "), title, F.lit("\n\n"), content))
    return ~contains_any(head, OTHER_MARKERS) & contains_any(more, EVENT_WORDS) & (F.length(whole) >= 50)


def snippet(text: Column, size: int = 150) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def head_and_tail(text: Column, size: int = 6000) -> Column:
    """Two thirds of the room for the start, one for the end."""
    head = size * 2 // 3
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.right(text, F.lit(size - head))))


def stable_reference(url: Column, title: Column) -> Column:
    return F.substring(F.sha2(F.concat(url, F.lit("#"), F.substring(title, 1, 80)).cast("binary"), 256), 1, 32)


def unfenced(answer: Column) -> Column:
    """A model's answer without the fence marks around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
