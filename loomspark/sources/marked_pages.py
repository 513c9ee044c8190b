"""Pages of a practice and event platform as records: a parser gathers marked elements, built-in functions do the rest."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Categories by the mark of their icon; words before a place, a date, and in a link to a registration; hosts of such.
CATEGORIES = {
    "backcolor_health": "Здоровый образ жизни", "backcolor_educ": "Обучение", "backcolor_business": "Взаимопомощь", "backcolor_care": "Забота рядом",
    "backcolor_sport": "Связь поколений", "backcolor_art": "Культура и искусство", "backcolor_nature": "История и краеведение", "backcolor_tech": "Психология",
}
PLACE_LABEL, DATE_LABEL, SIGN_UP = "Место проведения", "Сроки проведения", "записаться"
TICKET_HOSTS = ["timepad.ru", "nethouse.ru", "ticketscloud"]
# Forms of an organisation's contact lines.
EMAIL_LINE, PHONE_LINE = r"^[\w.+-]+@[\w.-]+\.\w+$", r"^\+?\d[\d\s()-]+$"
#: Elements that are gathered, by what marks them: a class, an id, or else a tag.
MARKS = {"h1": "h1", "page_title": ".titlePage", "region": ".region", "dates": ".data", "content": ".content", "event_content": ".containerProject-content", "org": "#info_popup", "tag": ".newsTag"}
_SKIPPED, _SKIPPED_CLASSES = {"script", "style", "nav"}, {"icon_project_container", "region_info"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("h1", "page_title", "region", "dates", "tag", "place", "date_text", "registration_url")],
    *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("content", "event_content", "org", "icons")],
])


class _Gatherer(HTMLParser):
    """Texts of the first element of each mark, icons of the first container, what stands beside labels, and the link to a registration."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, set]] = []
        self.open: dict[str, int] = {}  # name to depth
        self.texts: dict[str, list[str]] = {}
        self.icons: list[str] | None = None
        self.in_icons = 0
        self.beside: dict[str, int] = {}  # name to the depth of what stands before it
        self.link, self.link_text, self.registration = None, [], None

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        given = dict(attrs)
        classes, depth = set((given.get("class") or "").split()), len(self.stack)
        for name, at in list(self.beside.items()):
            if at == depth:
                self.open.setdefault(name, depth)
                self.texts.setdefault(name, [])
                del self.beside[name]
        for name, mark in MARKS.items():
            hit = mark[1:] in classes if mark[0] == "." else given.get("id") == mark[1:] if mark[0] == "#" else tag == mark
            if hit and name not in self.texts:
                self.open[name], self.texts[name] = depth, []
        if "icon_project_container" in classes and self.icons is None:
            self.icons, self.in_icons = [], depth + 1
        elif self.in_icons and "icon_project" in classes:
            self.icons += [c for c in CATEGORIES if c in classes]
        if tag == "a" and given.get("href") is not None:
            self.link, self.link_text = given["href"], []
            if self.registration is None and any(h in self.link for h in TICKET_HOSTS):
                self.registration = self.link
        self.stack.append((tag, classes))

    def handle_data(self, data):
        if self.link is not None:
            self.link_text.append(data)
        text, hidden = data.strip(), any(t in _SKIPPED or c & _SKIPPED_CLASSES for t, c in self.stack)
        if text and not (self.stack and self.stack[-1][0] in ("script", "style")):
            for name in self.open:
                if name not in ("content", "event_content") or not hidden:
                    self.texts[name].append(text)
            for name, label in (("place", PLACE_LABEL), ("date_text", DATE_LABEL)):
                if label in data and name not in self.texts and self.stack:
                    self.beside.setdefault(name, len(self.stack) - 1)

    def handle_endtag(self, tag):
        if tag == "a" and self.link is not None:
            if self.registration is None and SIGN_UP in "".join(self.link_text).lower():
                self.registration = self.link
            self.link = None
        if tag not in (t for t, _ in self.stack):
            return
        while self.stack.pop()[0] != tag:
            pass
        depth = len(self.stack)
        self.open = {n: at for n, at in self.open.items() if at < depth}
        self.beside = {n: at for n, at in self.beside.items() if at <= depth}  # no sibling follows once the parent is closed
        if depth < self.in_icons:
            self.in_icons = 0

    def row(self) -> dict:
        joined = lambda n: "".join(self.texts[n]) if n in self.texts else None
        lists = {n: self.texts.get(n) for n in ("content", "event_content", "org")}
        return {n: joined(n) for n in ("h1", "page_title", "region", "dates", "tag", "place", "date_text")} | lists | {"icons": self.icons or [], "registration_url": self.registration}


def gathered(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Columns `keep` and what RAW names, of each page; null pages have nulls."""
    source = pages.select(*keep, html)
    schema = T.StructType([*source.schema.fields[:-1], *RAW.fields])

    def read(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for x in batch.column(batch.num_columns - 1):
                g = _Gatherer()
                g.feed(x.as_py() or "")
                g.close()
                rows.append(g.row())
            made = {n: pa.array([r[n] for r in rows], types.field(n).type) for n in RAW.names}
            yield pa.RecordBatch.from_pydict({n: batch.column(i) for i, n in enumerate(batch.schema.names[:-1])} | made)

    return source.mapInArrow(read, schema)


def organisation(lines: Column) -> Column:
    """struct(name, description, email, phone, website, vk, social_links) from the lines of an organisation's block.

    Of several e-mails or phones the last counts, of websites the first, of VK pages the last. The name is the first sentence if it ends within 200
    characters, else all if that is 15 words at most, else what ends with the first of », ) and " that stands between the
    7th and the 200th character, else ten words. Without a block all are empty.
    """
    rows = F.coalesce(lines, F.array().cast("array<string>"))
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(""))
    emails, rest = F.filter(rows, lambda x: x.rlike(EMAIL_LINE)), F.filter(rows, lambda x: ~x.rlike(EMAIL_LINE))
    phones, rest = F.filter(rest, lambda x: x.rlike(PHONE_LINE)), F.filter(rest, lambda x: ~x.rlike(PHONE_LINE))
    links, told = F.filter(rest, lambda x: x.rlike("^https?://")), F.filter(rest, lambda x: ~x.rlike("^https?://"))
    is_vk = lambda x: x.contains("vk.com") | x.contains("vkontakte")
    others = ("ok.ru", "odnoklassniki", "t.me", "telegram", "max.ru", "youtube.com", "rutube.ru", "zen.yandex", "instagram.com", "facebook.com")
    social = lambda x: is_vk(x) | x.rlike("|".join(o.replace(".", r"\.") for o in others))
    vk = F.filter(links, is_vk)
    text = F.array_join(told, " ")
    sentence = F.regexp_extract(text, r"(?s)^([^.!?]*(?:[.!?](?!\s)[^.!?]*)*[.!?])\s", 1)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    marks = [F.instr(text, m) for m in ("»", ")", '"')]
    name = F.when((sentence != "") & (F.length(sentence) <= 200), sentence).when(F.size(words) <= 15, text)
    for at in marks:
        name = name.when((at > 6) & (at <= 200), F.substring(text, F.lit(1), at))
    name = name.otherwise(F.array_join(F.slice(words, 1, 10), " "))
    return F.struct(
        F.trim(name).alias("name"), text.alias("description"), last(emails).alias("email"), last(phones).alias("phone"), F.get(F.filter(links, lambda x: ~social(x)), 0).alias("website"),
        F.get(vk, F.size(vk) - 1).alias("vk"), links.alias("social_links"),
    )


def practices(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Practice records: title, region, dates, categories, description, short_description and organisation; pages without a heading give none.

    Categories are those of the first container of icons, in the order of CATEGORIES. Scripts, navigation, icons and the region block are no description.
    """
    g = gathered(pages, keep=keep).filter("h1 is not null")
    text = F.coalesce(F.array_join("content", "\n"), F.lit(""))
    named = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    known = F.filter(F.array(*[F.lit(c) for c in CATEGORIES]), lambda c: F.array_contains("icons", c))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return g.select(
        *keep, F.col("h1").alias("title"), blank("region").alias("region"), blank("dates").alias("dates"), F.transform(known, lambda c: named[c]).alias("categories"),
        text.alias("description"), F.substring(text, 1, 200).alias("short_description"), organisation(F.col("org")).alias("organisation"),
    )


def events(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Event records: title, location, date_text, category, description (2000 characters at most), registration_url, is_online; pages without a title give none.

    A place and dates stand in the element after the one that holds their label. A place that says so is online.
    """
    g = gathered(pages, keep=keep).withColumn("title", F.coalesce("page_title", "h1")).filter("title is not null")
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = F.coalesce(F.array_join("event_content", "\n"), F.lit(""))
    return g.select(
        *keep, "title", blank("place").alias("location"), blank("date_text").alias("date_text"), blank("tag").alias("category"), F.substring(text, 1, 2000).alias("description"), "registration_url",
        F.lower(blank("place")).contains("онлайн").alias("is_online"),
    )
