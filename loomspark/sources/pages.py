"""Pages of HTML to records: links, text and sections, in Arrow batches with the standard parser."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "title string, headings array<string>, paragraphs array<string>, links array<struct<href:string,label:string>>"


class _Reader(HTMLParser):
    """Collects title, headings, paragraphs and links; scripts and styles are skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.headings, self.paragraphs, self.links = "", [], [], []
        self._open: list[str] = []
        self._text: list[str] = []
        self._href = None

    def handle_starttag(self, tag, attrs):
        if tag in ("title", "h1", "h2", "h3", "p", "a", "li", "script", "style"):
            self._open.append(tag)
            if tag == "a":
                self._href = dict(attrs).get("href") or ""
            if tag not in ("script", "style", "a"):
                self._text = []
            elif tag == "a":
                self._mark = len(self._text)

    def handle_data(self, data):
        if not self._open or self._open[-1] not in ("script", "style"):
            self._text.append(data)

    def handle_endtag(self, tag):
        if tag not in self._open:
            return
        while self._open and self._open.pop() != tag:
            pass
        text = " ".join("".join(self._text).split())
        if tag == "title":
            self.title = self.title or text
        elif tag in ("h1", "h2", "h3") and text:
            self.headings.append(text)
        elif tag == "p" and text:
            self.paragraphs.append(text)
        elif tag == "a":
            self.links.append({"href": self._href, "label": " ".join("".join(self._text[self._mark :]).split())})


def page_records(pages: DataFrame, html: str = "html", keep: list[str] = ("page_id", "url")) -> DataFrame:
    """Columns `keep` plus title, headings, paragraphs and links of each page; null pages give empty records."""

    def read(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for x in batch.column(batch.num_columns - 1):
                r = _Reader()
                r.feed(x.as_py() or "")
                r.close()
                rows.append(r)
            made = {n: pa.array([getattr(r, n) for r in rows], types.field(n).type) for n in ("title", "headings", "paragraphs", "links")}
            yield pa.RecordBatch.from_pydict({n: batch.column(i) for i, n in enumerate(batch.schema.names[:-1])} | made)

    from pyspark.sql import types as T

    source = pages.select(*keep, html)
    schema = T.StructType([*source.schema.fields[:-1], *T.StructType.fromDDL(RECORD).fields])
    return source.mapInArrow(read, schema)


def link_rows(pages: DataFrame, html: str = "html", keep: list[str] = ("page_id", "url")) -> DataFrame:
    """One row per <a href> of a page with its place, by built-in functions only."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))
    return pages.select(*keep, F.posexplode(hrefs).alias("place", "href"))


# Fixed value: what parts the blocks of a feed.
BLOCKS = r"\n---+\n|\n\n(?=\d{1,2}\s+(?:января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря))"


def sections(pages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Sections of a feed page: by ## or ### headings, else by rules and dated blocks of 50 characters, else the whole if over 100."""
    t = F.coalesce(F.col(text), F.lit(""))
    by_heading = F.filter(F.split(t, r"(?m)^(?=#{2,3}[ \t]+\S)"), lambda s: s.rlike(r"^#{2,3}[ \t]+\S"))
    heads = F.transform(by_heading, lambda s: F.struct(F.regexp_extract(s, r"^#{2,3}[ \t]+([^\n]+)", 1).alias("title"), F.trim(F.regexp_replace(s, r"^[^\n]*\n?", "")).alias("content")))
    blocks = F.filter(F.transform(F.split(t, "(?iu)" + BLOCKS), lambda s: F.trim(s)), lambda s: F.length(s) >= 50)
    cut = F.transform(blocks, lambda s: F.struct(F.substring(F.trim(F.split_part(s, F.lit("\n"), F.lit(1))), 1, 120).alias("title"), s.alias("content")))
    whole = F.when(F.length(F.trim(t)) > 100, F.array(F.struct(F.lit("Запись").alias("title"), t.alias("content")))).otherwise(F.array().cast("array<struct<title:string,content:string>>"))
    picked = F.when(F.size(heads) > 0, heads).when(F.size(cut) > 0, cut).otherwise(whole)
    return pages.select(*keep, F.posexplode(picked).alias("place", "s")).select(*keep, "place", "s.title", "s.content")
