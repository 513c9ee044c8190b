"""Selections, proposals and links on small tables."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import texts
from loomspark.operators import grouping, selection


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def verdicts(spark, made, values):
    df = spark.createDataFrame([(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)], "k int, " + ", ".join(f"c{i} string" for i in range(len(values[0]) if isinstance(values[0], tuple) else 1)))
    return [r.x for r in df.select("k", made.alias("x")).orderBy("k").collect()]


def test_registry_lists(spark):
    assert verdicts(spark, selection.by_activity(F.col("c0")), ["87.90", "88", "86.21", "870", "8.88", None, ""]) == [True, True, False, False, False, False, False]
    assert verdicts(spark, selection.by_activity(F.col("c0"), broader=True), ["86.21", "93", "96.0", "62"]) == [True, True, True, False]
    assert verdicts(spark, selection.by_name(F.col("c0")), ["ХОСПИС", "дома престарелых", "Старшему возрасту", "старших возрастов", "Соц. обслуживание", "Уходящая натура", None]) == [True, True, True, True, False, False, False]
    assert verdicts(spark, selection.by_direction(F.col("c0")), [texts.DIRECTIONS[0], "спорт", None]) == [True, False, False]
    assert selection.directions_like("ДЕТСТВ") == [texts.DIRECTIONS[2]] and selection.directions_like("нет такого") == []
    assert verdicts(spark, selection.by_direction(F.col("c0"), "нет такого"), [texts.DIRECTIONS[0]]) == [False]
    assert verdicts(spark, selection.still_good(F.col("c0"), F.col("c1")), [("победитель", None), ("ОТОЗВАНА", None), (None, texts.BAD_EVALUATIONS[0]), (None, texts.BAD_EVALUATIONS[0] + "."), (None, None)]) == [True, False, False, True, True]
    assert verdicts(spark, selection.by_topic(F.col("c0")), ["Клуб 60+", "третий\tвозраст", "Уход за клумбой", "Хор", None]) == [True, True, True, False, False]
    assert verdicts(spark, selection.by_topic(F.col("c0"), F.col("c1")), [("Хор", "Совет ветеранов"), (None, "бабушки"), ("Хор", None)]) == [True, True, False]


def test_incomplete(spark):
    schema = "k int, address_raw string, fias_id string, fias_level string, city_fias_id string, region_iso string, latitude double, longitude double"
    df = spark.createDataFrame([(1, "a", "f", "4", "c", "r", 1.0, 2.0), (2, "a", "f", "8", "c", "r", 1.0, 2.0), (3, " ", "f", None, "c", "r", 1.0, 2.0), (4, None, "", "6", "c", None, None, 2.0), (5, "a", "f", "6", "c", "r", 1.0, None)], schema)
    got = {r.k: tuple(r.g) for r in df.select("k", selection.venue_gaps().alias("g")).collect()}
    assert got == {1: (False,) * 5, 2: (False, False, False, False, True), 3: (True, False, True, False, False), 4: (True, False, False, True, True), 5: (True, True, False, False, False)}
    assert verdicts(spark, selection.only_a_date(F.col("c0")), ["1.12.24", "01.1.2024", "1.12.24 встреча", "1.1.4", None]) == [True, True, False, False, False]
    assert verdicts(spark, selection.has_registry_id(F.col("c0"), F.col("c1")), [("1", None), (" ", "2"), ("", " "), (None, None)]) == [True, True, False, False]
    assert verdicts(spark, selection.own_event_pass(F.col("c0"), F.col("c1").cast("boolean")), [("AFISHA", None), ("afisha", "true"), ("org_website", "false"), (None, None)]) == [True, False, False, False]


def test_summaries(spark):
    q = spark.createDataFrame([("a", 3, 1.0, False), ("a", 0, 2.0, True), ("b", None, None, None)], "s string, n_results int, seconds double, failed boolean")
    assert rows(selection.search_statistics(q, "s")) == [("a", 2, 3, 1, 1.5), ("b", 1, 0, 0, 0.0)]
    assert rows(selection.search_statistics(q.limit(0))) == [(0, 0, 0, 0.0)]
    log = spark.createDataFrame([(1, "accepted", 1.0), (1, "rejected", 2.0), (1, None, None), (1, "pending", 0.5), (2, "accepted", None)], "run_id int, decision string, seconds double")
    assert rows(selection.run_summary(log)) == [(1, 1, 1, 2, 3.5, 1.17), (2, 1, 0, 0, 0.0, 0.0)]


def test_sites(spark):
    sources = spark.createDataFrame([(1, "o1", "org_website", "https://WWW.a.ru/"), (2, "o9", "org_website", "http://a.ru"), (3, "o1", "vk_group", "https://b.ru"), (4, None, "org_website", "c.ru"), (5, "o2", "org_website", "d.ru")], "source_id int, organizer_id string, kind string, base_url string")
    owners = spark.createDataFrame([("o2", ["http://a.ru/", "http://b.ru", "", None, " "]), ("o3", ["https://www.b.ru/", "c.ru"]), ("o2", ["d.ru"]), (None, ["e.ru"]), ("o4", None)], "organizer_id string, site_urls array<string>")
    made, moved = selection.sites_to_sources(owners, sources)
    assert rows(made.select("organizer_id", "base_url", "name", "crawl_period_days")) == [("o2", "http://b.ru", "b.ru", 30)] and rows(moved) == [(1, "o2"), (4, "o3")]


def test_codes_and_proposals(spark):
    d = spark.createDataFrame([(1, "c", "s"), (2, "s", None), (3, None, None)], "value_id int, code string, slug string")
    df = spark.createDataFrame([("x", ["c", "s", "s", None, "none"]), ("y", []), ("z", None)], "id string, codes array<string>")
    assert rows(selection.codes_to_ids(df, "id", "codes", d)) == [("x", 1), ("x", 2)]
    links = spark.createDataFrame([("https://a.ru", 0.1), ("http://www.a.ru/", 0.9), ("https://b.ru", 0.5), ("/x", 1.0), (None, 1.0), ("https://no_tld", 1.0)], "href string, score double")
    got = selection.source_proposals(links, spark.createDataFrame([("B.ru",), (None,)], "base_url string"))
    assert rows(got) == [("http://www.a.ru/", 2, 0.9)]
    assert selection.accepted_proposals(got, 0.91).count() == 0 and selection.accepted_proposals(got, 0.9).first().base_url == "http://www.a.ru/"


def test_related(spark):
    orgs = spark.createDataFrame([(1, "category", 5), (1, "service", 5), (1, "category", 5), (2, "service", 6), (3, "category", None)], "org int, kind string, term int")
    articles = spark.createDataFrame([(k, "category", 5, f"2024-01-{k:02d}") for k in range(1, 9)] + [(8, "service", 5, "2024-01-08"), (9, "service", 5, None), (9, "service", 6, None), (10, "category", None, "2025")], "article_id int, kind string, term int, published_at string")
    assert rows(selection.related_articles(orgs, articles, 3)) == [(1, 6, 3), (1, 7, 2), (1, 8, 1), (2, 9, 1)]


def test_towns_and_sources(spark):
    orgs = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id int, title string")
    links = spark.createDataFrame([(1, 4), (1, 18), (2, 5), (3, 4)], "id int, category_id int")
    venues = spark.createDataFrame([(1, "г. ОМСК, 1"), (2, "Омск"), (3, None)], "id int, address_raw string")
    assert rows(selection.organisations_in(orgs, "id", links, spark.createDataFrame([(4,), (18,)], "category_id int"), venues, "Омск")) == [(1, "A")]
    s = spark.createDataFrame([(3, 1, "b", True, None), (1, 1, "b", False, None), (2, 1, "a", None, None), (4, 1, "a", True, "2024"), (5, 2, "a", True, None)], "source_id int, organizer_id int, kind string, is_active boolean, deleted_at string")
    assert [r.source_id for r in selection.sources_of(s, 1).collect()] == [2, 1, 3] and [r.source_id for r in selection.sources_of(s, 1, "b", False).collect()] == [1]


@pytest.mark.parametrize("copies", [1, 3])
def test_merged_pages_with_ties(spark, copies):
    """Repeated rows, and several pages in one place, of which the longest counts; a site without a name."""
    data = [("s", 1, "aa"), ("s", 1, "b"), ("s", 2, None), ("s", 3, "c" * 99), ("s", 4, "d"), (None, 1, "n")] * copies
    got = grouping.merge_pages(spark.createDataFrame(data, "site string, n int, text string"), "site", "n", "text", per_page=40, budget=42, mark="|")
    assert rows(got) == [("s", "aa||" + "c" * 40, 3), (None, "n", 1)]


def test_platform_pages(spark):
    from loomspark.sources import marked_pages

    html = """<body><nav>n</nav><h1>Дом <i>ухода</i></h1><div class="region">Омск</div><div class="content"><script>x</script>один<div class="region_info">нет</div><br>два<p>три</p></div>
      <div class="icon_project_container"><b class="icon_project backcolor_care"></b></div><div class="icon_project_container"><b class="icon_project backcolor_art"></b></div>
      <div><p>Место проведения</p></div><p>не тут</p><ul><li>Сроки проведения:</li><li>5 мая</li></ul><a href="/a">Можно ЗАПИСАТЬСЯ</a><a href="https://x.nethouse.ru">y</a></body>"""
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>text"), (4, "<h1>a</h1><h1>b</h1></div></p>")], "page_id int, html string")
    got = {r.page_id: r for r in marked_pages.practices(df).collect()}
    assert set(got) == {1, 4} and got[4].title == "a" and got[4].organisation.name == "" and got[4].categories == []
    assert (got[1].title, got[1].region, got[1].categories, got[1].description) == ("Домухода", "Омск", ["Забота рядом"], "один\nдва\nтри")
    e = {r.page_id: r for r in marked_pages.events(df).collect()}[1]
    assert (e.location, e.date_text, e.registration_url, e.is_online) == ("", "5 мая", "/a", False)  # the label's parent has no element after it
    long, quoted = "слово " * 40, "Фонд «Добро помощи» " + "и ещё " * 20
    lines = [["Первый. Второй!", "a@b.ru", "c@d.ru", "+7 (900) 1", "https://ok.ru/x", "https://own.ru", "https://two.ru", "https://vk.com/1"], [long], [quoted], ["Вер. 2.0 без точки"], None]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, l array<string>")
    o = {r.k: r.o for r in d.select("k", marked_pages.organisation(F.col("l")).alias("o")).collect()}
    assert (o[0].name, o[0].email, o[0].website, o[0].vk, len(o[0].social_links)) == ("Первый.", "c@d.ru", "https://own.ru", "https://vk.com/1", 4)
    assert o[1].name == " ".join(["слово"] * 10) and o[2].name == "Фонд «Добро помощи»" and o[3].name == "Вер." and o[4].name == "" and o[4].website is None


@pytest.mark.parametrize("name", ["p17_event_pages", "p17_practices"])
def test_platform_titles_equal_sql(spark, tmp_path, name):
    import duckdb

    from loomspark.plans import catalogue
    from loomspark.sources import marked_pages

    titles = ["a &lt;b&gt; &amp; c", "cut off &amp", "token = &quot;77", "&amp;lt; &amp;amp; &&lt; &#39; &nbsp", "&copy 1 &AMP; 2 & 3", "plain", ""]
    table = [(7 * k, f"https://h{k}.example.org/x", f"<html><title>{t}</title></html>") for k, t in enumerate(titles)]
    at = str(tmp_path / "pages.parquet")
    spark.createDataFrame(table, "page_id long, url string, html string").write.parquet(at)
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{at}/*.parquet'")
    result = db.execute(catalogue.ORACLE_SQL[name])
    assert rows(df.select([d[0] for d in result.description])) == sorted(result.fetchall(), key=str) and df.count() == len(titles)
    # the parser itself reads every reference
    read = marked_pages.events(spark.createDataFrame([(1, "<h1>&laquo;a&raquo; &quot;b&quot; &#39;c&#39; &amp</h1>")], "page_id int, html string")).first()
    assert read.title == "«a» \"b\" 'c' &"
