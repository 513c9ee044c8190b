"""Import records, reviews, hits and cards on tiny tables."""

from pyspark.sql import functions as F

from loomspark.functions import cards
from loomspark.operators import records, reviews


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


ANSWER = [f"{k}_fias_id" for k in ("settlement", "city", "region")] + ["region_iso_code"] + [f"{k}kladr_id" for k in ("house_", "street_", "settlement_", "city_", "region_", "")] + ["geo_lat", "geo_lon"]


def answer(spark, **values):
    df = spark.createDataFrame([tuple(values.get(c) for c in ANSWER)], ", ".join(f"{c} string" for c in ANSWER))
    return df.select(records.geocoded(F.struct("*")).alias("g")).select("g.*").first().asDict()


def test_address_answers(spark):
    got = answer(spark, settlement_fias_id="s", city_fias_id=" ", region_fias_id="r", region_iso_code="RU-X", house_kladr_id="", city_kladr_id="ck", geo_lat="55.5", geo_lon="east")
    assert got == {"fias_id": "s", "fias_level": "6", "city_fias_id": "s", "kladr_id": "ck", "region_iso": "RU-X", "region_code": None, "geo_lat": 55.5, "geo_lon": None}
    got = answer(spark, region_fias_id="r", kladr_id="k")
    assert (got["fias_id"], got["fias_level"], got["city_fias_id"], got["region_code"], got["kladr_id"]) == ("r", "1", "r", "r", "k")
    assert set(answer(spark).values()) == {None}


def test_types_and_code_checks(spark):
    df = spark.createDataFrame([("87.30", False), ("88.10", True), ("88.10", False), (None, None)], "okved string, provider boolean")
    assert [r[0] for r in df.select(records.type_codes(F.col("okved"), F.col("provider"))).collect()] == [["142", "141"], ["142", "143"], ["142"], ["142"]]
    df = spark.createDataFrame([(1, ["142", "162", "9"], None), (2, ["142", "161"], "162"), (3, [], "143"), (4, [], "9"), (5, None, None)], "k int, t array<string>, o string")
    got = df.select("k", records.checked_codes(F.col("t"), F.col("o"), ["142", "143"], ["161", "162"]).alias("c")).select("k", "c.*").collect()
    assert [(r.types, r.ownership, r.issues) for r in got[:4]] == [(["142"], "162", ["type:9"]), (["142"], "162", []), (["143"], None, []), ([], "9", ["ownership:9"])]
    assert (got[4].types, got[4].ownership) == (None, None)


def test_events_with_and_without_a_classification(spark):
    notes = spark.createDataFrame([("https://a.ru/1", "Концерт", "text", "a"), ("https://a.ru/2", "Лекция", None, "a")], "url string, title string, content string, found_on string")
    listed = spark.createDataFrame([("p1", "Чай", None, "9 мая 2025, 10:00", None, None, True, "https://r.ru", None)], "source_reference string, title string, description string, date_text string, location string, category string, is_online boolean, registration_url string, page_url string")
    raw = records.raw_events(notes, listed)
    ref = [r.source_reference for r in raw.filter("title = 'Лекция'").collect()][0]
    c = spark.createDataFrame([(ref, "rejected", 0.9, True, "offline", None, None, None)], "source_reference string, decision string, score double, works_with_elderly boolean, attendance_mode string, online_url string, starts string, ends string")
    got = {r.title: r for r in records.ingested_events(raw, c, F.lit("2025-01-01").cast("date")).collect()}
    assert set(got) == {"Концерт", "Чай"}
    assert (got["Чай"].attendance_mode, got["Чай"].online_url, got["Чай"].start_datetime) == ("online", "https://r.ru", "2025-05-09T10:00:00+03:00")
    assert (got["Концерт"].ai_metadata.decision, got["Концерт"].ai_metadata.ai_confidence_score, got["Концерт"].start_datetime) == ("needs_review", 0.5, None)
    assert records.event_records(raw.withColumn("organizer_id", F.lit(1))).columns == ["source_reference", "organizer_id", "title"]


def test_venues(spark):
    known = spark.createDataFrame([(7, "f1", "A", "x"), (3, "f1", "B", None), (5, None, "C", "z")], "id long, fias_id string, address_raw string, iso string")
    new = spark.createDataFrame([(1, "f1", "C", None), (2, " ", "C", "new"), (3, None, "nowhere", None), (4, "f9", "C", None), (5, None, None, None)], "k int, fias_id string, address_raw string, iso string")
    assert rows(records.resolved_venues(new, known, ["iso"]).select("k", "venue_id", F.coalesce("iso", F.lit("-")))) == [(1, 3, "-"), (2, 5, "new"), (3, None, "-"), (4, None, "-"), (5, None, "-")]


def test_defaults_and_context(spark):
    df = spark.createDataFrame([("https://a.ru/", "org_website", None, None, None), ("http://vk.com/x", "vk_group", "X", 3, 9)], "base_url string, kind string, name string, crawl_period_days int, priority int")
    assert rows(records.source_defaults(df).select("name", "crawl_period_days", "priority", "last_status")) == [("X", 3, 9, "pending"), ("a.ru", 30, 50, "pending")]
    orgs = spark.createDataFrame([(1, "D", None), (2, None, ["t"]), (3, "E", ["t"])], "k int, description string, trace array<string>")
    notes = spark.createDataFrame([(1, "more", "n"), (2, "more", "n")], "k int, sentence string, entry string")
    got = {r.k: (r.description, r.trace) for r in records.with_context(orgs, notes, "k").collect()}
    assert got == {1: ("D\n\nmore", ["n"]), 2: ("more", ["t", "n"]), 3: ("E", ["t"])}


def test_hits(spark):
    hits = [("https://2gis.ru/x", "t"), ("https://sub.2gis.ru/x", "t"), ("https://vk.com/club5", "t"), ("vk.com", "t"), (None, None), ("https://teplodom.ru/", "Дом Тепло teplodom"), ("http://other.xyz/", "нет")]
    df = spark.createDataFrame([(1, u, t, "", i + 1, "Центр teplodom") for i, (u, t) in enumerate(hits)], "org int, url string, title string, snippet string, position int, org_title string")
    got = reviews.discovered(df).orderBy("position").collect()
    assert [r.kind for r in got] == ["directory", "directory", "social", "invalid", "invalid", "official", "weak"]
    assert got[2].confidence == 0.7 and got[5].confidence == 0.5
    assert rows(reviews.discovery_counts(reviews.discovered(df), "org")) == [(1, 1, 1, 2, 2, 1)]


def test_best_replacement(spark):
    schema = "k int, url string, score double, position int, reachable boolean"
    own = [(1, "https://a.ru", 30.0, 1, None), (1, "https://b.ru", 60.0, 2, False), (2, "https://2gis.ru/x", 90.0, 1, None), (3, "https://2gis.ru/y", 90.0, 1, None), (4, "https://low.ru", 10.0, 1, None), (6, "bad", 90.0, 1, None)]
    other = [(1, "https://c.ru", 99.0, 1, None), (2, "https://d.ru", 20.0, 1, None), (3, "https://zoon.ru/x", 50.0, 1, None), (5, "https://e.ru", 25.0, 1, None)]
    got = reviews.best_replacement(spark.createDataFrame(own, schema), spark.createDataFrame(other, schema), "k")
    assert rows(got) == [(1, "https://a.ru", 30.0, False), (2, "https://d.ru", 20.0, True), (3, "https://2gis.ru/y", 90.0, False), (5, "https://e.ru", 25.0, True)]


def test_review_with_audit(spark):
    src = spark.createDataFrame([(1, 1, "u1"), (2, 1, "u2"), (3, 1, "u3"), (4, 2, "u4")], "source_id int, owner int, url string")
    sheet = spark.createDataFrame([(1, "u2", None, True), (2, "new", "", True), (3, "new", None, True), (4, "u9", "new", True), (9, "x", None, True), (4, "u9", "other", False)], "source_id int, verified_url string, edited_url string, approved boolean")
    assert rows(reviews.review_applied(src, sheet).select("source_id", "new_url", "status")) == [(1, "u2", "deduped"), (2, "new", "applied"), (3, "new", "deduped"), (4, "new", "applied"), (9, "x", "error")]
    blank = reviews.review_sheet(spark.createDataFrame([(1, None)], "source_id int, verified_url string")).first()
    assert (blank.approved, blank.notes, blank.edited_url) == (False, "", "")
    assert reviews.review_applied(src, spark.createDataFrame([(1, None, " ", True)], sheet.schema)).first().status == "skipped"


def test_terms_and_limits(spark):
    old = spark.createDataFrame([(1, "d", "t", "old", "approved")], "owner int, dictionary string, term string, reasoning string, status string")
    new = spark.createDataFrame([(1, "d", "t", "a", 1), (1, "d", "t", "b", 2), (1, "", "t", "c", 3), (2, "d", None, "c", 3), (2, "d", "u", None, 4)], "owner int, dictionary string, term string, reasoning string, seq int")
    assert sorted(map(tuple, reviews.suggested_terms(old, new, "seq").collect())) == [(1, "d", "t", "b", "pending"), (2, "d", "u", None, "pending")]
    notes = spark.createDataFrame([("s", p, i) for p in (1, 2, 3) for i in range(4)], "site string, page int, place int")
    assert rows(records.at_most(notes, "page", "site", "place", 2, 2).select("page", "place")) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_cards(spark):
    text = "# П\n## Цель:\nПомочь\nвсем\n### География проекта\nОмск\n**Сайт: https://a.ru/)\nИНН 5501234567, ОГРН: 1025500000000"
    got = one(spark, cards.card(F.col("t")), t=text)
    assert (got.goals, got.geography, got.site, got.tax_id, got.registration_id, got.description) == ("Помочь\nвсем", "Омск", "https://a.ru/", "5501234567", "1025500000000", None)
    assert set(one(spark, cards.card(F.col("t")), t=None).asDict().values()) == {None}


def test_platform_pages(spark):
    text = "[![l](a)](b)\n[menu](c)\nДом ухода\nг. Омска\n\nПозже\n#### Адрес\n\nОфис\n644000, Омск\\\nул. Мира\n\n**Директор:**\nИванова\n8 (3812) 11-22-33, 8 381 211 22 33 8 999 111-22-33\nA@b.ru a@b.ru x@plat.ru\n[ok](https://ok.ru/group/5)"
    got = one(spark, cards.platform_page(F.col("t"), "plat.ru"), t=text)
    assert (got.title, got.address_raw, got.director, got.emails, got.ok_url, got.vk_url, got.short_title) == ("Дом ухода г. Омска", "644000, Омск, ул. Мира", "Иванова", ["a@b.ru"], "https://ok.ru/group/5", None, None)
    empty = one(spark, cards.platform_page(F.col("t"), "plat.ru"), t=None)
    assert (empty.title, empty.address_raw, empty.phones, empty.emails) == (None, None, [], [])
