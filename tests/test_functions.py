"""Literal expectations of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomspark.functions import dates, rules, texts, urls


def value(spark, column, **row):
    names = list(row)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for n, v in row.items())) if names else spark.range(1)
    return df.select(column.alias("v")).first()[0]


@pytest.mark.parametrize(("url", "reason"), [
    ("", "empty_url"), ("  ", "empty_url"), (None, "empty_url"), ("fond-tut.ru", "missing_scheme"), ("https:///x", "no_hostname"),
    ("https://localhost/a", "no_tld"), ("https://mikh-kcson.ryazan.", "truncated_tld"), ("https://a_b.ru", "invalid_format"), ("https://fond-tut.ru/x?y=1", ""),
])
def test_url_problem(spark, url, reason):
    assert value(spark, urls.url_problem(F.col("u")), u=url) == reason


@pytest.mark.parametrize(("url", "fragment"), [("https://mikh-kcson.ryazan.", "mikh-kcson ryazan"), ("kcson23.uszn032.ru", "kcson23 uszn032"), ("https://fond-tut.ru", "fond-tut"), ("", ""), ("http://www.kcson-vologda.gov35.ru", "kcson-vologda gov35")])
def test_domain_fragment(spark, url, fragment):
    assert value(spark, urls.domain_fragment(F.col("u")), u=url) == fragment


@pytest.mark.parametrize(("url", "kind", "slug", "number"), [
    ("https://vk.com/club12345", "vk_group", "club12345", 12345), ("https://vk.com/kcson_vol", "vk_group", "kcson_vol", None),
    ("https://ok.ru/group/54321", "ok_group", "group/54321", 54321), ("https://ok.ru/group/54321/topic/999", "none", "", None),
    ("https://t.me/kcson_news", "tg_channel", "kcson_news", None), ("https://example.com", "none", "", None), ("https://vk.com/share", "none", "", None),
])
def test_social_link(spark, url, kind, slug, number):
    assert tuple(value(spark, urls.social_link(F.col("u")), u=url)) == (kind, slug, number)


def test_directories_need_a_dot(spark):
    assert value(spark, urls.is_directory_url(F.lit("https://focus.kontur.ru/x"))) is True
    assert value(spark, urls.is_directory_url(F.lit("https://mykontur.ru/x"))) is False
    assert value(spark, urls.url_key(F.lit(" HTTPS://www.Site.ru/a// "))) == "site.ru/a"
    assert value(spark, urls.url_root(F.lit("https://soc13.ru/pi/news"))) == "https://soc13.ru/"
    assert value(spark, urls.is_junk_url(F.lit("https://yandex.ru/images/x"))) is True


@pytest.mark.parametrize(("text", "start", "end"), [
    ("28 февраля 2025 (пятница), 10.00 - 11.30 (Мск)", "2025-02-28T10:00:00+03:00", "2025-02-28T11:30:00+03:00"),
    ("1 июля, 10:00 - 11:30 (Мск)", "2024-07-01T10:00:00+03:00", "2024-07-01T11:30:00+03:00"),
    ("27 мая 2025 года в 11:00 (мск)", "2025-05-27T11:00:00+03:00", "2025-05-27T12:00:00+03:00"),
    ("", None, None), ("   ", None, None), ("завтра в 10:00", None, None), ("31 февраля 2025", None, None),
])
def test_date_text(spark, text, start, end):
    assert tuple(value(spark, dates.date_text_range(F.lit(text), F.lit("2024-03-01").cast("date")))) == (start, end)


def test_freshness(spark):
    at = F.lit("2025-03-10").cast("date")
    for text, days in (("Новость 1 марта 2025", 9), ("01.03.2025 что-то", 9), ("20 марта 2025", 0), ("1 Марта 2025", None), ("нет даты", None)):
        assert value(spark, dates.freshness_days(F.lit(text), at)) == days


def test_stems_fold_cyrillic(spark):
    for text, hit in (("ДОМ ДЛЯ ПРЕСТАРЕЛЫХ", True), ("Геронтологический центр", True), ("Старшее поколение", True), ("Школа бизнеса", False)):
        assert value(spark, texts.has_stem(F.lit(text), texts.NAME_STEMS)) is hit
    assert value(spark, texts.has_stem(F.lit("Клуб 55+"), texts.TOPIC_STEMS)) is True


def test_texts(spark):
    assert value(spark, texts.region_of(F.lit("160000, Вологодская область, г. Вологда"))) == "Вологодская область"
    assert value(spark, texts.city_of(F.lit("160000, Вологодская обл, г. Вологда, ул. Мира"))) == "Вологда"
    assert value(spark, texts.digits_of_length(F.lit("77-01 234567"), 10, 12)) == "7701234567"
    assert value(spark, texts.list_of(F.lit("a, None, , b"))) == ["a", "b"]
    got = value(spark, texts.contacts(F.lit("Тел. +7 (495) 123-45-67, 8 495 123 45 67, ИНН 7701234567, a@b.ru")))
    assert got.phones == ["+7 (495) 123-45-67", "8 495 123 45 67"] and got.emails == ["a@b.ru"] and got.tax_id == "7701234567"
    assert value(spark, texts.unfenced(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert value(spark, texts.is_event_note(F.lit("Афиша"), F.lit("Приглашаем на концерт " + "в клуб " * 10))) is True
    assert value(spark, texts.is_event_note(F.lit("Закупка"), F.lit("Приглашаем на концерт, закупки " + "в клуб " * 10))) is False


@pytest.mark.parametrize(("decision", "score", "flag", "status"), [
    ("accepted", 0.9, True, "approved"), ("accepted", 0.84, True, "pending_review"), ("accepted", 0.9, False, "pending_review"),
    ("needs_review", 0.9, True, "pending_review"), ("rejected", 0.9, True, "rejected"), (None, 0.9, True, "draft"), ("other", 0.9, True, "draft"),
])
def test_status(spark, decision, score, flag, status):
    assert value(spark, rules.import_status(F.lit(decision).cast("string"), F.lit(score), F.lit(flag))) == status


def test_scores(spark):
    s = value(spark, urls.repair_score(F.lit("https://kcson23.uszn032.ru/"), F.lit("Центр помощи"), F.lit(""), F.lit(1), F.lit("kcson23 uszn032"), F.lit("Центр помощи")))
    assert s.score == 105.0 and s.reason == "domain_match_100%; title_match_2/2; https; ru_domain; top_1"
    assert value(spark, urls.official_score(F.lit("https://fond.gov.ru"), F.lit("x"), F.lit(""), F.lit(9), F.lit("Фонд"))) == 30.0
    assert abs(value(spark, rules.distance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111195) < 1
    assert dt.date(2024, 1, 1) is not None
