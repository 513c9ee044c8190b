"""Legacy migration, duplicate merges and purges on small tables."""

import pytest
from pyspark.sql import functions as F

from loomspark.operators import duplicates, migration


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def legacy(spark, posts, relations=(), terms=(), dictionaries=()):
    """posts: (id, title, {key: value})"""
    meta = [(i, k, v) for i, _, m in posts for k, v in m.items()] + [(None, "hp_inn", "1"), (999, "other", "x")]
    return (
        spark.createDataFrame([(i, t, None) for i, t, _ in posts], "post_id long, title string, content string"), spark.createDataFrame(meta, "post_id long, meta_key string, meta_value string"),
        spark.createDataFrame(list(relations), "post_id long, term_id long"), spark.createDataFrame(list(terms), "term_id long, taxonomy string, code string"),
        spark.createDataFrame(list(dictionaries), "dictionary string, code string, dictionary_id string"),
    )


def inn(n):
    return {"hp_inn": f"77-{n:08d}"}


def ogrn(n):
    return {"hp_ogrn": f"1 {n:012d}"}


def test_listings(spark):
    posts = [(1, " A ", {"hp_inn": "77 0000 0001", "hp_latitude": "37.5", "hp_longitude": "55.1", "hp_phone": "1, None,,2", "hp_email": "a@b.ru,bad", "hp_city": "г. Омск", "hp_region": "RU-55"}), (2, "B", {"hp_inn": "12"}), (3, "C", {"hp_inn": " ", "hp_ogrn": "1" * 13}), (4, None, {})]
    got = {r.post_id: r for r in migration.listings(*legacy(spark, posts)[:2]).collect()}
    assert (got[1].title, got[1].inn, got[1].phones, got[1].emails) == ("A", "7700000001", ["1", "2"], ["a@b.ru"]) and tuple(got[1].place) == (55.1, 37.5, "Омск", 55)
    assert got[2].reason == "bad inn" and got[3].reason is None and got[3].ogrn == "1" * 13 and got[4].reason is None and got[4].phones == []


def test_ids_stay_when_listings_join(spark, tmp_path):
    at = migration.store(spark, str(tmp_path / "t"), 4)

    def run(epoch, posts):
        assert migration.migrate(at, epoch, *legacy(spark, posts))
        return {r.post_id: r.organization_id for r in at.read("ids").collect()}

    base = [(5, "five", inn(1)), (6, "six", ogrn(2)), (7, "seven", inn(3)), (8, "bad", {"hp_inn": "1"})]
    first = run(0, base)
    assert len(set(first.values())) == 3 and 8 not in first and rows(at.read("rejected")) == [(8, "bad inn")]
    assert run(1, base) == first and at.read("retired").count() == 0
    # a listing with a smaller id joins: the organisation keeps its id; another joins two of them: the least listing's stays
    second = run(2, [(1, "one", inn(1)), *base, (9, "nine", inn(1) | ogrn(2))])
    assert {second[k] for k in (1, 5, 6, 9)} == {first[5]} and second[7] == first[7]
    assert rows(at.read("retired")) == [(first[6], first[5])]
    org = {r.organization_id: r for r in at.read("organizations").collect()}
    assert (org[first[5]].title, org[first[5]].n_listings, org[first[5]].inn, org[first[5]].ogrn) == ("nine", 4, "7700000001", "1000000000002")
    # a third joins the rest: chains of retired ids lead to the last one
    third = run(3, [(1, "one", inn(1)), *base, (9, "nine", inn(1) | ogrn(2)), (3, "three", inn(3) | ogrn(2))])
    assert set(third.values()) == {first[5]} and dict(rows(at.read("retired"))) == {first[6]: first[5], first[7]: first[5]}


def test_venues_and_terms(spark):
    posts = [
        (1, "A", inn(1)), (2, "A", inn(1) | {"hp_address": "x"}), (3, "A", inn(1) | {"hp_address": " y "}), (4, "B", inn(2) | {"hp_address": "y"}), (5, "C", inn(3) | {"hp_latitude": "1", "hp_longitude": "2"}), (6, "D", inn(4) | {"hp_latitude": "1", "hp_longitude": "?"}),
    ]
    relations = [(1, 10), (2, 10), (1, 11), (1, 12), (1, 13), (1, 14), (99, 10)]
    terms = [(10, "hp_listing_category", "19"), (11, "hp_listing_category", "22"), (12, "hp_listing_service", "5"), (13, "hp_listing_type", "none"), (14, "post_tag", "7")]
    dictionaries = [("thematic_categories", "7", "t7"), ("thematic_categories", "19", "t19"), ("services", "22", "s22"), ("services", "5", "s5"), ("specialist_profiles", "5", "p5")]
    none = {n: spark.createDataFrame([], s) for n, (s, _) in migration.TABLES.items()}
    out = migration.migrated(none, *legacy(spark, posts, relations, terms, dictionaries))
    names = {r.organization_id: r.title for r in out["organizations"].collect()}
    where = {r.venue_id: (r.address, r.latitude) for r in out["venues"].collect()}
    assert sorted(where.values(), key=str) == [("x", None), ("y", None), (None, 2.0)]  # y once for two organisations
    links = sorted((names[r.organization_id], where[r.venue_id][0], r.is_headquarters) for r in out["organization_venues"].collect())
    assert sorted(links, key=str) == sorted([("A", "x", True), ("A", "y", False), ("B", "y", True), ("C", None, True)], key=str)
    assert sorted((names[r.organization_id], r.dictionary, r.dictionary_id) for r in out["organization_terms"].collect()) == [("A", "services", "s22"), ("A", "specialist_profiles", "p5"), ("A", "thematic_categories", "t7")]
    assert all(r.n == 0 for r in duplicates.orphans({k: out[k] for k in migration.KEYS}, migration.KEYS, migration.GRAPH).collect())
    assert all(df.count() == 0 for df in migration.migrated(none, *legacy(spark, [])).values())


def test_orphans_keep_a_version_out(spark, tmp_path, monkeypatch):
    at = migration.store(spark, str(tmp_path / "t"), 2)
    monkeypatch.setattr(migration, "term_links", lambda *a: spark.createDataFrame([("nobody", "d", "1")], "organization_id string, dictionary string, dictionary_id string"))
    with pytest.raises(ValueError, match="without a parent"):
        migration.migrate(at, 0, *legacy(spark, [(1, "A", inn(1))]))
    assert at.last() is None


def test_merge(spark):
    schema = "id long, fias string, address string, phone string, deleted_at timestamp"
    df = spark.createDataFrame([(4, "f", "a", None, None), (2, "f", None, None, None), (3, " ", "a", "p3", None), (9, "", "", "p9", None), (8, None, " ", None, None), (1, "g", None, "p1", None), (7, "g", None, None, None)], schema)
    mapping = duplicates.survivors(df, "id", ["fias", "address"])
    assert rows(mapping) == [(1, 1), (2, 2), (3, 2), (4, 2), (7, 1), (8, 8), (9, 9)]
    out = {r.id: r for r in duplicates.merged_rows(df, "id", mapping, ["phone"], F.lit("2024-01-01")).collect()}
    assert len(out) == 7 and out[2].phone == "p3" and out[2].deleted_at is None and out[3].deleted_at is not None and out[8].phone is None and out[7].phone is None
    links = spark.createDataFrame([(1, 2, False), (1, 3, True), (1, 9, False), (2, 4, False), (2, 77, True), (3, None, True)], "org int, venue long, hq boolean")
    got = duplicates.repointed(links, "venue", mapping, ["org", "venue"], {"hq": F.bool_or("hq")})
    assert rows(got) == [(1, 2, True), (1, 9, False), (2, 2, False), (2, 77, True), (3, None, True)]


def test_surplus(spark):
    df = spark.createDataFrame([(1, "o", "u", "2020-01-01"), (2, "o", "u", None), (3, "o", "u", None), (4, "o", None, None), (5, None, "u", None), (6, "p", "u", None), (7, "o", None, None)], "id int, org string, url string, deleted_at string").withColumn("deleted_at", F.col("deleted_at").cast("timestamp"))
    got = {r.id: str(r.deleted_at) for r in duplicates.surplus_deleted(df, "id", ["org", "url"], F.lit("2024-01-01")).collect()}
    assert {k: v[:4] for k, v in got.items()} == {1: "2020", 2: "None", 3: "2024", 4: "None", 5: "None", 6: "None", 7: "None"}


def test_purge(spark):
    org = spark.createDataFrame([(1, "t"), (2, "x"), (3, "t")], "id int, kind string")
    organizer = spark.createDataFrame([(10, 1), (20, 2), (30, None), (None, 3)], "id int, org int")
    event = spark.createDataFrame([(100, 10, None), (101, 20, 5), (102, 20, 6), (102, 20, 6), (103, None, None)], "id int, organizer int, venue int")
    venue = spark.createDataFrame([(5,), (6,)], "id int")
    tables = {"event": event, "organizer": organizer, "org": org, "venue": venue}
    graph = [("event", "organizer", "organizer"), ("organizer", "org", "org"), ("event", "venue", "venue")]
    keys = {"org": "id", "organizer": "id", "venue": "id"}
    left, counts = duplicates.purge(tables, keys, graph, {"org": org.filter("kind = 't'").select("id"), "venue": venue.filter("id = 6").select("id")})
    assert rows(counts) == [("event", 3, 2), ("org", 2, 1), ("organizer", 2, 2), ("venue", 1, 1)]
    assert rows(left["event"].select("id")) == [(101,), (103,)] and rows(left["organizer"]) == [(20, 2), (30, None)]
    assert sum(r.n for r in duplicates.orphans(left, keys, graph).collect()) == 0
    whole, counts = duplicates.purge(tables, keys, graph, {})
    assert whole["event"].count() == 5 and {r.removed for r in counts.collect()} == {0}
    with pytest.raises(ValueError, match="circle"):
        duplicates.purge({"a": org, "b": org}, {}, [("a", "id", "b"), ("b", "id", "a")], {})
