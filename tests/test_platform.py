"""Activity tables, hierarchies, nested cards, enrichment, source changes and run progress on small tables."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import activity, details, enrichment, hierarchy
from loomspark.streaming import jobs


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_activity(spark, tmp_path):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), dt.date(2023, rng.choice([1, 2, 5, 12]), rng.randrange(1, 29)), rng.choice([None, 1, 2, 70_000, 70_001, 10**12, 10**12 + 40_000])) for _ in range(300)] + [("a", None, 5), ("late", dt.date(2024, 2, 29), 7)]
    df = spark.createDataFrame(data, "region string, day date, who long")
    at = str(tmp_path / "cells")
    activity.refresh(df, at, "region", "day", "who", "2023-01", "2024-02")
    read = lambda: spark.read.schema(activity.SCHEMA).parquet(at)
    want = {}
    for region, day, who in data:
        for key in () if day is None else ((lvl, r, p) for lvl, r in (("region", region), ("total", None)) for p in (f"{day:%Y-%m}", f"{day:%Y}")):
            n, members = want.setdefault(key, [0, set()])
            want[key][0] = n + 1
            members |= {who} - {None}
    table = activity.periods(read())
    assert rows(table.select("level", "region", "period", "n", "reach")) == sorted(((*k, n, len(m)) for k, (n, m) in want.items()), key=str)
    got = {(r.level, r.region, r.period): r for r in activity.dynamics(table).collect()}
    assert len(got) == 5 * 14 and got["region", "a", "2023-01"].n_change is None  # fourteen months for four regions and the total
    assert (got["region", "a", "2023-03"].n, got["region", "a", "2023-03"].n_change) == (0, -got["region", "a", "2023-02"].n)
    assert got["total", None, "2023-05"].reach_change == got["total", None, "2023-05"].reach
    # a month anew: its files alone are written, and its events alone are read
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cells").rglob("*.parquet")}
    activity.refresh(df.filter("who = 1"), at, "region", "day", "who", "2023-05", "2023-05")
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "cells").rglob("*.parquet")}
    assert {str(p.parent.name) for p in set(before.items()) ^ set(after.items()) for p in [p[0]]} == {"month=2023-05"}
    assert {r.month for r in activity.month_cells(df.filter("day < '2023-02-01'"), "region", "day", "who").collect()} == {"2023-01"}
    assert activity.dynamics(activity.periods(read().limit(0))).count() == 0


def test_only_the_new_month_is_read(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("a", dt.date(2023, 1, 5), 1)], "region string, day date, who long").write.parquet(str(tmp_path / "e"))
    plans, cells = [], activity.month_cells
    monkeypatch.setattr(activity, "month_cells", lambda e, *a: plans.append(e._jdf.queryExecution().executedPlan().toString()) or cells(e, *a))
    activity.refresh(spark.read.parquet(str(tmp_path / "e")), str(tmp_path / "c"), "region", "day", "who", "2023-02", "2023-02")
    assert "GreaterThanOrEqual(day,2023-02-01)" in plans[0] and "LessThan(day,2023-03-01)" in plans[0]


def test_hierarchy(spark):
    nodes = [(1, None, "r1"), (2, None, "r2"), (10, 1, "b"), (9, 1, "a"), (100, 10, "c"), (1000, 100, "deep"), (20, 21, "x"), (21, 20, "y"), (22, 21, "z"), (23, 22, "zz"), (30, 30, "self"), (40, 99, "lost"), (41, 40, "w"), (None, 1, "null")]
    df = spark.createDataFrame(nodes, "id int, parent int, name string")
    tree = hierarchy.expanded(df)
    assert rows(tree.filter("id is not null").select("id", "root", "depth")) == [(1, 1, 0), (10, 1, 1), (100, 1, 2), (1000, 1, 3), (2, 2, 0), (9, 1, 1)]
    assert {r.id: r.path for r in tree.collect()}[1000] == [1, 10, 100, 1000]
    assert dict(rows(hierarchy.unreached(df))) == {20: "circle", 21: "circle", 22: "below a circle", 23: "below a circle", 30: "circle", 40: "no parent", 41: "no parent"}
    got = {r.id: json.loads(r.j) for r in hierarchy.grouped(tree.filter("id is not null")).select("id", F.to_json("children").alias("j")).collect()}
    assert got == {1: [{"id": 9, "name": "a", "children": []}, {"id": 10, "name": "b", "children": [{"id": 100, "name": "c"}]}], 2: []}
    assert rows(hierarchy.below(tree, [10, 2])) == [(10,), (100,), (1000,), (2,)] and hierarchy.below(tree, []).count() == 0
    assert hierarchy.grouped(hierarchy.expanded(df.limit(0))).count() == 0 and hierarchy.unreached(df.filter("id < 3")).count() == 0


def test_cards(spark):
    orgs = spark.createDataFrame([(1, "A"), (2, "B")], "org int, title string")
    services = spark.createDataFrame([(1, 5, "five"), (1, 4, "four"), (1, 5, "five")], "org int, id int, name string")
    venues = spark.createDataFrame([(7, "addr", None), (8, "x", "f")], "id int, address string, fias_id string")
    links = spark.createDataFrame([(1, 7, None), (1, 7, True), (1, 99, True)], "org int, venue_id int, is_headquarters boolean")
    events = spark.createDataFrame([(1, k, f"e{k}", "offline", "approved" if k != 3 else "draft", None if k == 0 else f"2024-01-{k:02d}") for k in range(14)], "org int, id int, title string, attendance_mode string, status string, created_at string")
    instances = spark.createDataFrame([(13, "s2"), (13, "s1"), (77, "s")], "event_id int, start_datetime string")
    articles = spark.createDataFrame([(1, k, f"t{k}", "s", "x", "published", "2024") for k in range(7)], "org int, id int, title string, slug string, excerpt string, status string, published_at string")
    out = details.organization_cards(orgs, "org", {"services": services}, [details.venues_of(venues, links, "org"), details.events_of(events, instances, "org"), details.articles_of(articles, "org")])
    a, b = sorted(out.collect(), key=lambda r: r.org)
    assert [tuple(x) for x in a.services] == [(4, "four"), (5, "five")] and [tuple(v) for v in a.venues] == [(7, "addr", None, True)]
    assert [e.id for e in a.events] == [13, 12, 11, 10, 9, 8, 7, 6, 5, 4] and a.events[0].start_datetime == "s1" and a.events[1].start_datetime is None
    assert [x.id for x in a.articles] == [0, 1, 2, 3, 4]
    assert (b.services, b.venues, b.events, b.articles) == ([], [], [], [])
    # each join but those of an event with its start and a link with its venue is on the organisation, with one row a side
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and plan.count("Join LeftOuter, (org") == 4


def test_enrichment(spark):
    orgs = spark.createDataFrame(
        [(1, "i1", None, "old", "s", [], ["e"]), (2, " ", "o2", "old", None, None, None), (3, None, "o2", "old", None, ["p"], []), (4, None, None, "old", None, [], []), (5, "i9", "o2", "old", None, [], []), (6, "i6", "", "old", None, [], []), (7, None, "o7", "old", None, [], [])],
        "id int, inn string, ogrn string, title string, short_title string, phones array<string>, emails array<string>",
    )
    parties = spark.createDataFrame(
        [("i1", "o1", " Full ", "Short", ["1"], ["2"]), ("i2", "o2", None, "Only short", ["1"], []), ("i6", "o2", "F" * 300, "S" * 150, None, None), ("i6b", "o7", "", " ", [], None), ("", "", "blank", None, [], [])],
        "inn string, ogrn string, full_name string, short_name string, phones array<string>, emails array<string>",
    )
    out, conflicts = enrichment.enriched(orgs, parties)
    got = {r.id: r for r in out.collect()}
    assert (got[1].title, got[1].short_title, got[1].ogrn, got[1].phones, got[1].emails) == ("Full", "Short", "o1", ["1"], ["e"])
    # 2 and 3 lack the tax id i2, which one of them gets; a short name alone is the title
    assert (got[2].inn, got[2].title, got[2].short_title, got[2].phones) == ("i2", "Only short", None, ["1"]) and got[3].inn is None and got[3].phones == ["p"]
    assert got[4].title == got[5].title == "old" and got[4].inn is None  # nothing to look up; a tax id that the directory lacks
    assert len(got[6].title) == 255 and len(got[6].short_title) == 100 and got[6].ogrn == ""  # o2 is others'
    assert got[7].inn == "i6b" and got[7].title == "old"
    assert rows(conflicts) == [(3, "inn", "i2", 2), (6, "ogrn", "o2", 2)]


def test_source_patches(spark):
    schema = "source_id string, organizer_id string, base_url string, name string, kind string, last_status string, last_crawled_at string, is_active boolean, deleted_at string"
    web = "org_website"
    src = [("a", "o", "u1", "n", web, "pending", None, True, None), ("b", "o", "u2", "n", web, "pending", None, True, None), ("c", "o", "u3", "n", "vk_group", "pending", None, True, None), ("d", None, "u4", "n", web, None, None, None, None), ("e", "o", "u5", "n", web, None, None, True, "2024"), ("f", "p", "u9", "n", web, None, None, True, None)]
    sources = spark.createDataFrame(src, schema)
    orgs = spark.createDataFrame([("o", ["x", "u1"]), ("p", None), ("q", None)], "organizer_id string, site_urls array<string>")
    patches = [("a", 1, "u2", None, None), ("b", 2, "v", "N", None), ("b", 3, None, None, "error"), ("c", 4, "v", None, None), ("d", 5, "w", None, None), ("z", 6, "w", None, None), ("f", 7, "u1", None, None), (None, 8, "u1", None, None)]
    out, sites, answers = enrichment.patched_sources(sources, spark.createDataFrame(patches, "source_id string, seq long, base_url string, name string, last_status string"), orgs)
    assert rows(answers) == [("a", "conflict", "b"), ("b", "updated", None), ("c", "conflict", "b"), ("d", "updated", None), ("f", "updated", None), ("z", "error", None)]
    assert {r.source_id: (r.base_url, r.name, r.last_status) for r in out.collect()} == {"a": ("u1", "n", "pending"), "b": ("v", "N", "error"), "c": ("u3", "n", "pending"), "d": ("w", "n", None), "e": ("u5", "n", None), "f": ("u1", "n", None)}
    assert rows(sites) == [("o", ["x", "u1", "v"]), ("p", ["u1"]), ("q", None)]
    # an address that only a deleted source has is free
    free = enrichment.patched_sources(sources, spark.createDataFrame([("a", 1, "u5")], "source_id string, seq long, base_url string"), orgs)
    assert rows(free[2]) == [("a", "updated", None)] and rows(free[1])[0] == ("o", ["x", "u5"])


def test_new_sources_and_outcomes(spark):
    schema = "source_id string, organizer_id string, base_url string, kind string, name string, priority int, crawl_period_days int, last_status string, last_crawled_at string, is_active boolean, deleted_at string"
    sources = spark.createDataFrame([("a", "o", "https://u.ru", "vk_group", "n", 1, 1, None, None, True, None), ("b", "o", "gone", "vk_group", "n", 1, 1, None, None, True, "2024")], schema)
    orgs = spark.createDataFrame([("o", ["k"])], "organizer_id string, site_urls array<string>")
    new = [(1, "o", "https://u.ru", "org_website", None, None, None), (2, "o", "gone", "org_website", None, 5, None), (3, "o", "https://new.ru/", "org_website", None, None, None), (4, "o", "https://new.ru/", "vk_group", "x", None, None), (5, "p", "https://u.ru", "vk_group", None, None, 3)]
    df = spark.createDataFrame(new, "seq int, organizer_id string, base_url string, kind string, name string, priority int, crawl_period_days int")
    out, sites, answers = enrichment.created_sources(sources, df, orgs, F.concat_ws("/", "organizer_id", "base_url"))
    assert rows(answers) == [(1, "a", "exists"), (2, "o/gone", "created"), (3, "o/https://new.ru/", "created"), (4, "o/https://new.ru/", "exists"), (5, "p/https://u.ru", "created")]
    got = {r.source_id: r for r in out.collect()}
    assert len(got) == 5 and (got["o/https://new.ru/"].name, got["o/https://new.ru/"].priority, got["o/https://new.ru/"].crawl_period_days, got["o/https://new.ru/"].last_status) == ("new.ru", 50, 30, "pending")
    assert rows(sites) == [("o", ["k", "gone", "https://new.ru/"])]
    uid = "0f0f0f0f-0000-1111-2222-ABCDEF012345"
    own = spark.createDataFrame([(uid, "pending", None), ("celery", "pending", None)], "source_id string, last_status string, last_crawled_at string")
    told = spark.createDataFrame([(uid, "error", "2024-01-01"), (uid, "success", "2024-01-02"), ("celery", "success", "2024-01-02")], own.schema)
    assert rows(enrichment.crawl_outcomes(own, told)) == [(uid, "success", "2024-01-02"), ("celery", "pending", None)]


@pytest.mark.parametrize("parts", [1, 3])
def test_progress_survives_a_restart(spark, tmp_path, parts):
    """The same rates whether the stream reads all at once or is stopped and started again between files."""
    src = tmp_path / "in"
    src.mkdir()
    lines = [{"run": "r", "ts": f"2024-01-01T{h:02d}:{m:02d}:00.000Z"} for h, m in ((0, 0), (0, 10), (0, 20), (3, 0), (3, 30), (9, 0), (20, 0))] + [{"run": "none", "ts": "2024-01-01T05:00:00.000Z"}]
    work = spark.createDataFrame([("r", k) for k in (1, 2, 3, 4, 5, 6, 7, 8, 8)], "run string, item int")
    for k in range(parts):
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, lines[k * len(lines) // parts : (k + 1) * len(lines) // parts])))
        stream = jobs.progress(spark.readStream.schema("run string, ts timestamp").json(str(src)), work, "run", gap="1 hour", delay="20 hours")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    (src / "end.json").write_text(json.dumps({"run": "end", "ts": "2024-01-05T00:00:00.000Z"}))
    stream = jobs.progress(spark.readStream.schema("run string, ts timestamp").json(str(src)), work, "run", gap="1 hour", delay="20 hours")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = jobs.estimates(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")), "run", gap="1 hour").orderBy("run", "start").collect()
    assert [(r.run, r.n, r.done, r.pending) for r in out] == [("none", 1, 1, None), ("r", 3, 3, 5), ("r", 2, 5, 3), ("r", 1, 6, 2), ("r", 1, 7, 1)]
    assert [round(r.rate, 3) for r in out] == [60.0, 0.15, 0.1, 0.12, 0.14] and out[1].minutes_left == pytest.approx(5 / 0.15) and out[0].minutes_left is None
