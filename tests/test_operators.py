"""Operators on tiny tables: merges, matching, windows, files and streams."""

import json

from pyspark.sql import functions as F

from loomspark.operators import grouping, matching, merging, reports
from loomspark.sources import pages, tables
from loomspark.streaming import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_groups_keep_the_first_row_and_drop_blank_keys(spark):
    df = spark.createDataFrame([(0, "7701234567", "A"), (1, "7701234567", "B"), (2, "", "C"), (3, None, "D")], "row_no long, inn string, name string")
    out = grouping.grouped_entities(df.withColumn("k", grouping.entity_key(F.col("inn"))), "k", ["row_no"], ["name"], sets=["name"], members=["name"]).first()
    assert (out.k, out.name, out.n_rows, out.all_name, [m.name for m in out.members]) == ("7701234567", "A", 2, ["A", "B"], ["A", "B"])


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, v long")
    batch = spark.createDataFrame([(2, None, 5, 1), (2, "c", 6, 2), (3, "d", 7, 1)], "id long, name string, v long, seq long")
    once = merging.upsert(old, batch, ["id"], "seq")
    assert rows(once) == [(1, "a", 1), (2, "c", 6), (3, "d", 7)] == rows(merging.upsert(once, batch, ["id"], "seq"))
    clear = spark.createDataFrame([(1, None, 9, 1)], "id long, name string, v long, seq long")
    assert rows(merging.upsert(old, clear, ["id"], "seq"))[0] == (1, None, 9)
    assert rows(merging.upsert(old, clear, ["id"], "seq", overwrite_nulls=False))[0] == (1, "a", 9)


def test_containment_is_a_nested_loop(spark):
    a = ["site.ru", "abc", "x", "fond", "nothing-here"]
    b = ["site.ru/a", "abcdef", "my-fond.org", "si", "xx"]
    out = matching.contained_pairs(spark.createDataFrame([(x,) for x in a], "p string"), "p", spark.createDataFrame([(x,) for x in b], "q string"), "q")
    assert rows(out) == sorted((x, y) for x in a for y in b if x in y or y in x)


def test_entities_over_two_ids_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, "b", None), (5, None, None)], "id long, inn string, ogrn string")
    want = [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    for n in (1, 7):
        assert rows(matching.resolve_entities(df.repartition(n), "id", ["inn", "ogrn"])) == want


def test_geo_pairs_cross_the_date_line(spark):
    p = spark.createDataFrame([(1, 60.0, 179.99), (2, 60.0, -179.99), (3, 10.0, 0.0), (4, None, 1.0)], "point_id long, lat double, lon double")
    out = matching.geo_pairs(p, p.withColumnRenamed("point_id", "centre_id"), 5.0)
    assert rows(out.select("point_id", "centre_id")) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_early_stop_and_budget(spark):
    df = spark.createDataFrame([("s", 1, False), ("s", 2, True), ("s", 3, True)], "k string, pos long, strong boolean")
    assert [r.pos for r in grouping.early_stop(df, "k", "pos", F.col("strong"), 5).collect()] == [1, 2]
    pg = spark.createDataFrame([("s", 1, "a" * 50), ("s", 2, "b" * 30), ("t", 1, None)], "site string, n long, text string")
    assert rows(grouping.merge_pages(pg, "site", "n", "text", per_page=40, budget=60, mark="|")) == [("s", "a" * 40, 1), ("t", "", 1)]


def test_recurrence(spark):
    df = spark.createDataFrame([(1, "2025-01-01", "FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,TH;COUNT=4"), (2, "2025-01-01", "FREQ=DAILY;UNTIL=20250103"), (3, "2025-01-01", "FREQ=WEEKLY")], "event_id long, d string, rule string")
    out = merging.occurrences(df.select("event_id", F.to_date("d").alias("start_date"), "rule"), F.lit("2025-01-01").cast("date"), 15)
    got = [(r[0], str(r[1])) for r in out.collect()]
    assert sorted(got) == [(1, "2025-01-02"), (1, "2025-01-14"), (1, "2025-01-16"), (2, "2025-01-01"), (2, "2025-01-02"), (2, "2025-01-03"), (3, "2025-01-01"), (3, "2025-01-08"), (3, "2025-01-15")]


def test_reports_partition_their_rows(spark):
    base = spark.range(10).withColumnRenamed("id", "k")
    f = reports.flagged(base, "k", {"a": base.filter("k % 2 = 0"), "b": base.filter("k > 5").union(base.filter("k > 5"))})
    assert f.count() == 10 and f.filter("a and b").count() == 2
    assert sum(r.n for r in reports.combinations(f, ["a", "b"]).collect()) == 10


def test_registry_files(spark, tmp_path):
    (tmp_path / "nco.csv").write_text(",".join(tables.NCO_COLUMNS) + "\n7701234567, ДОБРО ,,Москва,1,,88.10,,,,,,\n12,short,,,,,,,,,,,\n", encoding="utf-8")
    got = tables.read_nco_registry(spark, str(tmp_path / "nco.csv")).collect()
    assert [(r.inn, r.full_name, r.short_name, r.okved) for r in got] == [("7701234567", "ДОБРО", None, "88.10")]
    (tmp_path / "g.csv").write_text(",".join(tables.GRANT_COLUMNS) + "\n24-1-001234,к,Орг,1,7701234567,р,т,н,5000000,н/д,2024-03-01,01.03.2025\n", encoding="utf-8")
    r = tables.read_grants(spark, str(tmp_path / "g.csv")).first()
    assert (r.budget_requested, r.budget_total, str(r.start_date), r.end_date, r.status) == (5e6, None, "2024-03-01", None, "")
    (tmp_path / "w.json").write_text(json.dumps([{"id": "1", "base_url": "https://a.ru"}, {"id": "2"}]))
    got = tables.read_work_list(spark, str(tmp_path / "w.json"), ["url"]).orderBy("id").collect()
    assert (got[0].url, got[0].missing, got[1].missing) == ("https://a.ru", [], ["url"])


def test_answers_and_hits(spark):
    df = spark.createDataFrame([('```json\n{"decision": "accepted"}\n```',), ('Вот: {"decision": "rejected"} всё',), ("it is accepted",), (None,)], "a string")
    out = df.select(tables.parsed_answer(F.col("a"), "decision string").alias("p"), tables.answer_decision(F.col("a")).alias("d")).collect()
    assert [r.p and r.p.decision for r in out] == ["accepted", "rejected", None, None] and [r.d for r in out][2:] == ["accepted", "rejected"]
    xml = "<yandexsearch><response><results><grouping><group><doc><url>https://a.ru</url><title>Дом <hlword>A</hlword></title><passages><passage>x</passage><passage>y</passage></passages></doc></group><group><doc><url>https://b.ru</url><title>B</title></doc></group></grouping></results></response></yandexsearch>"
    hits = tables.search_hits(spark.createDataFrame([(1, xml)], "q long, x string"), "x", "q").collect()
    assert [(h.position, h.url, h.title) for h in hits] == [(1, "https://a.ru", "Дом A"), (2, "https://b.ru", "B")] and hits[0].snippet == "x y"


def test_run_log_skips_broken_lines(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    (path / "a.json").write_text('{"org_id": "1", "tier": "auto"}\n\n{broken\n{"tier": "review"}\n{"org_id": "2", "tier": "auto"}\n')
    assert sorted(r.org_id for r in tables.read_run_log(spark, str(path)).collect()) == ["1", "2"]


def test_pages(spark):
    html = '<html><head><title>T</title><script>var t="</p>"</script></head><body><h2>H</h2><p>one <a href="/x">two</a></p></body></html>'
    r = pages.page_records(spark.createDataFrame([(1, "u", html), (2, "v", None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert (r[0].title, r[0].headings, r[0].links[0].href, r[0].links[0].label) == ("T", ["H"], "/x", "two") and r[1].links == []
    text = "вступление\n## Один\nтекст 1\n### Два\nтекст 2"
    got = pages.sections(spark.createDataFrame([(1, text), (2, "x" * 101), (3, "x")], "k long, t string"), "t", ["k"]).collect()
    assert [(s.k, s.title) for s in got] == [(1, "Один"), (1, "Два"), (2, "x" * 101)]


def test_streams_equal_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [{"org_id": str(k % 5), "tier": "auto" if k % 5 < 3 else "review", "ts": f"2024-01-01T00:{k:02d}:00.000Z"} for k in range(20)]
    (src / "a.json").write_text("\n".join(map(json.dumps, lines)))
    q = jobs.live_run_log(spark, str(src)).writeStream.outputMode("complete").format("memory").queryName("log_n").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("log_n")) == [("auto", 3), ("review", 2)]


def test_continuous_import_replays_change_nothing(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "id long, name string, seq long"
    (src / "a.json").write_text('{"id": 1, "name": "a", "seq": 1}\n{"id": 1, "name": "b", "seq": 2}\n')
    for k in (1, 2):
        if k == 2:
            (src / "b.json").write_text('{"id": 2, "name": "c", "seq": 3}\n{"id": 1, "name": "b", "seq": 2}\n')
        q = jobs.continuous_import(spark.readStream.schema(schema).json(str(src)), spark, str(tmp_path / "t"), ["id"], "seq", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert rows(jobs.read_snapshot(spark, str(tmp_path / "t"), "id long, name string")) == [(1, "b"), (2, "c")]


def test_windowed_metrics_stream(spark, tmp_path):
    df = spark.range(6).select(F.timestamp_seconds(F.col("id") * 1800).alias("ts"), (F.col("id") % 2 == 0).alias("ok"), F.lit("accepted").alias("decision"), F.lit(0.5).alias("confidence"), F.lit(1).alias("tokens_in"), F.lit(1).alias("tokens_out"), F.lit(1.0).alias("seconds"))
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = jobs.windowed_metrics(spark.readStream.schema(df.schema).parquet(str(tmp_path / "p")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("wm").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.total for r in spark.table("wm").collect()] == [2, 2]
