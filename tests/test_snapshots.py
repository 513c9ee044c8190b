"""Bucketed snapshots: what is rewritten, what replays and lost writers leave, and event imports on top."""

import pytest
from pyspark.sql import functions as F

from loomspark.operators import event_import, merging
from loomspark.sources.snapshots import Snapshot
from loomspark.streaming import jobs

TABLES = {"a": ("id long, name string", "id"), "b": ("owner long, n int", "owner")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def batch(spark, *pairs):
    return spark.createDataFrame([(i, n, k) for k, (i, n) in enumerate(pairs)], "id long, name string, seq long")


def put(store, epoch, new, fail=False):
    def change(old):
        b = new.select(F.col("id").alias("owner"), F.lit(epoch).alias("n"))
        if fail:
            b = b.withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
        return {"a": merging.upsert(old["a"], new, ["id"], "seq"), "b": old["b"].unionByName(b)}

    return store.commit(epoch, new.select("id"), change)


def files(root, table):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.glob(f"data/*/{table}/*/*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path), TABLES, buckets=8)
    assert store.last() is None and store.read("a").collect() == []
    assert put(store, 0, batch(spark, *[(k, "x") for k in range(100)]))
    first = files(tmp_path, "a")
    assert len(first) == 8
    assert put(store, 1, batch(spark, (5, "y"), (5, "z"), (200, "new")))
    second = {k: v for k, v in files(tmp_path, "a").items() if k not in first}
    touched = {r[0] for r in spark.createDataFrame([(5,), (200,)], "id long").select(store.bucket_of("id")).collect()}
    assert {int(k.split("loom_bucket=")[1].split("/")[0]) for k in second} == touched and len(touched) < 8
    assert {k: v for k, v in files(tmp_path, "a").items() if k in first} == first  # none rewritten
    assert rows(store.read("a")) == sorted([(k, "z" if k == 5 else "x") for k in range(100)] + [(200, "new")], key=str)
    assert rows(store.read("a", epoch=0)) == sorted([(k, "x") for k in range(100)], key=str)  # an older version stays readable
    # a replay, and a batch older than the last, change nothing
    before = sorted(str(p) for p in tmp_path.rglob("*"))
    assert not put(store, 1, batch(spark, (5, "again"))) and not put(store, 0, batch(spark, (5, "again")))
    assert sorted(str(p) for p in tmp_path.rglob("*")) == before


def test_lost_writers_and_dropped_versions(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path), TABLES, buckets=4)
    put(store, 0, batch(spark, (1, "x"), (2, "x")))
    with pytest.raises(Exception, match="lost"):
        put(store, 1, batch(spark, (1, "y"), (3, "y")), fail=True)  # the first table is written, the second fails
    assert store.versions() == [0] and rows(store.read("a")) == [(1, "x"), (2, "x")] and rows(store.read("b")) == [(1, 0), (2, 0)]
    assert put(store, 1, batch(spark, (1, "y"), (3, "y")))
    want = [(1, "y"), (2, "x"), (3, "y")]
    assert rows(store.read("a")) == want and rows(store.read("b")) == [(1, 0), (1, 1), (2, 0), (3, 1)]
    put(store, 2, batch(spark))  # an empty batch is a version too
    assert store.versions() == [0, 1, 2] and rows(store.read("a")) == want
    assert store.drop_before(99) >= 2  # what the lost writer left, and buckets that later versions replaced
    assert store.versions() == [2] and rows(store.read("a")) == want and store.drop_before(99) == 0
    named = {r.path for r in store._manifest().collect()}
    assert {str(p.parent.relative_to(tmp_path)) for p in tmp_path.glob("data/*/*/*/*.parquet")} == named
    with pytest.raises(ValueError, match="buckets"):
        Snapshot(spark, str(tmp_path), TABLES, buckets=5).read("a")


def test_rows_must_stay_in_their_buckets(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path), TABLES, buckets=64)
    with pytest.raises(ValueError, match="left their buckets"):
        store.commit(0, spark.range(1), lambda old: {"a": spark.createDataFrame([(k, "") for k in range(50)], "id long, name string")})
    assert store.last() is None


def test_streams_keep_few_versions(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(5):
        (src / f"{k}.json").write_text(f'{{"id": 1, "name": "n{k}", "seq": {k}}}\n{{"id": {k + 10}, "name": "x", "seq": {k}}}\n')
        stream = spark.readStream.schema("id long, name string, seq long").json(str(src))
        jobs.continuous_import(stream, spark, str(tmp_path / "t"), ["id"], "seq", str(tmp_path / "cp"), keep=2).trigger(availableNow=True).start().awaitTermination()
    store = Snapshot(spark, str(tmp_path / "t"), {"rows": ("id long, name string", "id")})
    assert store.versions() == [3, 4]
    assert rows(store.read("rows")) == sorted([(1, "n4")] + [(k + 10, "x") for k in range(5)], key=str)


def payload(**given):
    base = {"seq": 1, "organizer_id": "o", "source_reference": "r", "title": "T", "score": 0.9, "works_with_elderly": True, "start_datetime": "s1", "end_datetime": "e1"}
    return base | given


def test_event_import(spark, tmp_path):
    owners = spark.createDataFrame([("o", "org"), ("p", None)], "organizer_id string, organization_id string")
    known = spark.createDataFrame([("c1", "1", "one"), ("c2", "2", None), ("c3", "3", "1")], "category_id string, code string, slug string")
    store = event_import.store(spark, str(tmp_path / "t"), 8)

    def send(epoch, *payloads):
        df = spark.createDataFrame([tuple(p.get(f.split()[0]) for f in event_import.PAYLOAD.split(", ")) for p in payloads], event_import.PAYLOAD)
        return event_import.import_batch(store, epoch, df, owners, known)

    def get(table, *cols):
        return rows(store.read(table).select(*cols))

    assert send(0, payload(category_codes=["1", "nope"], venue_ids=["v"]), payload(organizer_id="p", decision="needs_review"), payload(title=" ", source_reference="x"), payload(source_reference=None))
    assert get("events", "organizer_id", "organization_id", "title", "status") == [("o", "org", "T", "approved"), ("p", None, "T", "pending_review")]
    assert get("categories", "category_id") == [("c1",), ("c3",)] and get("venues", "venue_id") == [("v",)]  # "1" is one's code and another's slug
    # later payloads: fields and sets follow the last one, an empty list leaves the set, every period is an instance once
    assert send(1, payload(seq=3, title="U", category_codes=["2"]), payload(seq=4, title="V", category_codes=[], score=0.1), payload(seq=2, title="W", end_datetime="e2"), payload(seq=5, title="X", start_datetime=None))
    assert get("events", "organizer_id", "title", "status") == [("o", "X", "approved"), ("p", "T", "pending_review")]
    assert get("categories", "category_id") == [("c2",)] and get("venues", "venue_id") == [("v",)]
    assert get("instances", "start_datetime", "end_datetime", "status") == [("s1", "e1", "scheduled"), ("s1", "e1", "scheduled"), ("s1", "e2", "scheduled")]
    assert not send(1, payload(title="Z")) and get("events", "title") == [("T",), ("X",)]
    assert send(2, payload(category_codes=["nope"])) and get("categories", "category_id") == []  # only unknown codes: an empty set
    assert len({r.event_id for r in store.read("events").collect()}) == 2


def test_event_import_shows_all_or_nothing(spark, tmp_path, monkeypatch):
    owners = spark.createDataFrame([], "organizer_id string, organization_id string")
    known = spark.createDataFrame([], "category_id string, code string, slug string")
    store = event_import.store(spark, str(tmp_path / "t"), 4)
    df = spark.createDataFrame([tuple(payload().get(f.split()[0]) for f in event_import.PAYLOAD.split(", "))], event_import.PAYLOAD)
    whole = event_import.imported

    def broken(*args):
        out = whole(*args)
        return out | {"instances": out["instances"].withColumn("status", F.raise_error(F.lit("lost")).cast("string"))}

    monkeypatch.setattr(event_import, "imported", broken)
    with pytest.raises(Exception, match="lost"):
        event_import.import_batch(store, 0, df, owners, known)
    assert store.last() is None and all(store.read(t).count() == 0 for t in event_import.TABLES)
    monkeypatch.undo()
    assert event_import.import_batch(store, 0, df, owners, known) and store.read("instances").count() == 1
