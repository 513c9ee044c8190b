"""Joins whose tables are much larger, or whose groups are much denser, than what they are made of."""

import math
import random

from loomspark.operators import matching


def join_rows(df):
    """Rows that the joins of a collected frame have made."""
    found, todo = [], [df._jdf.queryExecution().executedPlan().executedPlan()]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return sum(found)


def test_grams_are_not_broadcast(spark, tmp_path):
    at = str(tmp_path / "keys")  # a file tells its size, which the estimate of the grams follows
    spark.createDataFrame([("a.example.org/1",), ("m.example.org/2",), ("b.example.org",)], "key string").write.parquet(at)
    keys = spark.read.parquet(at)
    out = matching.contained_pairs(keys.selectExpr("split_part(key, '.', 1) AS frag"), "frag", keys, "key")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, out.collect())) == [("a", "a.example.org/1"), ("a", "b.example.org"), ("a", "m.example.org/2"), ("b", "b.example.org")] + [("m", k) for k in ("a.example.org/1", "b.example.org", "m.example.org/2")]


def test_geo_pairs_measure_two_places_once(spark):
    p = spark.range(700).selectExpr("id AS point_id", "55.0D + id % 2 AS lat", "37.0D AS lon")
    c = spark.range(300).selectExpr("id AS centre_id", "55.01D AS lat", "37.01D AS lon")
    out = matching.geo_pairs(p, c, 10.0)
    assert len(out.collect()) == 350 * 300
    assert 0 < join_rows(out) < 100


def test_geo_pairs_are_a_nested_loop_however_ids_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(matching, "GATHERED", 3)
    monkeypatch.setattr(matching, "DEALT", 5)
    r = random.Random(4)
    spots = [(55 + r.random() / 4, 37 + r.random() / 4) for _ in range(12)] + [(0.0, 179.99), (-0.0, -179.99), (None, 1.0), (float("nan"), 2.0)]
    points = [(k if k % 50 else None, *r.choice(spots[:3] if k % 2 else spots)) for k in range(200)] + [(7, *spots[0])] * 2
    centres = [(1000 + k, *r.choice(spots)) for k in range(60)] + [(None, *spots[1])]

    def metres(a, b):
        x = [math.radians(v) for v in (*a, *b)]
        h = math.sin((x[0] - x[2]) / 2) ** 2 + math.cos(x[0]) * math.cos(x[2]) * math.sin((x[1] - x[3]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(min(h, 1.0)))

    told = lambda row: row[1] is not None and row[1] == row[1]
    want = sorted(((p[0], c[0]) for p in points for c in centres if told(p) and told(c) and metres(p[1:], c[1:]) <= 9000), key=str)
    got = matching.geo_pairs(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(centres, "centre_id long, lat double, lon double"), 9.0)
    assert sorted(((x.point_id, x.centre_id) for x in got.collect()), key=str) == want and len(want) > 1000
