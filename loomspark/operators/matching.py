"""Joins: match or create, containment, consistency, dictionaries, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.sources.shared import new_folder

# The most ids of one place that travel together; the points of a cell, or about, that are dealt out together.
GATHERED, DEALT = 256, 4096


def match_or_create(rows: DataFrame, known: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """rows plus matched id by the first key that finds one, and the action: matched or created.

    known has one id per key at most after the least id is taken. Null keys match nothing and are
    kept out of the shuffle's hot spots by their own branch of the join.
    """
    out = rows
    for k in keys:
        side = known.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_k_{k}")).agg(F.min(id_col).alias(f"_by_{k}"))
        out = out.join(side, F.col(k) == F.col(f"_k_{k}"), "left").drop(f"_k_{k}")
    found = F.coalesce(*[F.col(f"_by_{k}") for k in keys])
    return out.withColumn("matched_id", found).withColumn("action", F.when(found.isNull(), "created").otherwise("matched")).drop(*[f"_by_{k}" for k in keys])


def contained_pairs(a: DataFrame, a_key: str, b: DataFrame, b_key: str, q: int = 4) -> DataFrame:
    """All (a_key, b_key) where one text holds the other, each once.

    The shorter text goes by its rarest q-gram, the longer by all of its
    q-grams; whatever holds it has that one too. Texts under q characters are
    compared with every text that has their gram of that length. Both ways are exact.
    Grams are many times larger than their texts, which Spark's estimates do not know:
    the joins are merge joins, so that none of them goes through the driver.
    """
    left, right = a.select(F.col(a_key).alias("s")).filter("s <> ''").distinct(), b.select(F.col(b_key).alias("s")).filter("s <> ''").distinct()

    def grams(df: DataFrame, size: Column) -> DataFrame:
        places = F.sequence(F.lit(1), F.greatest(F.length("s") - size + 1, F.lit(1)))
        return df.select("s", F.explode(F.array_distinct(F.transform(places, lambda i: F.substr("s", i, size)))).alias("gram"))

    def one_way(probe: DataFrame, build: DataFrame) -> DataFrame:
        every = grams(build, F.lit(q))
        counts = every.groupBy("gram").agg(F.count("*").alias("n"))
        long = grams(probe.filter(F.length("s") >= q), F.lit(q)).join(counts.hint("merge"), "gram")
        rarest = long.groupBy("s").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
        pairs = rarest.select(F.col("s").alias("p"), "gram").join(every.select(F.col("s").alias("t"), "gram").hint("merge"), "gram")
        for size in range(1, q):
            short = probe.filter(F.length("s") == size).select(F.col("s").alias("p"), F.col("s").alias("gram"))
            pairs = pairs.unionByName(short.join(grams(build, F.lit(size)).select(F.col("s").alias("t"), "gram").hint("merge"), "gram"))
        return pairs.filter(F.col("t").contains(F.col("p"))).select("p", "t")

    there = one_way(left, right).select(F.col("p").alias(a_key), F.col("t").alias(b_key))
    back = one_way(right, left).select(F.col("t").alias(a_key), F.col("p").alias(b_key))
    return there.union(back).distinct()


def dictionary_match(terms: DataFrame, term: str, dictionary: DataFrame, name: str, position: str) -> DataFrame:
    """(term, match): the dictionary's equal name, else its first that is equal or contains, or is contained, but for case and marks.

    Terms are matched once each: equal names by a join, and only the others by contained_pairs().
    """
    bare = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""))
    t = terms.select(F.col(term).alias("term")).filter("term is not null").distinct().withColumn("_t", bare(F.col("term")))
    d = dictionary.select(F.col(name).alias("_name"), F.col(position).alias("_pos")).withColumn("_d", bare(F.col("_name")))
    t = t.join(d.select(F.col("_name").alias("term"), F.col("_name").alias("equal")).distinct(), "term", "left")
    rest = t.filter("equal is null").select("term", "_t")
    close = contained_pairs(rest, "_t", d, "_d").join(d, "_d").groupBy("_t").agg(F.min_by("_name", "_pos").alias("close"))
    return t.filter("equal is not null").select("term", F.col("equal").alias("match")).union(rest.join(close, "_t", "left").select("term", "close"))


def link_consistency(owners: DataFrame, id_col: str, listed: str, links: DataFrame, link_id: str, link_key: str) -> DataFrame:
    """Per owner how many listed keys are linked, missing and extra, and a verdict."""
    a = owners.select(F.col(id_col).alias("id"), F.explode_outer(listed).alias("key")).filter("key is not null").distinct().withColumn("a", F.lit(1))
    b = links.select(F.col(link_id).alias("id"), F.col(link_key).alias("key")).filter("key is not null").distinct().withColumn("b", F.lit(1))
    both = a.join(b, ["id", "key"], "full").groupBy("id").agg(F.count_if(F.expr("a = 1 and b = 1")).alias("linked"), F.count_if(F.expr("b is null")).alias("missing"), F.count_if(F.expr("a is null")).alias("extra"))
    out = owners.select(F.col(id_col).alias("id")).join(both, "id", "left").na.fill(0, ["linked", "missing", "extra"])
    verdict = F.when(F.expr("missing = 0 and extra = 0"), "perfect").when(F.expr("extra = 0"), "missing").when(F.expr("missing = 0"), "extra").otherwise("partial")
    return out.withColumn("verdict", verdict)


def resolve_entities(rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(id, entity): rows that share any non-null key, or are joined by such, have one entity, the least id.

    Labels spread through keys, and each takes its label's label, so that chains get shorter by half,
    until none changes; every round is a table in the cluster's shared folder.
    """
    spark = rows.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        at = new_folder(spark, name)
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    edges = None
    for k in keys:
        part = rows.filter(F.col(k).isNotNull()).select(F.col(id_col).alias("id"), F.concat(F.lit(f"{k}:"), F.col(k).cast("string")).alias("key"))
        edges = part if edges is None else edges.union(part)
    edges = kept(edges.distinct(), "edges")
    label = rows.select(F.col(id_col).alias("id"), F.col(id_col).alias("entity")).distinct()
    while True:
        by_key = edges.join(label, "id").groupBy("key").agg(F.min("entity").alias("low"))
        low = edges.join(by_key, "key").groupBy("id").agg(F.min("low").alias("low"))
        new = label.join(low, "id", "left").select("id", F.least("entity", F.coalesce("low", "entity")).alias("entity"), (F.col("low") < F.col("entity")).alias("changed"))
        new = kept(new, "labels")
        done = new.filter("changed").isEmpty()
        if done:
            return new.select("id", "entity")
        further = new.select(F.col("id").alias("entity"), F.col("entity").alias("next"))
        label = kept(new.join(further, "entity", "left").select("id", F.coalesce("next", "entity").alias("entity")), "labels")


def _gathered(rows: DataFrame, id_col: str, lat: str, lon: str) -> DataFrame:
    """(lat, lon, ids) of rows with a place: at most GATHERED ids of one place each."""
    rows = rows.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(lat, lon, F.struct(F.col(id_col).alias("id")).alias("_id"))
    rows = rows.repartition(lat, lon).sortWithinPartitions(lat, lon, "_id").withColumn("_block", F.floor(F.monotonically_increasing_id() / GATHERED))
    return rows.groupBy(lat, lon, "_block").agg(F.collect_list("_id").alias("_ids")).select(lat, lon, F.transform("_ids", lambda x: x["id"]).alias("ids"))


def geo_pairs(points: DataFrame, centres: DataFrame, km: float) -> DataFrame:
    """(point_id, centre_id, metres) within km, by cells of at least that size: an equi-join on a cell and its neighbours.

    points: point_id, lat, lon; centres: centre_id, lat, lon. Cells are bands of latitude and, within a
    band, steps of longitude that are as long as the radius where the band is narrowest. Nulls match nothing.
    Ids of one place travel together, so that each two places are measured once; a cell's points are dealt
    out by some thousands, so that dense cells are shared among tasks.
    """
    from loomspark.functions.rules import distance

    step = km / 110.0
    band = lambda lat: F.floor(lat / step).cast("long")
    wide = lambda b: step / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.4), F.greatest(F.abs(b * step), F.abs((b + 1) * step))))))
    turn = lambda b: F.greatest(F.lit(1), F.floor(360 / wide(b))).cast("long")
    place = lambda lon, b: F.pmod(F.floor((lon + 180) / (360 / turn(b))).cast("long"), turn(b))
    p = _gathered(points, "point_id", "lat", "lon").withColumnRenamed("ids", "points").withColumn("b", band(F.col("lat"))).withColumn("c", place(F.col("lon"), F.col("b")))
    c = _gathered(centres.select("centre_id", F.col("lat").alias("lat0"), F.col("lon").alias("lon0")), "centre_id", "lat0", "lon0").withColumnRenamed("ids", "centres")
    c = c.withColumn("b", F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: band(F.col("lat0")) + k)))
    c = c.withColumn("c", F.explode(F.array_distinct(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.pmod(place(F.col("lon0"), F.col("b")) + k, turn(F.col("b")))))))
    cells = p.groupBy("b", "c").agg(F.ceil(F.sum(F.size("points")) / DEALT).alias("deals"))
    p = p.join(cells, ["b", "c"]).withColumn("deal", F.pmod(F.xxhash64("lat", "lon", F.get("points", F.lit(0))), "deals")).drop("deals")
    c = c.join(cells, ["b", "c"]).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    tasks, key = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["b", "c", "deal"]  # few bytes make many pairs: their number stays
    near = p.repartition(tasks, *key).join(c.repartition(tasks, *key).hint("merge"), key).withColumn("metres", distance(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0")))
    # a lambda is not in the code that Spark makes for the join, which would hold all pairs of a row of points in memory
    near = near.filter(F.col("metres") <= km * 1000).select("points", F.explode(F.transform("centres", lambda x: x)).alias("centre_id"), "metres")
    return near.select(F.explode("points").alias("point_id"), "centre_id", "metres")


def merge_duplicates(rows: DataFrame, id_col: str, key: str) -> DataFrame:
    """(id, survivor): rows with one non-null key fall to the least id."""
    w = W.partitionBy(key)
    own = F.col(id_col)
    return rows.filter(F.col(key).isNotNull()).select(own.alias("id"), F.min(id_col).over(w).alias("survivor")).union(rows.filter(F.col(key).isNull()).select(own, own))
