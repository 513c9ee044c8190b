"""Mixing sources to target weights: weighted fair queueing, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_SQL, fresh, stored, text_key

BUCKETS = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size), one a source.

    Sources in code-point order, null last, weigh `weights`, repeating. They
    share `share` times the total by weight; none gets over `most` times its
    size, and the excess is reshared by weight. The fixed point of resharing
    is min(cap, level * weight), where the level follows from running sums in
    the order of cap / weight. The table has a row per source only.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "i")
    before, whole = by_cap.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    ranked = ranked.withColumn("budget", F.sum("source_size").over(whole) * share)
    ranked = ranked.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.col("budget") - F.col("full")) / F.col("left")  # if this source and all after it are below their caps
    ranked = ranked.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).over(whole))
    return ranked.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _placed(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int, buckets: int, keep_rows: bool) -> DataFrame:
    """Documents with lane (a key of the source that is never null), target, and `at`: the source's words before them."""
    row = [F.struct(*docs.columns).alias("row")] if keep_rows else []
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_SQL)), F.lit(0)).cast("long").alias("size"), text_key().alias("key"), *row)
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lower(F.hex("key"))).cast("binary"))
    place = F.conv(F.substring(place, 1, 15), 16, 10).cast("long")
    # with this key the window and the join below share one shuffle
    lane = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("lane")
    sized = sized.withColumn("place", place).withColumn("bucket", F.pmod("place", F.lit(buckets)).cast("int")).withColumn("lane", lane)
    sized = sized if keep_rows else stored(sized, "sizes")  # whole rows are read from docs again instead of being written
    parts = stored(sized.groupBy("lane", "source", "bucket").agg(F.sum("size").alias("bucket_size")), "parts")
    goal = targets(parts.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    order = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(order), F.lit(0))).drop("bucket_size")
    starts = starts.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    inside = W.partitionBy("lane", "bucket").orderBy("place", "doc_id", "size", "key").rowsBetween(W.unboundedPreceding, -1)
    rows = sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(starts, ["lane", "bucket"]).withColumn("at", F.col("bucket_start") + F.col("before")).select("doc_id", "source", "lane", "size", "source_size", "target", "at", *(["row"] if keep_rows else []))


def _start(k: int) -> Column:
    return F.col("at") + k * F.col("source_size")


def _finish(k: int) -> Column:
    """Virtual finish time of a document's k-th pass: the source's words up to its end over the source's target."""
    return F.try_divide((_start(k) + F.col("size")).cast("double"), "target")


def cut_of(rows: DataFrame, budget: int, most: int, ranges: int = 4096, few: int = 10_000) -> tuple[float, str, int] | None:
    """(finish, lane, words) of the pass in which the running total, in the order of finish time and lane, comes to the budget.

    The order is global. Time is cut into `ranges` equal ranges, whose sums (no more than
    that many numbers) tell in which of them the budget ends; this range is
    cut again, until it holds at most `few` passes or one time only. words is how
    many of that pass are in the budget. None if there are no words at all.
    """
    passes = rows.filter("size > 0").select("lane", "size", F.explode(F.array(*[_finish(k) for k in range(most)])).alias("finish"))
    span = passes.agg(F.min("finish"), F.max("finish")).first()
    before, lo, hi = 0, span[0], span[1]
    if lo is None or budget < 1:
        return None
    while True:
        at = F.least(F.floor((F.col("finish") - lo) / ((hi - lo) / ranges)), F.lit(ranges - 1)) if hi > lo else F.lit(0)
        sums = passes.groupBy(at.alias("at")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("finish").alias("lo"), F.max("finish").alias("hi")).orderBy("at").collect()
        for one in sums:
            if before + one["size"] >= budget or one is sums[-1]:
                break
            before += one["size"]
        passes, lo, hi = passes.filter(at == one["at"]), one["lo"], one["hi"]
        if one["n"] <= few or lo == hi:
            break
    upto = F.sum("size").over(W.orderBy("finish", "lane").rowsBetween(W.unboundedPreceding, 0))
    last = passes.withColumn("upto", upto + before).filter(F.col("upto") >= budget).orderBy("finish", "lane").first()
    return last["finish"], last["lane"], last["size"] - (last["upto"] - budget)


def schedule(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7, buckets: int = BUCKETS, keep_rows: bool = False) -> DataFrame:
    """Fair-queueing times of all documents.

    Within its source every document stands at a shuffled place, by a hash of
    its id and text. It is served once per pass, at most `most`
    passes; the finish time of a pass is the source's words up to its end
    divided by the source's target. All passes of all sources are in one order, by
    finish time (ties: by source), and those within the total budget, `share` times all words, are
    taken; the one in which the budget ends is cut within. About time 1 every source has given
    its target, but for the document that it is at. `taken` is the number of a document's words in the mix.

    Returns doc_id, source, size, source_size, target, taken and times (an
    array of start, finish and words per pass); with keep_rows also `row`, a
    struct of all columns. Null texts have size 0 and take 0; null ids and
    repeated rows are documents like others; equal rows are interchangeable,
    so that reruns agree. An empty table gives no rows.

    No window holds a source: running sums come from sums per (source, hash
    bucket), of which there are `buckets` per source, and within one bucket. Windows over sources hold one row for each source.
    """
    options = (weights, share, most, seed, buckets)
    rows = stored(_placed(docs, *options, False), "places")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cut = cut_of(rows, int(min(share, most) * total + 1e-6), most)
    rows = _placed(docs, *options, True) if keep_rows else rows

    def served(k):
        words = F.lit(0)
        if cut:
            earlier = (_finish(k) < cut[0]) | ((_finish(k) == cut[0]) & (F.col("lane") < cut[1]))
            words = F.when(F.col("size") == 0, 0).when(earlier, F.col("size")).when((_finish(k) == cut[0]) & (F.col("lane") == cut[1]), cut[2]).otherwise(0)
        return F.struct(F.try_divide(_start(k).cast("double"), "target").alias("start"), _finish(k).alias("finish"), words.cast("long").alias("words"))

    rows = rows.withColumn("times", F.array(*[served(k) for k in range(most)]))
    taken = sum((F.col("times")[k]["words"] for k in range(most)), F.lit(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "times", *(["row"] if keep_rows else []))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: all columns of docs plus pass, virtual_finish and words (with a "_" before these names where docs has them).

    One row per document and pass that is served before the budget ends, in
    the global order of virtual finish time (a range partitioning). A row
    whose `words` is under its size is the one that the budget cuts; its text
    holds the first `words` words, with their spacing. Null and empty texts are
    never served; an empty table gives no rows.
    """
    turn, finish, words = fresh(docs, "pass", "virtual_finish", "words")
    plan = schedule(docs, keep_rows=True, **options)
    rows = plan.select("row", "size", F.posexplode("times").alias("turn", "time")).filter("time.words > 0")
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("time.words").cast("int")), "")
    text = F.when(F.col("time.words") < F.col("size"), cut).otherwise(F.col("row.text"))
    own = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    out = rows.select(*own, F.col("turn").cast("int").alias(turn), F.col("time.finish").alias(finish), F.col("time.words").alias(words))
    return out.orderBy(finish, "doc_id")
