"""Rows to entities: filters on entities, grouping, roll-ups, funnels, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.sources.shared import new_folder


def entity_key(*keys: Column) -> Column:
    """The first key that is not blank; null if all are."""
    return F.coalesce(*[F.nullif(F.trim(k.cast("string")), F.lit("")) for k in keys])


def keep_entities(rows: DataFrame, key: str, match: Column) -> DataFrame:
    """All rows of every entity of which any row matches; keys are made distinct before they meet the rows, which are computed for both sides."""
    hit = rows.filter(match & F.col(key).isNotNull()).select(key).distinct()
    return rows.join(hit, key, "left_semi")


def grouped_entities(rows: DataFrame, key: str, order: list[str], first: list[str], sets: list[str] = (), members: list[str] = ()) -> DataFrame:
    """One row per entity: attributes of its first row, sorted sets, row count, place of the first row.

    Blank keys are dropped before the shuffle, so they never meet in one task. Members
    are listed only if asked for; roll-ups alone stay small.
    """
    at = F.struct(*order)
    out = [F.min_by(F.struct(*first), at).alias("_first"), F.count("*").alias("n_rows"), F.min(at).alias("_at")]
    out += [F.sort_array(F.collect_set(c)).alias(f"all_{c}") for c in sets]
    if members:
        out.append(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.struct(*members).alias("row")))), lambda x: x["row"]).alias("members"))
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*out).select(key, "_first.*", "n_rows", "_at", *[f"all_{c}" for c in sets], *(["members"] if members else []))


def best_member(winner: Column, amount: Column, budget: Column, order: list[str], row: Column) -> Column:
    """An aggregate: the winner of the largest amount, else the row of the largest budget; nulls are 0, ties go to the first."""
    rank = F.struct(winner.cast("int"), F.coalesce(F.when(winner, amount).otherwise(budget), F.lit(0.0)), *[-F.col(c) for c in order])
    return F.max_by(row, rank)


def funnel(rows: DataFrame, stages: list[tuple[str, Column]], key: str) -> DataFrame:
    """Rows and entities that are left after each stage; rows without a key are in no entity.

    Rows are counted by entity first, in each task before the shuffle, so that one short row for each is left.
    """
    left, counts = F.lit(True), [F.count("*").alias("total_rows")]
    for name, keep in stages:
        left = left & F.coalesce(keep, F.lit(False))
        counts.append(F.count_if(left).alias(f"{name}_rows"))
    each = rows.groupBy(key).agg(*counts)
    names = ["total", *[name for name, _ in stages]]
    return each.agg(*[x for n in names for x in (F.coalesce(F.sum(f"{n}_rows"), F.lit(0)).alias(f"{n}_rows"), F.count_if((F.col(f"{n}_rows") > 0) & F.col(key).isNotNull()).alias(f"{n}_entities"))])


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with their place in the order, from 1, as column `name`: by ranges, each of which starts after those before it."""
    at = new_folder(rows.sparkSession, "numbered")
    rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).write.parquet(at)
    stored = rows.sparkSession.read.schema(rows.schema.add("_part", "integer")).parquet(at)
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_size"))  # a row for each range
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(order))
    return stored.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + place).drop("_part", "_start")


def overlap(rows: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """How many entities match both filters, the first only, the second only."""
    flags = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.bool_or(F.coalesce(a, F.lit(False))).alias("a"), F.bool_or(F.coalesce(b, F.lit(False))).alias("b"))
    return flags.agg(F.count_if(F.expr("a and b")).alias("both"), F.count_if(F.expr("a and not b")).alias("only_first"), F.count_if(F.expr("b and not a")).alias("only_second"))


def in_both(rows: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    return rows.filter(a).select(key).intersect(rows.filter(b).select(key))


def first_per(rows: DataFrame, key: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark cuts each task's rows to n before the shuffle."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)


def last_writes(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key."""
    return first_per(rows, key, [F.col(seq).desc()]).drop("_rank")


def early_stop(rows: DataFrame, key: str, order: str, strong: Column, most: int) -> DataFrame:
    """Candidates in order, at most `most`, up to the first strong one and with it."""
    w = W.partitionBy(key).orderBy(order)
    before = F.coalesce(F.max(strong.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_b", before).withColumn("_n", F.row_number().over(w)).filter((F.col("_b") == 0) & (F.col("_n") <= most)).drop("_b", "_n")


def merge_pages(pages: DataFrame, site: str, order: str, text: str, per_page: int = 15_000, budget: int = 30_000, mark: str = "\n\n---\n\n") -> DataFrame:
    """One text per site: pages in order, each cut, until the budget would be passed; the first always stays.

    Which pages stay follows from lengths alone, so that only (site, order, length) is sorted by site; texts are
    joined afterwards, and those of pages that do not stay never leave their task. Of pages of one site and place the longest counts.
    """
    cut = F.substring(F.coalesce(F.col(text), F.lit("")), 1, per_page)
    w = W.partitionBy(site).orderBy(order)
    mark_of = F.struct(F.length(cut).alias("_l"), F.xxhash64(cut).alias("_h"))
    run = pages.groupBy(site, order).agg(F.max(mark_of).alias("_m")).select(site, order, "_m._l", "_m._h").withColumn("_sum", F.sum("_l").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    kept = run.filter((F.col("_sum") <= budget) | (F.col("_n") == 1)).select(F.col(site).alias("_site"), F.col(order).alias("_order"), "_h", "_n")
    texts = pages.select(site, order, cut.alias("_t"))
    rows = kept.join(texts, F.col("_site").eqNullSafe(F.col(site)) & F.col("_order").eqNullSafe(F.col(order)) & (F.col("_h") == F.xxhash64("_t")))
    parts = F.array_sort(F.collect_set(F.struct("_n", "_t")))
    return rows.groupBy(site).agg(F.array_join(F.transform(parts, lambda p: p["_t"]), mark).alias("merged"), F.size(parts).cast("long").alias("n_pages"))


def sample_rows(rows: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that depends on ids and the seed only; Spark keeps n rows per task."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")), id_col).limit(n)


def page_of(rows: DataFrame, order: list, page: int, per_page: int, cap: int = 100) -> DataFrame:
    """One page of a sorted list."""
    size = min(per_page, cap)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def page_meta(rows: DataFrame, page: int, per_page: int, cap: int = 100) -> DataFrame:
    size = min(per_page, cap)
    return rows.agg(F.count("*").alias("total")).select("total", F.lit(page).alias("page"), F.lit(size).alias("per_page"), F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("last_page"))
