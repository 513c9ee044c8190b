"""Duplicates and test data: survivors over several keys, links re-pointed, cascading purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import resolve_entities


def survivors(rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(id, survivor): rows that share any key that is not blank, or are joined by such, fall to the least id.

    Null ids are left out; blank keys join nothing.
    """
    keyed = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[F.nullif(F.trim(F.col(k).cast("string")), F.lit("")).alias(k) for k in keys])
    return resolve_entities(keyed, "id", keys).select("id", F.col("entity").alias("survivor"))


def merged_rows(rows: DataFrame, id_col: str, mapping: DataFrame, fill: list[str], as_of: Column) -> DataFrame:
    """rows where survivors get what they lack in `fill` from the least id that has it, and the others are marked deleted.

    deleted_at is as_of for rows with another survivor, and stays what it was for the rest. Rows that are deleted already
    fill nothing in. Rows that the mapping lacks stay as they are.
    """
    m = mapping.select(F.col("id").alias(id_col), "survivor")
    base = rows if "deleted_at" in rows.columns else rows.withColumn("deleted_at", F.lit(None).cast("timestamp"))
    told = base.join(m, id_col, "left").withColumn("survivor", F.coalesce("survivor", id_col))
    live = told.filter("deleted_at is null")
    given = live.groupBy("survivor").agg(*[F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(id_col))).alias(f"_{c}") for c in fill])
    out = told.join(given.withColumnRenamed("survivor", "_to"), F.col(id_col) == F.col("_to"), "left")
    filled = {c: F.coalesce(c, f"_{c}") for c in fill}
    gone = F.when(F.col("survivor") != F.col(id_col), F.coalesce("deleted_at", as_of.cast("timestamp"))).otherwise(F.col("deleted_at"))
    return out.withColumns(filled).withColumn("deleted_at", gone).drop("_to", *[f"_{c}" for c in fill])


def repointed(links: DataFrame, column: str, mapping: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """links with `column` led to survivors; links that thereby agree in `keys` become one, whose other columns are the aggregates.

    Ids that the mapping lacks stay. A survivor of very many links does not meet them all in one task: they are aggregated
    where they lie first, and Spark splits the join's large partitions.
    """
    moved = mapping.filter("id <> survivor").select(F.col("id").alias("_from"), F.col("survivor").alias("_to"))
    out = links.join(moved, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")
    return out.groupBy(*keys).agg(*[a.alias(c) for c, a in aggregates.items()]) if aggregates else out.select(*keys).distinct()


def surplus_deleted(rows: DataFrame, id_col: str, keys: list[str], as_of: Column) -> DataFrame:
    """rows where of those that agree in all keys (none null) and are not deleted all but the least id get deleted_at.

    The least id is an aggregate by key, joined back, so that a key of very many rows is never sorted in one task.
    """
    live = rows.filter(F.col("deleted_at").isNull() & F.col(id_col).isNotNull())
    least = live.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(id_col).alias("_least"), F.count("*").alias("_n")).filter("_n > 1")
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    out = rows.join(least, on, "left")
    gone = F.col("deleted_at").isNull() & (F.col(id_col) > F.col("_least"))
    return out.withColumn("deleted_at", F.when(gone, as_of.cast("timestamp")).otherwise(F.col("deleted_at"))).drop("_least", "_n", *[f"_{k}" for k in keys])


def purge(tables: dict[str, DataFrame], keys: dict[str, str], graph: list[tuple[str, str, str]], roots: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of every table once the rows of `roots` and all that depends on them are gone, and (table, removed, n_left).

    graph: (table, column, parent) for every column that holds ids of a parent. keys: the id column of each table that is a parent or a root. roots:
    ids to remove, by table, in one column. A row goes if its id is a root's or any of its columns holds an id that goes; a column that
    is null depends on nothing. Tables without a way from a root stay whole. A graph with a circle is an error.
    """
    order: list[str] = []
    while len(order) < len(tables):
        free = [t for t in tables if t not in order and all(p in order for c, _, p in graph if c == t)]
        if not free:
            raise ValueError(f"a circle among {sorted(set(tables) - set(order))}")
        order += free
    gone: dict[str, DataFrame] = {}
    left, counts = {}, None
    for name in order:
        df = tables[name]
        hits = [(column, gone[parent]) for child, column, parent in graph if child == name and parent in gone]
        if name in roots:
            hits.append((keys[name], roots[name].toDF("_id").filter("_id is not null").distinct()))
        out = df
        for column, ids in hits:
            out = out.join(ids.withColumnRenamed("_id", column), column, "left_anti")
        left[name] = out.select(*df.columns)
        if hits and any(parent == name for _, _, parent in graph):
            parts = [df.join(ids.withColumnRenamed("_id", column), column, "left_semi").select(F.col(keys[name]).alias("_id")) for column, ids in hits]
            every = parts[0]
            for p in parts[1:]:
                every = every.union(p)
            gone[name] = every.filter("_id is not null").distinct()
        row = df.agg(F.count("*").alias("n_rows")).withColumn("_one", F.lit(1)).join(out.agg(F.count("*").alias("n_left")).withColumn("_one", F.lit(1)), "_one")
        row = row.select(F.lit(name).alias("table"), (F.col("n_rows") - F.col("n_left")).alias("removed"), "n_left")
        counts = row if counts is None else counts.union(row)
    return left, counts


def orphans(tables: dict[str, DataFrame], keys: dict[str, str], graph: list[tuple[str, str, str]]) -> DataFrame:
    """(table, column, parent, n): rows whose column holds an id that the parent lacks, for every edge of the graph."""
    out = None
    for child, column, parent in graph:
        known = tables[parent].select(F.col(keys[parent]).alias(column)).distinct()
        lost = tables[child].filter(F.col(column).isNotNull()).join(known, column, "left_anti").agg(F.count("*").alias("n"))
        row = lost.select(F.lit(child).alias("table"), F.lit(column).alias("column"), F.lit(parent).alias("parent"), "n")
        out = row if out is None else out.union(row)
    return out
