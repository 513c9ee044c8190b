"""Dictionaries with parents: expansion from the roots, circles, children grouped under parents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sql(nodes: DataFrame, text: str) -> DataFrame:
    """A statement over the view {nodes}."""
    view = f"nodes_{uuid.uuid4().hex}"
    nodes.createOrReplaceTempView(view)
    return nodes.sparkSession.sql(text.format(nodes=view))


def expanded(nodes: DataFrame) -> DataFrame:
    """id, name, parent, root, depth (0 for roots) and path (ids from the root) of every node that a root leads to.

    nodes: id, parent, name; a root has no parent. Nodes of a circle, and what hangs on one or on a parent that is not there, are
    not among these: see unreached(). Ids are taken to be unique. Spark's limits on recursion hold (a hundred levels, a
    million rows of one expansion, unless set otherwise) and are errors.
    """
    return _sql(nodes.select("id", "parent", "name"), """
        WITH RECURSIVE tree(id, name, parent, root, depth, path) AS (
          SELECT id, name, parent, id, 0, array(id) FROM {nodes} WHERE parent IS NULL AND id IS NOT NULL
          UNION ALL SELECT n.id, n.name, n.parent, t.root, t.depth + 1, array_append(t.path, n.id) FROM {nodes} n JOIN tree t ON n.parent = t.id
        ) SELECT * FROM tree""")


def unreached(nodes: DataFrame) -> DataFrame:
    """(id, reason) of nodes that no root leads to: in a circle, below a circle, or below a parent that is not there.

    Parents are followed from each such node until there is none, or one comes again.
    """
    tree = expanded(nodes).select("id")
    lost = nodes.select("id", "parent").filter("id is not null").join(tree, "id", "left_anti")
    return _sql(lost, """
        WITH RECURSIVE walk(id, at, path) AS (
          SELECT id, parent, array(id) FROM {nodes}
          UNION ALL SELECT w.id, n.parent, array_append(w.path, n.id) FROM walk w JOIN {nodes} n ON w.at = n.id WHERE NOT array_contains(w.path, w.at)
        ), ends AS (SELECT id, max_by(at, size(path)) AS at, max_by(path, size(path)) AS path FROM walk GROUP BY id)
        SELECT id, CASE WHEN at = id THEN 'circle' WHEN array_contains(path, at) THEN 'below a circle' ELSE 'no parent' END AS reason FROM ends""")


def below(tree: DataFrame, codes: list) -> DataFrame:
    """Ids of the given nodes and of all nodes below them."""
    return tree.filter(F.arrays_overlap("path", F.array(*[F.lit(c) for c in codes]))).select("id") if codes else tree.limit(0).select("id")


def grouped(tree: DataFrame, levels: int = 3) -> DataFrame:
    """One row per root: id, name and children, sorted by id, each a struct of id, name and, down to `levels`, children.

    Each level is aggregated under its parents before the level above is joined with it. Nodes deeper than `levels` are left out; a
    node without children has an empty list.
    """
    held = None
    for depth in range(levels - 1, -1, -1):
        own = tree.filter(F.col("depth") == depth).select("id", "name", "parent")
        if held is not None:
            own = own.join(held.withColumnRenamed("parent", "id"), "id", "left")
            own = own.withColumn("children", F.coalesce("children", F.array().cast(held.schema["children"].dataType)))
        cells = [c for c in ("id", "name", "children") if c in own.columns]
        if depth == 0:
            return own.select(*cells)
        held = own.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct(*cells))).alias("children"))
    return tree.limit(0).select("id", "name")
