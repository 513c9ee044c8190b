"""Versioned tables in hash buckets: a batch rewrites the buckets that it touches, and several tables change at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import listed, remove

MANIFEST = "epoch long, buckets int, tbl string, bucket int, path string"


class Snapshot:
    """Tables below one folder; `tables` names each one's schema and the column that deals its rows into buckets.

    A version is a manifest, which names the file folder of every bucket of every table. A
    batch writes new folders for the buckets it touches and then the manifest, in one file, so
    that all tables change at once; a writer lost before that leaves the version before in force, and files
    that no manifest names. One writer at a time is assumed. Number of buckets: fixed by the first version.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str | StructType, str]], buckets: int = 64):
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), tables, buckets

    def _manifest(self, epoch: int | None = None) -> DataFrame | None:
        """Manifests of all versions, or of one; none if there is no version."""
        try:
            rows = self.spark.read.schema(MANIFEST).option("basePath", f"{self.root}/manifest").json(f"{self.root}/manifest" + (f"/epoch={epoch}" if epoch is not None else ""))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows

    def versions(self) -> list[int]:
        """Numbers of all versions that are still there."""
        rows = self._manifest()
        return [] if rows is None else sorted(r.epoch for r in rows.select("epoch").distinct().collect())

    def last(self) -> int | None:
        """The number of the version in force."""
        return max(self.versions(), default=None)

    def _files(self, epoch: int | None) -> dict[tuple[str, int], str]:
        """Folders of a version by table and bucket."""
        rows = self._manifest(epoch).collect() if epoch is not None else []
        if rows and rows[0].buckets != self.buckets:
            raise ValueError(f"{self.root} has {rows[0].buckets} buckets, not {self.buckets}")
        return {(r.tbl, r.bucket): r.path for r in rows if r.path is not None}

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        schema = self.tables[name][0]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, epoch: int | None = None) -> DataFrame:
        """A table as of a version, the one in force if none is told; empty before the first."""
        files = self._files(self.last() if epoch is None else epoch)
        return self._read(name, [f"{self.root}/{p}" for (t, _), p in sorted(files.items()) if t == name])

    def bucket_of(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(self.buckets)).cast("int")

    def commit(self, epoch: int, touched: DataFrame | None, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> bool:
        """Makes version `epoch`: change() gets the rows of all buckets that hold an id of `touched` (its first column; null: all buckets), by table, and returns what they become.

        Tables that change() leaves out stay. Rows may not leave their buckets. A version that is there already, or is older
        than the last, is left alone: then the answer is False.
        """
        last = self.last()
        if last is not None and last >= epoch:
            return False
        hit = list(range(self.buckets))
        if touched is not None:
            hit = sorted(r.bucket for r in touched.select(self.bucket_of(touched.columns[0]).alias("bucket")).distinct().collect())
        files = self._files(last)
        old = {t: self._read(t, [f"{self.root}/{files[t, b]}" for b in hit if (t, b) in files]) for t in self.tables}
        attempt = f"data/{epoch}-{uuid.uuid4().hex}"
        for name, rows in change(old).items():
            schema, by = self.tables[name]
            typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], schema).schema])
            at = f"{self.root}/{attempt}/{name}"
            typed.withColumn("loom_bucket", self.bucket_of(by)).repartition(max(1, len(hit)), "loom_bucket").write.partitionBy("loom_bucket").parquet(at)
            there = [r.loom_bucket for r in self.spark.read.schema("loom_bucket int").parquet(at).distinct().collect()]
            if not set(there) <= set(hit):
                raise ValueError(f"rows of {name} left their buckets")
            files = {k: p for k, p in files.items() if k[0] != name or k[1] not in hit}
            files |= {(name, b): f"{attempt}/{name}/loom_bucket={b}" for b in there}
        rows = [(epoch, self.buckets, t, b, p) for (t, b), p in sorted(files.items())] or [(epoch, self.buckets, None, None, None)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").partitionBy("epoch").json(f"{self.root}/manifest")
        return True

    def drop_before(self, epoch: int) -> int:
        """Drops versions older than `epoch`, but never the one in force, and all files that no version left names; the number of folders dropped.

        Manifests go first, so that a lost driver leaves files without a name at most, which the next call drops.
        """
        gone = [v for v in self.versions()[:-1] if v < epoch]
        for v in gone:
            remove(self.spark, f"{self.root}/manifest/epoch={v}")
        rows = self._manifest()
        named = set() if rows is None else {r.path for r in rows.select("path").distinct().collect()}
        dropped = 0
        for attempt in listed(self.spark, f"{self.root}/data"):
            at = f"data/{attempt}"
            if not any((p or "").startswith(at + "/") for p in named):
                remove(self.spark, f"{self.root}/{at}")
                dropped += 1
                continue
            for name in listed(self.spark, f"{self.root}/{at}"):
                for bucket in listed(self.spark, f"{self.root}/{at}/{name}"):
                    if bucket.startswith("loom_bucket=") and f"{at}/{name}/{bucket}" not in named:
                        remove(self.spark, f"{self.root}/{at}/{name}/{bucket}")
                        dropped += 1
        return dropped
