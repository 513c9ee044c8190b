"""Helpers shared by the training-data operators: tables, text keys, hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD_SQL = r"[^\x20\x09-\x0D]+"
_fallback: dict[str, str] = {}
_on_the_way: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).

    Where that setting is missing, a temporary folder stands in for it on a local
    master, as in tests. On a cluster that would lose tables with their
    machine, so that it is an error there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="spark-loom-")
    return _fallback[app]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As stored(), with the table's path: for one that is removed (discard) before the job ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs only the tasks that were
    running on it, never the steps before the table.
    """
    out, path = written(df, name)
    if _on_the_way.get() is not None:
        _on_the_way.get().append(path)
    return out


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stores what make() returns, then removes the tables that were stored inside make().

    The result is a table of its own, so nothing reads those any more; only
    make() may use them.
    """
    inside: list[str] = []
    token = _on_the_way.set(inside)
    try:
        df = make()
    finally:
        _on_the_way.reset(token)
    out = stored(df, name)
    del df
    discard(spark, *inside)
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes tables that nothing reads any more, and shuffle files of finished steps.

    Spark lets go of the latter when the driver collects its garbage, by itself
    every half hour (spark.cleaner.periodicGC.interval), which is long for a
    job of many steps whose results are stored.
    """
    for at in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many "_" before it as it takes to be no column of df (whatever its case)."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name = "_" + name
        there.add(name.lower())
        out.append(name)
    return out


#: So many keys at most are broadcast as hot ones; any other has fewer rows than each of these.
HOT_KEYS = 100_000


def spread(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame, by: list[str], share: int = 20_000) -> DataFrame:
    """rows joined with table on keys, where keys of more than `share` rows are dealt over several tasks.

    counts has the keys and n_rows, how many of rows have them. The hot keys, at most
    HOT_KEYS (the largest), are broadcast; their rows get a salt from the columns `by`,
    and the table's rows of these keys are repeated for each salt.
    """
    hot = counts.filter(F.col("n_rows") > share).orderBy(F.desc("n_rows")).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("n_rows") / share).cast("int").alias("_shares")))
    shares = F.coalesce("_shares", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), shares).cast("int")).drop("_shares")
    told = table.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    return dealt.join(told, [*keys, "_salt"]).drop("_salt")


def fold(col: str = "doc_id", by: int = 5) -> Column:
    """crc32 of the id's text modulo `by`; null ids give null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % by


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def text_key(col: str = "text") -> Column:
    """16 bytes that stand for a text: equal texts have equal keys."""
    return F.unhex(F.md5(text_bytes(col)))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values so that all their bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: What parts words: the six bytes of WORD_SQL, or these and ASCII marks.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
MARKS = BLANK.copy()
MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: list[bytes], blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and where each text's begin.

    Works on arrays of bytes: a word's hash is a difference of running sums,
    scaled to be free of its place.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    apart = blank[data]
    edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    if not apart[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, offsets)


def grouped(texts, size: int = 1 << 19):
    """(first, list of texts) of about `size` bytes each, from an Arrow column of bytes."""
    held, total, first = [], 0, 0
    for k, x in enumerate(texts):
        held.append(x.as_py())
        total += len(held[-1])
        if total >= size:
            yield first, held
            held, total, first = [], 0, k + 1
    if held:
        yield first, held


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-word shingles, in text order.

    A text of fewer than n words is one shingle; no words, no shingle.
    """
    if not len(hashes):
        return hashes
    with np.errstate(over="ignore"):
        size = min(n, len(hashes))
        count = len(hashes) - size + 1
        out = np.zeros(count, np.uint64)
        for k in range(size):
            out = mix(out + hashes[k : k + count] + np.uint64(k + 1))
        return out


def word_weights(docs: DataFrame, bits: int = 17, col: str = "text") -> np.ndarray:
    """Commonness of words over all documents, in a table of fixed size.

    A word's cell is the top bits of its hash; cells hold the rounded
    8 * log2 of how often their words occur. The table has 2**bits bytes
    however large the corpus is. Only orders of shingles depend on it.
    """

    def count(batches):
        import pyarrow as pa

        cells = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, texts in grouped(batch.column(0)):
                hashes, _ = word_hashes([t.lower() for t in texts])
                cells += np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        used = np.flatnonzero(cells)
        for at in range(0, len(used), 20_000):
            part = used[at : at + 20_000]
            yield pa.RecordBatch.from_pydict({"cell": pa.array(part, pa.int64()), "n": pa.array(cells[part], pa.int64())})

    sums = docs.select(text_bytes(col).alias("text")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(1 << bits, np.uint8)
    got = sums.select("cell", F.least(F.lit(255), F.round(8 * F.log2(F.col("n") + 1))).cast("int").alias("w")).toArrow()
    table[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return table
