"""Suffix-array dedup: repeated byte strings, by a sparse suffix array sorted deep-shallow.

A string of `span` bytes holds an anchor: the least hash of the GRAM-byte
strings in it. Equal strings have their anchors at the same place, so the
suffixes at anchors suffice. Where anchors agree on HALF bytes to one side,
their suffixes, and their prefixes read backwards, are sorted: by multikey
quicksort up to a shallow depth, then by blind tries. Common prefix lengths
of neighbours then tell which strings around the anchors are equal.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, mix, powers, spread, stored, text_bytes, text_key

GRAM, SHALLOW = 32, 64


def anchors(data: bytes, span: int) -> list[tuple[int, int, int, int, int]]:
    """(key, place, side, least offset, largest offset) of a text's anchors.

    The offsets are those of the anchor in the span-byte strings of which it is
    the anchor. Side 0 has offsets under half the span: such strings hold the
    half span after the anchor, of which key is the hash. Side 1 has the
    others, and its key is of the half before and the gram.
    """
    n, half = len(data), span // 2
    if n < span:
        return []
    codes = np.frombuffer(data, np.uint8)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[codes] * up[:-1], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    bits = np.uint64(31)  # a text is under 2 GB; the same split for all, so that equal strings have their anchor at the same place
    mask = (np.uint64(1) << bits) - np.uint64(1)
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    width, size = span - GRAM + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: -(width - size)], least[width - size :])
    at = (least & mask).astype(np.int64)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    place = at[np.concatenate([[0], cut])]
    lo = place - np.concatenate([cut - 1, [len(at) - 1]])  # least offset: the last string
    hi = place - np.concatenate([[0], cut])
    out = []
    for side, (a, b, keep) in enumerate(((lo, np.minimum(hi, half - 1), lo < half), (np.maximum(lo, half), hi, hi >= half))):
        p = place[keep]
        start, end = (p, p + half) if side == 0 else (p - half, p + GRAM)
        keys = mix((sums[end] - sums[start]) * down[start] + np.uint64(side + 1)).view(np.int64)
        out += zip(keys.tolist(), p.tolist(), [side] * len(p), a[keep].tolist(), b[keep].tolist(), strict=True)
    return out


def context(data: bytes, place: int, side: int, span: int) -> tuple[bytes, bytes]:
    """What the strings of an anchor's side can hold before (read backwards) and after it."""
    half = span // 2
    before, after = (half - 1, span) if side == 0 else (span - GRAM, half)
    return data[max(0, place - before) : place][::-1], data[place : place + after]


def _common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are sure."""
    lo, hi = known, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def blind_trie(strings: list[bytes], ids: list[int], known: int) -> list[int]:
    """ids in the order of their strings, which share `known` bytes.

    Inner nodes are [place, {byte: child}]; leaves are lists of ids with equal
    strings. A string goes down blindly, looking at branch places only; one
    comparison with the leaf that it meets tells where it departs.
    """

    def byte(s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1

    root = (None, [ids[0]])
    for k in ids[1:]:
        s, node = strings[k], root
        while node[0] is not None:
            kids = node[1]
            node = kids.get(byte(s, node[0])) or next(iter(kids.values()))
        other = strings[node[1][0]]
        depth = _common(s, other, known)
        if depth == len(s) == len(other):
            node[1].append(k)
            continue
        above, node = None, root
        while node[0] is not None and node[0] < depth:
            above, node = node, node[1][byte(s, node[0])]
        if node[0] == depth:
            node[1][byte(s, depth)] = (None, [k])
            continue
        made = (depth, {byte(other, depth): node, byte(s, depth): (None, [k])})
        if above is None:
            root = made
        else:
            above[1][byte(s, above[0])] = made
    out, stack = [], [root]
    while stack:
        place, kids = stack.pop()
        if place is None:
            out += kids
        else:
            stack += [kids[c] for c in sorted(kids, reverse=True)]
    return out


def multikey_quicksort(table: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order of the rows by their first SHALLOW bytes, and where in it stand rows that agree on all of these.

    A group is parted in three by a pivot among its characters at the current depth, of
    eight bytes each: less and more go on at that depth, equal ones at the next.
    """
    words, m = table.view(">u8"), len(table)
    order, alike, stack = np.arange(m), [], [(0, m, 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2:
            continue
        if depth == SHALLOW // 8:
            alike.append((lo, hi))
            continue
        ids = order[lo:hi]
        if hi - lo == 2:
            x, y = (table[k, 8 * depth : SHALLOW].tobytes() for k in ids)
            if x > y:
                order[lo:hi] = ids[::-1].copy()
            elif x == y:
                alike.append((lo, hi))
            continue
        char = words[ids, depth]
        pivot = sorted(char[[0, len(char) // 2, -1]].tolist())[1]
        less, more = char < pivot, char > pivot
        a, b = lo + np.count_nonzero(less), hi - np.count_nonzero(more)
        if a > lo or b < hi:
            order[lo:hi] = np.concatenate([ids[less], ids[~(less | more)], ids[more]])
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order, alike


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the strings and each one's common prefix length with the one before it.

    Shallow: multikey quicksort to SHALLOW bytes. Deep: a blind trie for every group that is left.
    """
    m = len(strings)
    width = max(SHALLOW, -(-max(map(len, strings), default=0) // 8) * 8)
    table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(m, width)
    lengths = np.fromiter(map(len, strings), np.int64, m)
    order, alike = multikey_quicksort(table)
    for a, b in alike:
        ids = order[a:b].tolist()
        order[a:b] = blind_trie(strings, ids, min(SHALLOW, int(lengths[ids].min())))
    common = np.zeros(m, np.int64)
    for a in range(1, m, 2048):  # in blocks, to bound memory
        x, y = order[a : a + 2048], order[a - 1 : min(a + 2048, m) - 1]
        unlike = table[x] != table[y]
        common[a : a + 2048] = np.minimum(np.where(unlike.any(1), unlike.argmax(1), width), np.minimum(lengths[x], lengths[y]))
    return order, common


def repeated_offsets(contexts: list[tuple[bytes, bytes]], lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, span: int) -> np.ndarray:
    """Which strings around anchors occur more than once: a table of anchors by offset."""
    m = len(contexts)
    out = np.zeros((m, span), bool)
    left, left_common = deep_shallow([c[0] for c in contexts])
    right, right_common = deep_shallow([c[1] for c in contexts])
    for o in range(int(lo.min()), int(hi.max()) + 1):
        here = (lo <= o) & (o <= hi)
        if not here.any():
            continue
        a, b = np.empty(m, np.int64), np.empty(m, np.int64)
        a[left] = np.cumsum(left_common < o)
        b[right] = np.cumsum(right_common < span - o)
        at = np.flatnonzero(here)
        _, same = np.unique(a[at] * m + b[at], return_inverse=True)
        out[at, o] = np.bincount(same, weight[at])[same] > 1
    return out


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _suffixes(texts: DataFrame, keys: DataFrame, span: int, contexts: bool) -> DataFrame:
    """Anchors of texts(text_key, text, keys) whose key is in that array of repeated keys.

    With contexts: key, the context's hash, count, offsets and the context, each
    context of a task once and further counts without it. Otherwise: text_key,
    place, key and hash.
    """
    wide = "key long, ctx binary, n long, lo int, hi int, before binary, after binary"
    narrow = "text_key binary, place long, key long, ctx binary"

    def work(batches):
        import pyarrow as pa

        seen: dict[bytes, list] = {}

        def batch_of(rows):
            if contexts:
                types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                names = ["key", "ctx", "n", "lo", "hi", "before", "after"]
            else:
                types, names = [pa.binary(), pa.int64(), pa.int64(), pa.binary()], ["text_key", "place", "key", "ctx"]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            rows = []
            for tk, value, repeated in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data, wanted = value.as_py(), set(repeated.as_py())
                for key, place, side, lo, hi in anchors(data, span):
                    if key not in wanted:
                        continue
                    before, after = context(data, place, side, span)
                    ctx = hashlib.blake2b(before + b"|" + after, digest_size=16, salt=len(before).to_bytes(8, "little")).digest()
                    if not contexts:
                        rows.append((tk, place, key, ctx))
                    elif ctx in seen:
                        seen[ctx][1] += 1
                    else:
                        if len(seen) > 1 << 18:
                            rows += [(k, c, n, 0, 0, None, None) for c, (k, n) in seen.items() if n]
                            seen.clear()
                        seen[ctx] = [key, 0]
                        rows.append((key, ctx, 1, lo, hi, before, after))
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)
        if contexts:
            yield batch_of([(k, c, n, 0, 0, None, None) for c, (k, n) in seen.items() if n])

    return texts.join(keys, "text_key").select("text_key", "text", "keys").mapInArrow(work, wide if contexts else narrow)


def _repeated(rows: DataFrame, span: int, batch_size: int = 4096) -> DataFrame:
    """(key, ctx, offsets): runs of offsets at which the strings around an anchor occur again."""
    out_type = T.StructType([T.StructField("key", T.LongType()), T.StructField("ctx", T.BinaryType()), T.StructField("offsets", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))])

    def work(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(out_type["offsets"].dataType)
        held: dict[tuple[int, bytes], list] = {}
        last = None

        def flush():
            items = [(k, v) for k, v in held.items() if v[3] is not None]
            held.clear()
            if not items:
                return []
            lo, hi, weight = (np.array([v[i] for _, v in items], np.int64) for i in (1, 2, 0))
            flags = repeated_offsets([(v[3], v[4]) for _, v in items], lo, hi, weight, span)
            some = np.flatnonzero(flags.any(1)).tolist()
            return [(items[i][0][0], items[i][0][1], _runs(flags[i])) for i in some]

        def batch_of(found):
            keys, ctxs, offsets = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ctxs, pa.binary()), pa.array(offsets, kind)], names=out_type.names)

        for batch in batches:
            found = []
            for key, ctx, n, lo, hi, before, after in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if key != last and len(held) >= batch_size:
                    found += flush()
                last = key
                row = held.setdefault((key, ctx), [0, 0, 0, None, None])
                row[0] += n
                if before is not None:
                    row[1:] = [lo, hi, before, after]
            yield batch_of(found)
        yield batch_of(flush())

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(work, out_type)


def _repeated_hot(rows: DataFrame, span: int, hot: int) -> DataFrame:
    """As _repeated(), for keys of so many contexts that these must not meet in one task.

    A radix step of the sort in Spark: the strings at offsets a to b around an anchor all hold the a bytes
    before it and the span - b bytes after it, so a key is parted by these bytes. The range of
    offsets is halved, which fixes ever more bytes, until a part has at most `hot` contexts and is sorted like
    any key. At one offset a part's strings are equal, and nothing is left to sort. Parts of one
    context that occurs once go. Hot parts are dealt over tasks where they meet their counts.
    """
    half = span // 2
    # Equal contexts of several tasks are one, with all their counts; the key is carried behind the context's hash.
    one = rows.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("before").alias("before"), F.max("after").alias("after"))
    one = one.withColumn("ctx", F.concat("ctx", F.col("key").cast("string").cast("binary")))
    left = stored(one.withColumn("a", F.when(F.col("lo") < half, 0).otherwise(half)).withColumn("b", F.when(F.col("lo") < half, half - 1).otherwise(span - 1)), "contexts")
    found = []
    while not left.isEmpty():
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("b").alias("b")))
        parts = left.withColumn("r", F.explode(halves)).withColumn("a", F.col("r.a")).withColumn("b", F.col("r.b")).filter("a <= b and lo <= b and hi >= a")
        same = F.concat(F.concat_ws("|", "key", "a", "b", F.lit("")).cast("binary"), F.expr("substring(before, 1, a)"), F.expr(f"substring(after, 1, {span} - b)"))
        parts = stored(parts.withColumn("part", F.unhex(F.md5(same))).drop("r"), "radix")
        counts = stored(parts.groupBy("part").agg(F.count("*").alias("n_rows"), F.sum("n").alias("total")).filter("total > 1"), "part_sizes")
        told = stored(spread(parts, counts.select("part", F.col("n_rows").alias("size")), ["part"], counts, by=["ctx"], share=hot), "parted")
        few = told.filter(F.col("size") <= hot).select(F.xxhash64("part").alias("key"), "ctx", "n", F.greatest("lo", "a").alias("lo"), F.least("hi", "b").alias("hi"), "before", "after")
        at = F.col("a").cast("long")
        equal = told.filter((F.col("size") > hot) & (F.col("a") == F.col("b"))).select("ctx", F.array(F.struct(at.alias("a"), at.alias("b"))).alias("offsets"))
        found += [_repeated(few, span).select("ctx", "offsets"), equal]
        left = told.filter((F.col("size") > hot) & (F.col("a") < F.col("b"))).drop("part", "size")
    key = F.expr("cast(cast(substring(ctx, 17) as string) as bigint)").alias("key")
    return reduce(DataFrame.union, found).select(key, F.expr("substring(ctx, 1, 16)").alias("ctx"), "offsets")


def remove_repeats(docs: DataFrame, span: int = 400, with_text: bool = False, hot: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Removed is each byte that is covered by a string of `span` bytes which also
    starts anywhere else, in the same document or another; overlaps count; all
    occurrences go, and strings are judged on the input. Documents are
    whole texts as UTF-8 bytes (null: empty); no string crosses from one to the next.
    Texts under `span` bytes lose nothing. Rows with equal texts are
    copies of each other; repeated ids and null ids are documents like others. An empty
    table gives no rows. with_text adds the kept bytes (null where nothing was removed).

    Texts are taken once each; only those that share an anchor's key with another
    place are fetched again. Contexts that are equal are counted before they
    meet, so a passage in many documents is one context per task, but
    for those at its edges. Keys of over `hot` places are parted by more of their bytes before they are sorted (_repeated_hot),
    and the texts that have one are dealt over tasks (spread).
    """
    half = span // 2
    if half <= GRAM:
        raise ValueError(f"span must be over {2 * GRAM}")

    def keys_of(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            keys = [[a[0] for a in anchors(t, span)] for t in texts]
            sha = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, texts)), pa.int64()), pa.array(sha, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_bytes", "sha", "keys"])

    source = docs.select("doc_id", text_key().alias("text_key"), text_bytes().alias("text"))
    rows = stored(source.mapInArrow(keys_of, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_key binary, n_bytes long, sha string, keys array<long>"), "anchors")
    texts = rows.groupBy("text_key").agg(F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("n_bytes").alias("n_bytes"))
    texts = stored(texts.filter(F.col("n_bytes") >= span), "texts")
    flat = texts.select("text_key", F.explode("keys").alias("key"))
    again = stored(flat.groupBy("key").agg(F.count("*").alias("n_rows")).filter("n_rows > 1"), "keys")
    told = spread(flat, again.select("key", (F.col("n_rows") > hot).alias("hot")), ["key"], again, by=["text_key"], share=hot)
    wanted = stored(told.groupBy("text_key").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot")), "wanted")
    one = W.partitionBy("text_key").orderBy(F.lit(1))
    fetched = source.select("text_key", "text").join(wanted.select("text_key"), "text_key", "left_semi")
    fetched = stored(fetched.withColumn("_i", F.row_number().over(one)).filter("_i = 1").drop("_i"), "fetched")
    found = _repeated(_suffixes(fetched, wanted.withColumn("keys", F.array_except("keys", "hot")), span, True), span)
    with_hot = wanted.filter("size(hot) > 0").select("text_key", F.col("hot").alias("keys"))
    if not with_hot.isEmpty():
        found = found.union(_repeated_hot(_suffixes(fetched, with_hot, span, True), span, hot))
    # one column of both, so that places of one key are not dealt by the key alone
    both = F.concat("ctx", F.col("key").cast("string").cast("binary")).alias("both")
    places = _suffixes(fetched, wanted, span, False).select("text_key", "place", both).join(found.select(both, "offsets"), "both")
    starts = places.select("text_key", F.explode(F.transform("offsets", lambda r: F.struct((F.col("place") - r["b"]).alias("a"), (F.col("place") - r["a"] + span).alias("b")))).alias("r"))
    covers = starts.groupBy("text_key").agg(F.sort_array(F.collect_list("r")).alias("ranges"))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for value, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data, kept, done, gone, spans = value.as_py(), [], 0, 0, 0
                for r in ranges:
                    if r["a"] > done or not spans:
                        kept.append(data[done : r["a"]])
                        spans += 1
                        done = r["a"]
                    if r["b"] > done:
                        gone += r["b"] - done
                        done = r["b"]
                left = b"".join([*kept, data[done:]])
                out.append((gone, spans, hashlib.sha256(left).hexdigest(), left))
            gone, spans, sha, left = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), *([pa.array(left, pa.binary())] if with_text else [])], names=["text_key", "n_removed", "n_spans", "kept", *(["kept_text"] if with_text else [])])

    done = fetched.join(covers, "text_key").select("text_key", "text", "ranges").mapInArrow(cut, "text_key binary, n_removed long, n_spans long, kept string" + ", kept_text binary" * with_text)
    copied = texts.filter("copies > 1").select("text_key", F.lit(True).alias("copied"))
    out = rows.drop("keys").join(copied, "text_key", "left").join(done, "text_key", "left")
    all_gone = F.col("copied").isNotNull()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        *([F.when(all_gone, F.lit(b"")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []),
    )
