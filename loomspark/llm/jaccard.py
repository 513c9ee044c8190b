"""N-gram Jaccard join by grouped prefixes.

A document is the set of its word shingles, in a fixed order from rare to
common. Two sets that are similar enough share a shingle of their prefixes.
Documents with the same set are one class, classes with the same prefix and
size one group; groups that meet on a prefix shingle and pass the size and
position filters are expanded to their classes, and these are verified on
whole texts. Groups of a shingle take turns, and what is already in one
component does not meet again.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_KEYS, discard, fresh, grouped, settled, shingle_hashes, spread, stored, text_bytes, text_key, word_hashes, word_weights, written


#: Sets are also kept as the parity of their shingles in 2**BITS cells.
BITS = 11
#: Where places of shingles meet, in the first 2**COARSE of these, onto which the others are folded.
COARSE = 8
#: Sets of more shingles than LONG fill those cells. Before their texts are moved for pairs, their parity in 2**FINE cells is.
LONG, FINE = 1 << BITS, 14
#: So many text keys of 16 bytes (and ids) are broadcast at most, to move only their texts or no rows at all; more are joined by a shuffle.
FEW = 50_000
#: In each round so many times more members of a shingle have their turn; so many members of it meet in one task.
TURNS, SHARE = 16, 20_000
#: So many shingles are counted together to find the hot ones.
CHUNK = 1 << 20


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingles of a text's word hashes."""
    return np.unique(shingle_hashes(hashes, n))


def _parity(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the shingles in 2**bits cells, as 64-bit words."""
    return np.packbits(np.bincount((distinct >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).view(np.int64)


def _named(set_key: str) -> Column:
    """A group's, or a class's, name where places of shingles meet: 8 bytes instead of 16, as there are many of them."""
    return F.xxhash64(set_key)


def _sets(rows: DataFrame, n: int, num: int, den: int, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """Size, identity and ordered prefix of every row's shingle set."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    bits = int(np.log2(len(weights)))
    source = rows.select(*keep, text_bytes().alias("text_utf8"))
    schema = source.drop("text_utf8").schema.add("n_shingles", "long").add("set_key", "binary").add("bits", T.ArrayType(T.LongType())).add("prefix", T.ArrayType(T.LongType()))

    def work(batches):
        import pyarrow as pa

        weights = shared.value
        for batch in batches:
            sizes, keys, bits_of, prefixes = [], [], [], []
            for _, texts in grouped(batch.column(batch.num_columns - 1)):
                hashes, first = word_hashes([t.lower() for t in texts])
                common = weights[(hashes >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
                for a, b in zip(first[:-1], first[1:], strict=True):
                    shingles = shingle_hashes(hashes[a:b], n)
                    distinct, where = np.unique(shingles, return_index=True)
                    sizes.append(len(distinct))
                    bits_of.append(_parity(distinct, BITS))
                    keys.append(hashlib.blake2b(distinct.tobytes(), digest_size=16).digest())
                    if not len(distinct):
                        prefixes.append(np.zeros(0, np.int64))
                        continue
                    m = min(n, b - a)
                    rank = np.zeros(len(shingles), np.uint64)
                    for k in range(m):
                        rank += common[a + k : a + k + len(shingles)]
                    # equal shingles have equal words, so rank is a function of the shingle
                    order = np.lexsort((distinct, rank[where]))
                    length = len(distinct) - -(-num * len(distinct) // den) + 1
                    prefixes.append(distinct[order[:length]].view(np.int64))
            lengths = np.cumsum([0] + [len(p) for p in prefixes])
            flat = np.concatenate([np.zeros(0, np.int64), *prefixes])
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            flat_bits = pa.array(np.concatenate([np.zeros(0, np.int64), *bits_of]), pa.int64())
            words = (1 << BITS) // 64
            bits_column = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * words, pa.int32()), flat_bits)
            made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), bits_column, pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)

    return source.mapInArrow(work, schema)


def _close(n1: Column, i1: Column, n2: Column, i2: Column, num: int, den: int) -> Column:
    """Size and position filters for sets that meet at places i1 and i2 of their prefixes.

    If it is the first shingle they share, at most min(n1 - i1, n2 - i2) are
    shared; similarity num/den needs num / (num + den) of n1 + n2.
    """
    least = F.least(n1, n2)
    return (den * least >= num * F.greatest(n1, n2)) & ((num + den) * F.least(n1 - i1, n2 - i2) >= num * (n1 + n2))


def _folded(bits: Column) -> Column:
    """The parity in 2**COARSE cells: that of several finer cells together is the exclusive or of theirs."""
    words = (1 << COARSE) // 64
    return F.array(*(reduce(Column.bitwiseXOR, [bits[k] for k in range(at, (1 << BITS) // 64, words)]) for at in range(words)))


def _maybe(n1: Column, bits1: Column, n2: Column, bits2: Column, num: int, den: int, cells: int = BITS) -> Column:
    """Whether sets of these sizes and parity bits can be similar enough.

    A shingle in one set only flips at most one bit, so as many shingles differ
    as bits do, at least; num / den allows (den - num) / (den + num) of n1 + n2.
    Unknown bits (null) say nothing.
    """
    unlike = sum((F.bit_count(bits1[k].bitwiseXOR(bits2[k])) for k in range((1 << cells) // 64)), F.lit(0))
    return F.coalesce((num + den) * unlike <= (den - num) * (n1 + n2), F.lit(True))


def _hot_tokens(prefixes: DataFrame) -> DataFrame:
    """token, n_rows of those that more than SHARE rows of prefixes(prefix) hold.

    Each task counts CHUNK shingles at a time and gives those that it has met more than
    once, so that a shingle that is not found has at most SHARE rows and one more of each chunk.
    """

    def count(batches):
        import pyarrow as pa

        def counted(parts):
            token, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_pydict({"token": pa.array(token[n > 1], pa.int64()), "n": pa.array(n[n > 1], pa.int64())})

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size >= CHUNK:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    found = prefixes.select("prefix").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n_rows"))
    return stored(found.filter(F.col("n_rows") > SHARE).orderBy(F.desc("n_rows"), "token").limit(HOT_KEYS), "hot_tokens")


def _shared_spots(firsts: DataFrame, num: int, den: int) -> DataFrame:
    """Places (token, group, i, n_shingles) of shingles that several groups have in their prefixes.

    hub is the foremost of a shingle's places, size how many it has. All places of a shingle
    meet by one shuffle; those of hot ones are counted first and dealt over tasks.
    """
    spots = firsts.select("group", "n_shingles", F.posexplode("prefix").alias("i", "token"))
    # places beyond this can't be where two sets of any allowed sizes first meet
    spots = spots.filter((num + den) * (F.col("n_shingles") - F.col("i")) >= num * (F.col("n_shingles") + F.ceil(num * F.col("n_shingles") / den)))
    # place and size travel as one number, in whose order they are
    spots = spots.select("token", "group", F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("n_shingles")).alias("at"))
    hot = _hot_tokens(firsts)
    hub, size = F.min(F.struct("at", "group")), F.count("*")
    met = Window.partitionBy("token")
    cold = spots.join(F.broadcast(hot.select("token")), "token", "left_anti").select("token", "group", "at", hub.over(met).alias("hub"), size.over(met).alias("size"))
    warm = spots.join(F.broadcast(hot.select("token")), "token", "left_semi")
    by_token = stored(warm.groupBy("token").agg(hub.alias("hub"), size.alias("size")), "tokens")
    warm = spread(warm, by_token, ["token"], by_token.withColumnRenamed("size", "n_rows"), by=["group"])

    def apart(at: str) -> list[Column]:
        return [F.shiftright(at, 32).cast("int").alias("i"), F.col(at).bitwiseAND(F.lit((1 << 32) - 1)).alias("n_shingles")]

    hub = F.struct(*apart("hub.at"), F.col("hub.group").alias("group")).alias("hub")
    return cold.unionByName(warm).filter("size > 1").select("token", "group", *apart("at"), hub, "size")


def _expanded(pairs: DataFrame, of: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes of pairs (g, h) of groups that have other roots and pass the filters by size and parity bits."""
    pairs = stored(pairs.distinct(), "met")
    wanted = pairs.select(F.col("g").alias("group")).union(pairs.select("h")).distinct()
    # parity bits are wide: only those that are needed are moved
    of = stored(of.select("group", "set_key", "root").join(wanted, "group").join(classes.select("set_key", "n_shingles", "bits"), "set_key"), "wanted")
    g, h = (of.select(F.col("group").alias(k), F.col("set_key").alias(f"set_{k}"), F.col("n_shingles").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"), F.col("root").alias(f"root_{k}")) for k in "gh")
    p = spread(pairs, g, ["g"], pairs.groupBy("g").agg(F.count("*").alias("n_rows")), by=["h"])
    size = den * F.least("n_g", "n_h") >= num * F.greatest("n_g", "n_h")
    p = p.join(h, "h").filter((F.col("root_g") != F.col("root_h")) & size & _maybe(F.col("n_g"), F.col("bits_g"), F.col("n_h"), F.col("bits_h"), num, den))
    return p.select(F.least("set_g", "set_h").alias("a"), F.greatest("set_g", "set_h").alias("b"))


def _undecided(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) without those of long texts(set_key, n_shingles, text) that finer parity bits tell apart.

    These bits have 2 KB a set, whole texts many times that, and most pairs of long texts are unlike.
    """
    source = texts.filter(F.col("n_shingles") > LONG).select("set_key", "n_shingles", "text")

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            bits = []
            for _, some in grouped(batch.column(2)):
                hashes, at = word_hashes([t.lower() for t in some])
                bits += [_parity(shingle_set(hashes[a:b], n), FINE) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.list_(pa.int64()))], names=["set_key", "n_shingles", "bits"])

    fine = stored(source.mapInArrow(work, "set_key binary, n_shingles long, bits array<long>"), "fine")
    left, right = (fine.select(F.col("set_key").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    # one join at a time: small plans spare the driver
    half = stored(spread(pairs, right, ["b"], pairs.groupBy("b").agg(F.count("*").alias("n_rows")), by=["a"]), "half_told")
    both = spread(half, left, ["a"], half.groupBy("a").agg(F.count("*").alias("n_rows")), by=["b"])
    unlike = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, k: total + k)
    apart = both.filter((num + den) * unlike > (den - num) * (F.col("n_a") + F.col("n_b"))).select("a", "b")
    return stored(pairs.join(apart, ["a", "b"], "left_anti"), "undecided")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of classes whose whole texts have the similarity.

    Texts are fetched and stored once per class, and only for classes in a pair;
    pairs of long ones that their parity bits tell apart do not get them.
    """
    needed = pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")).distinct().join(classes.select("set_key", "text_key", "n_shingles"), "set_key")
    needed = stored(needed, "needed")
    source = docs.select(text_key().alias("text_key"), text_bytes().alias("text"))
    many, long = needed.agg(F.count("*"), F.count_if(F.col("n_shingles") > LONG)).first()
    if many <= FEW:
        source = source.join(F.broadcast(needed.select("text_key")), "text_key", "left_semi")
    # copies of a text fall together in the tasks that read them, before the shuffle
    texts = source.groupBy("text_key").agg(F.first("text").alias("text"))
    texts = stored(texts.join(needed, "text_key").select("set_key", "n_shingles", "text"), "texts")
    pairs = _undecided(pairs, texts, n, num, den) if long else pairs
    left = texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b"))
    per_a, per_b = (pairs.groupBy(k).agg(F.count("*").alias("n_rows")) for k in "ab")
    # a class in many pairs is dealt over tasks, with its text
    rows = spread(spread(pairs, right, ["b"], per_b, by=["a"], share=2000), left, ["a"], per_a, by=["b"], share=2000)

    def work(batches):
        import pyarrow as pa

        last, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            keys, lefts = batch.column(0), batch.column(2)
            for first, texts in grouped(batch.column(3)):
                hashes, at = word_hashes([t.lower() for t in texts])
                for k in range(len(texts)):
                    key = keys[first + k].as_py()
                    if key != last:
                        own, _ = word_hashes([lefts[first + k].as_py().lower()])
                        last, held = key, shingle_set(own, n)
                    other = shingle_set(hashes[at[k] : at[k + 1]], n)
                    both = len(held) + len(other) - len(np.union1d(held, other))
                    good.append(den * both >= num * (len(held) + len(other) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([keys.filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(work, "a binary, b binary")


def similar_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Linked are documents whose sets of n-word shingles have an intersection of
    at least num / den of their union; a component is what links reach.
    component_id is the smallest doc_id in it. Words are as in word_hashes(),
    with A-Z lower-cased; a text of fewer than n words is one shingle; texts
    without words (null, empty, blank) have an empty set and are alone.
    Repeated ids and rows are documents like others; a null id is in its
    component, and component_id is null only if all ids there are. An empty
    table gives no rows. Only doc_id and text are read, so that other columns can't clash.
    """
    owners, of = _classes_and_roots(docs, n, num, den)
    out = _of_component(owners, of, F.min("doc_id")).select("doc_id", "n_shingles", F.col("best").alias("component_id"))
    return out.union(owners.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def deduplicate(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component of near duplicates: that of the least (doc_id, text key).

    A null id is the last. Texts without words (null, empty, blank) stay, each.
    Of rows with equal id and text one stays. All columns are kept, whatever
    their names; an empty table gives no rows.
    """

    def losing() -> DataFrame:
        owners, of = _classes_and_roots(docs, n, num, den)
        own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
        some = _of_component(owners, of, F.min(own))
        times = some.filter(own == F.col("best")).groupBy("doc_id", "text_key").agg(F.count("*").alias("times")).filter("times > 1")
        return some.filter(own != F.col("best")).select("doc_id", "text_key").distinct().withColumn("times", F.lit(0).cast("long")).union(times)

    found = settled(docs.sparkSession, losing, "losers")
    key, id_, other, times = fresh(docs, "text_key", "doc_id_", "text_key_", "times")
    found = found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(other), F.col("times").alias(times))
    rows = docs.withColumn(key, text_key())
    if found.count() <= FEW:
        found = F.broadcast(found)  # so that whole rows stay where they are
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(other))
    kept = rows.join(found, same, "left_anti")
    if not found.filter(F.col(times) > 0).isEmpty():
        kept = kept.union(rows.join(found.filter(F.col(times) > 0), same, "left_semi").dropDuplicates(["doc_id", key]))
    return kept.drop(key)


def _of_component(owners: DataFrame, of: DataFrame, least) -> DataFrame:
    """Owners with words, with `best`: what `least` gives over the owners of their component."""
    some = owners.filter("n_shingles > 0")
    classes = some.groupBy("set_key").agg(least.alias("low"), F.count("*").alias("n_rows")).join(of.select("set_key", "root"), "set_key")
    classes = stored(classes, "lows")
    best = classes.groupBy("root").agg(F.min("low").alias("best"), F.count("*").alias("n_rows"))
    told = spread(classes.select("set_key", "root"), best.drop("n_rows"), ["root"], best, by=["set_key"])
    return spread(some, told.select("set_key", "best"), ["set_key"], classes, by=["doc_id", "text_key"])


def _classes_and_roots(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Owners (doc_id, text_key, n_shingles, set_key) and classes (set_key, root, ...): classes of one root are a component.

    The join is whole, in rounds. In the first, every group of a shingle meets the
    group that has it foremost in its prefix; what is similar is merged. In each later
    one, some groups of every shingle (16, 256, ... of those that are not in the
    component which most of its groups are in) meet all groups of it that are in
    other components, until each such group has had its turn. So all pairs
    are looked at but those in one component: connectivity needs no more. A group
    of similar sets is merged by the first of its members that has its turn, so
    pairs grow in proportion to rows and not with the square of the group.
    """
    from .components import connected

    weights = word_weights(docs)
    spark = docs.sparkSession
    # tables with prefixes are large, so that they go as soon as what they lead to is stored
    sets, sets_at = written(_sets(docs.select("doc_id", "text", text_key().alias("text_key")), n, num, den, weights, ["doc_id", "text_key"]), "sets")
    owners = stored(sets.select("doc_id", "text_key", "n_shingles", "set_key"), "owners")
    one = F.min_by(F.struct("text_key", "n_shingles", "bits", "prefix"), "text_key").alias("_c")
    # a group: same size and same prefix; it is named after its least class
    named = F.md5(F.array_join("prefix", ",").cast("binary"))
    whole, whole_at = written(sets.filter("n_shingles > 0").groupBy("set_key").agg(one).select("set_key", "_c.*").withColumn("named", named), "classes")
    del sets
    discard(spark, sets_at)
    names = whole.groupBy("n_shingles", "named").agg(F.min("set_key").alias("lead"), F.count("*").alias("n_rows")).withColumn("group", _named("lead"))
    whole, grouped_at = written(spread(whole, names.drop("n_rows"), ["n_shingles", "named"], names, by=["set_key"]).drop("named").withColumn("lead", F.col("lead") == F.col("set_key")), "groups")
    discard(spark, whole_at)
    spots = stored(_shared_spots(whole.filter("lead"), num, den), "spots")
    classes = stored(whole.drop("prefix"), "classes")
    del whole
    discard(spark, grouped_at)

    first = spots.filter((F.col("group") != F.col("hub.group")) & _close(F.col("n_shingles"), F.col("i"), F.col("hub.n_shingles"), F.col("hub.i"), num, den))
    first = _expanded(first.select(F.col("hub.group").alias("g"), F.col("group").alias("h")), classes.withColumn("root", F.col("set_key")), classes, num, den)
    own = classes.filter("lead").select("group", F.col("set_key").alias("a"), F.col("n_shingles").alias("n_h"), F.col("bits").alias("bits_h"))
    inside = classes.filter("not lead").join(own, "group").filter(_maybe(F.col("n_h"), F.col("bits_h"), F.col("n_shingles"), F.col("bits"), num, den))
    first = first.union(inside.select("a", F.col("set_key").alias("b")))
    links = settled(spark, lambda: _verified(stored(first.distinct(), "pairs"), classes, docs, n, num, den), "links")
    of = classes.select("group", "set_key", F.col("set_key").alias("root"))
    # a group of several classes is like a shingle that they share
    mates = classes.filter("not lead").select("group").distinct().join(classes, "group")
    mates = mates.select(F.col("group").alias("token"), _named("set_key").alias("member"), F.lit(0).alias("i"), "n_shingles", F.lit(True).alias("lone"), F.col("lead").alias("done"))
    open_ = spots.filter("size > 2").select("token", F.col("group").alias("member"), "i", "n_shingles", F.lit(False).alias("lone"), (F.col("group") == F.col("hub.group")).alias("done")).union(mates)
    open_ = open_.withColumn("turn", F.lit(False))
    turns = 1
    while True:
        of = settled(spark, lambda: _merged(of, connected(links)), "roots")
        turns *= TURNS
        open_ = settled(spark, lambda: _still_open(open_, of, turns), "open")
        if open_.filter("turn").isEmpty():
            return owners, of
        links = settled(spark, lambda: _round(open_, of, classes, docs, n, num, den), "links")


def _merged(of: DataFrame, roots: DataFrame) -> DataFrame:
    """Classes with the root that their root has now."""
    now = of.join(roots.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return now.select("group", "set_key", F.coalesce("top", "root").alias("root"))


def _still_open(members: DataFrame, of: DataFrame, turns: int) -> DataFrame:
    """Members of the shingles whose members are not yet in one component, and whether it is their turn.

    r0 and r1 are the least and the greatest root of the member's classes. Members wholly
    in the component that most members of the shingle are in need no turn: each pair of
    components has a member of another one. Of those left, about `turns` of every
    shingle have theirs, all if there are no more; by a hash, so that reruns agree.
    """
    groups = of.groupBy("group").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
    single = of.select(_named("set_key").alias("member"), F.col("root").alias("r0"), F.col("root").alias("r1"))
    now = members.select("token", "member", "i", "n_shingles", "lone", (F.col("done") | F.col("turn")).alias("done"))
    now = now.filter("not lone").join(groups.withColumnRenamed("group", "member"), "member").unionByName(now.filter("lone").join(single, "member"))
    now = stored(now, "members")
    most = now.groupBy("token", "lone", F.when(F.col("r0") == F.col("r1"), F.col("r0")).alias("root")).agg(F.count("*").alias("k"), F.count_if(~F.col("done")).alias("waiting"))
    best = F.max(F.when(F.col("root").isNotNull(), F.struct("k", "root", "waiting")))
    most = most.groupBy("token", "lone").agg(best.alias("best"), F.count("*").alias("parts"), F.sum("k").alias("size"), F.sum("waiting").alias("all"), F.max(F.col("root").isNull()).alias("split"))
    left = F.col("all") - F.coalesce("best.waiting", F.lit(0))
    most = stored(most.filter("parts > 1 or split").filter(left > 0).select("token", "lone", F.col("best.root").alias("main"), left.alias("waiting"), "size"), "open_tokens")
    now = spread(now, most, ["token", "lone"], most.withColumnRenamed("size", "n_rows"), by=["member"])
    out = ~F.coalesce((F.col("r0") == F.col("main")) & (F.col("r1") == F.col("main")), F.lit(False))
    place = F.pmod(F.xxhash64("token", "member"), F.lit(1 << 40)) / float(1 << 40)
    return now.withColumn("turn", out & ~F.col("done") & (place * F.col("waiting") < turns)).drop("waiting", "main")


def _round(open_: DataFrame, of: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between components: of members whose turn it is with all members of their shingle."""
    # many members of one shingle are dealt over tasks, and those whose turn it is go to each of these
    shares = F.ceil(F.col("size") / SHARE).cast("int")
    # the parity bits of a group are known if it is a single class; here each place has its own, so that they are folded
    coarse = classes.select("group", "set_key", _folded(F.col("bits")).alias("bits"))
    member = stored(open_.select("lone", "member").distinct(), "open_members")
    of_groups = member.filter("not lone").join(coarse.select(F.col("group").alias("member"), "bits"), "member").groupBy("lone", "member").agg(F.when(F.count("*") == 1, F.min("bits")).alias("bits"))
    of_classes = member.filter("lone").join(coarse.select(_named("set_key").alias("member"), "bits"), "member")
    open_ = stored(open_.join(of_groups.unionByName(of_classes), ["lone", "member"]), "open_bits")
    hubs = open_.filter("turn").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).alias("x")
    rest = open_.filter("not done").withColumn("share", F.pmod(F.xxhash64("member"), shares).cast("int")).alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.share") == F.col("y.share")) & (F.col("x.lone") == F.col("y.lone"))
    on &= (F.col("x.member") < F.col("y.member")) | (~F.col("y.turn") & (F.col("x.member") != F.col("y.member")))
    on &= (F.col("x.r0") != F.col("y.r1")) | (F.col("x.r1") != F.col("y.r0"))
    on &= _close(F.col("x.n_shingles"), F.col("x.i"), F.col("y.n_shingles"), F.col("y.i"), num, den) & _maybe(F.col("x.n_shingles"), F.col("x.bits"), F.col("y.n_shingles"), F.col("y.bits"), num, den, COARSE)
    met = stored(hubs.join(rest, on).select(F.col("x.lone").alias("lone"), F.col("x.member").alias("g"), F.col("y.member").alias("h")).distinct(), "met")
    alone = _expanded(met.filter("lone").select("g", "h"), of.withColumn("group", _named("set_key")), classes, num, den)
    pairs = _expanded(met.filter("not lone").select("g", "h"), of, classes, num, den).union(alone).distinct()
    ra, rb = of.select(F.col("set_key").alias("a"), F.col("root").alias("ra")), of.select(F.col("set_key").alias("b"), F.col("root").alias("rb"))
    pairs = stored(pairs.join(ra, "a").join(rb, "b").filter("ra <> rb"), "pairs")
    found = _verified(pairs.select("a", "b"), classes, docs, n, num, den)
    return found.join(pairs, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
