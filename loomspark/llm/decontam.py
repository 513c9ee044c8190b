"""Benchmark decontamination: rare gapped bigrams join passages to test items, then Smith-Waterman alignment.

Seeds are word pairs that stand one or two words apart. In an alignment of M matches
and E misses and gaps that reaches the threshold, 2 * M - E >= 2 * threshold * length.
Two matches in a row that are over two words apart, in the item or in the text, cost at
least two of E, so that at most M - threshold * length of the M - 1 rows of two are
so far apart: at least need - 1 of them, need = ceil(threshold * length), are a pair of both texts, each from
another place. Of any length - need + ask places of the item at least ask begin such
a pair, so the rarest ones will do, and no copy above the threshold is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MARKS, fresh, grouped, mix, spread, stored, text_key, word_hashes

HITS = "array<struct<item_id:{id},score:double,word:long>>"
ASK, SEGMENT, MIN_WORDS, PIECE = 6, 64, 5, 1 << 20
MATCH, MISS, GAP = 2, -1, -1
#: Bits of a filter of hashes: 32 for each hash, from 8 KiB up to 32 MiB; a fuller filter lets more pass and the join drops it.
LEAST_BITS, MOST_BITS = 16, 28
_BREAK = re.compile("[ \n]")


def word_numbers(texts: list[str]) -> list[np.ndarray]:
    """Hashes of each text's words, which alignments compare.

    Words are lower-cased and parted by white space and ASCII marks. Texts of over
    PIECE characters are hashed piece by piece, cut at a space or a new line.
    """
    hashes, first = word_hashes([t.lower().encode("utf-8", "replace") if len(t) <= PIECE else b"" for t in texts], MARKS)
    out = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    for k, text in enumerate(texts):
        if len(text) > PIECE:
            out[k] = np.concatenate([word_hashes([p.lower().encode("utf-8", "replace")], MARKS)[0] for p in _pieces(text)])
    return out


def _pieces(text: str) -> Iterator[str]:
    a = 0
    while a < len(text):
        found = _BREAK.search(text, a + PIECE)
        b = found.start() if found else len(text)
        yield text[a:b]
        a = b


def grams(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the pairs of words that are one apart, then of those two apart, in all texts end to end."""
    ids = np.concatenate([*texts, np.zeros(0, np.uint64)])
    after = np.concatenate([*(np.arange(len(t) - 1, -1, -1) for t in texts), np.zeros(0, np.int64)])
    for apart in (1, 2):
        at = np.flatnonzero(after >= apart)
        yield at, mix(ids[at] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(ids[at + apart]))


def align(items: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row of items with the same row of windows.

    Rows are padded, items with -1 and windows with -2, which match nothing. All
    pairs advance one anti-diagonal at a time.
    """
    pairs, m = items.shape
    n = windows.shape[1]
    back = windows[:, ::-1]
    two, one = np.zeros((pairs, m + 1), np.int32), np.zeros((pairs, m + 1), np.int32)
    best = np.zeros(pairs, np.int32)
    for d in range(2, m + n + 1):
        lo, hi = max(1, d - n), min(m, d - 1)
        now = np.zeros((pairs, m + 1), np.int32)
        same = items[:, lo - 1 : hi] == back[:, n - d + lo : n - d + hi + 1]
        step = np.where(same, two[:, lo - 1 : hi] + MATCH, two[:, lo - 1 : hi] + MISS)
        np.maximum(step, one[:, lo - 1 : hi] + GAP, out=step)
        np.maximum(step, one[:, lo : hi + 1] + GAP, out=step)
        np.maximum(step, 0, out=now[:, lo : hi + 1])
        np.maximum(best, now.max(1), out=best)
        two, one = one, now
    return best


def stretches(segment: np.ndarray, need: int, span: int, ids: np.ndarray):
    """(start, end) of the parts of ids to align with a segment, none over four spans.

    A window of `span` words needs `need` words of the segment, each counted at
    most as often as the segment holds it. The alignments lie in such windows, from a shared word to a shared word.
    """
    words, times = np.unique(segment, return_counts=True)
    number = np.minimum(np.searchsorted(words, ids), len(words) - 1)
    at = np.flatnonzero(words[number] == ids)
    if len(at) < need:
        return
    word = number[at]
    order = np.argsort(word, kind="stable")
    back = np.arange(len(at)) - times[word[order]]
    before = np.full(len(at), -1)
    same = (back >= 0) & (word[order[np.maximum(back, 0)]] == word[order])
    before[order[same]] = at[order[back[same]]]
    # A word counts in the windows that begin after `before`, where it would be one too many.
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, np.maximum(np.maximum(before + 1, at - span + 1), 0), 1)
    np.add.at(steps, at + 1, -1)
    good = np.flatnonzero(np.cumsum(steps) >= need)
    if not len(good):
        return
    for part in np.split(good, np.flatnonzero(np.diff(good) > span) + 1):
        inside = at[np.searchsorted(at, part[0]) : np.searchsorted(at, part[-1] + span)]
        a, b = int(inside[0]), int(inside[-1]) + 1
        while True:
            yield a, min(b, a + 4 * span)
            if a + 4 * span >= b:
                break
            a += 3 * span


class Filter:
    """A set of 64-bit hashes as bits; it holds all of them and few others."""

    def __init__(self, hashes: DataFrame):
        col = F.col(hashes.columns[0])
        bits = int(np.clip(np.ceil(np.log2(32 * max(1, hashes.count()))), LEAST_BITS, MOST_BITS))
        cell = F.shiftrightunsigned(col, 64 - bits)
        word = F.shiftright(cell, 6).cast("int").alias("word")
        rows = hashes.select(word, cell.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        got = rows.toArrow()
        self.shift = np.uint64(64 - bits)
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        self.words[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        cell = hashes >> self.shift
        return (self.words[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1


def _segments(items: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """item_id and words of each equal part of an item's words, of at most `segment` words."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            of, parts = [], []
            for first, texts in grouped(batch.column(1)):
                for k, ids in enumerate(word_numbers(texts)):
                    if len(ids) >= MIN_WORDS:
                        some = np.array_split(ids.view(np.int64), -(-len(ids) // segment))
                        of += [first + k] * len(some)
                        parts += some
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(parts, pa.list_(pa.int64()))], names=["item_id", "words"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, f"item_id {kind}, words array<long>")


def _item_grams(segments: DataFrame) -> DataFrame:
    """segment, place and hash of all pairs of the segments' words."""

    def pairs(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [np.array(x, np.int64).view(np.uint64) for x in batch.column(1).to_pylist()]
            begin = np.cumsum([0, *map(len, texts)])
            for at, codes in grams(texts):
                k = np.searchsorted(begin, at, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array((at - begin[k]).astype(np.int32)), pa.array(codes.view(np.int64))], names=["segment", "place", "gram"])

    return segments.select("segment", "words").mapInArrow(pairs, "segment long, place int, gram long")


def _gram_counts(docs: DataFrame, some: Filter) -> DataFrame:
    """gram, n: how often the documents hold each pair that the filter lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(some)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for _, texts in grouped(batch.column(0)):
                codes = [c[shared.value.holds(c)] for _, c in grams(word_numbers(texts))]
                distinct, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(distinct.view(np.int64)), "n": pa.array(n)})

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _seeds(pairs: DataFrame, segments: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, segment, ask, span: the pairs at each segment's places whose pairs are rarest in documents and in items."""
    held = pairs.groupBy("gram").agg(F.count("*").alias("held")).join(counts, "gram", "left")
    cost = (F.coalesce("n", F.lit(0)) + 1) * F.col("held").cast("double")
    places = pairs.join(held.select("gram", cost.alias("cost")), "gram").groupBy("segment", "place").agg(F.sum("cost").alias("cost"), F.collect_set("gram").alias("grams"))
    rank = F.row_number().over(Window.partitionBy("segment").orderBy("cost", "place"))
    kept = places.withColumn("rank", rank).join(segments.select("segment", "size", "need", "ask", "span"), "segment").filter("rank <= size - need + ask")
    return kept.select(F.explode("grams").alias("gram"), "segment", "ask", "span").distinct()


def _dealt(at: np.ndarray, block: int, over: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of `at` are in which blocks: each block of words goes on for `over` words into the next."""
    home = at // block
    also = np.flatnonzero((at - home * block < over) & (home > 0))
    return np.concatenate([np.arange(len(at)), also]), np.concatenate([home, home[also] - 1])


def _spots(texts: DataFrame, some: Filter, ask: int, span: int, block: int) -> DataFrame:
    """key, block, places, grams: the pairs in a text's blocks that may be seeds, where at least `ask` of them lie within `span` words."""
    shared = texts.sparkSession.sparkContext.broadcast(some)

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            for first, part in grouped(batch.column(1)):
                ids = word_numbers(part)
                begin = np.cumsum([0, *map(len, ids)])
                found = [(at[ok], codes[ok]) for at, codes in grams(ids) for ok in [shared.value.holds(codes)]]
                at, codes = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(at, kind="stable")
                at, codes = at[order], codes[order]
                # so many different places, from here or up to here, must be close enough
                spot, of = np.unique(at, return_inverse=True)
                text = np.searchsorted(begin, spot, "right") - 1
                close = np.flatnonzero((spot[ask - 1 :] - spot[: len(spot) - ask + 1] < span) & (text[ask - 1 :] == text[: len(spot) - ask + 1])) if len(spot) >= ask else np.zeros(0, np.int64)
                steps = np.zeros(len(spot) + 1, np.int64)
                steps[close] += 1
                np.add.at(steps, close + ask, -1)
                ok = (np.cumsum(steps)[:-1] > 0)[of]
                at, codes = at[ok], codes[ok]
                text = np.searchsorted(begin, at, "right") - 1
                at = at - begin[text]
                which, home = _dealt(at, block, span)
                order = np.lexsort((at[which], home, text[which]))
                which, home = which[order], home[order]
                new = np.flatnonzero(np.diff(text[which], prepend=-1) | np.diff(home, prepend=-1))
                ends = pa.array(np.append(new, len(which)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(first + text[which[new]])),
                    pa.array(home[new]),
                    pa.ListArray.from_arrays(ends, pa.array(at[which])),
                    pa.ListArray.from_arrays(ends, pa.array(codes[which].view(np.int64))),
                ], names=["key", "block", "places", "grams"])

    return texts.select("key", "text").mapInArrow(find, "key binary, block long, places array<long>, grams array<long>")


def _passages(texts: DataFrame, some: Filter, block: int, over: int) -> DataFrame:
    """key, block, words: the blocks of the texts whose code the filter lets pass."""
    shared = texts.sparkSession.sparkContext.broadcast(some)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            keep = np.flatnonzero(shared.value.holds(batch.column(1).to_numpy().view(np.uint64)))
            kept = batch.take(pa.array(keep))
            for first, part in grouped(kept.column(2)):
                for k, ids in enumerate(word_numbers(part)):
                    ids = ids.view(np.int64)
                    for lo in range(0, len(ids), 64 * block):  # rows of so many blocks at a time
                        blocks = [(b, ids[b * block : (b + 1) * block + over]) for b in range(lo // block, min(lo // block + 64, -(-len(ids) // block)))]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([kept.column(0)[first + k].as_py()] * len(blocks), pa.binary()),
                            pa.array([b for b, _ in blocks], pa.int64()),
                            pa.array([w for _, w in blocks], pa.list_(pa.int64())),
                        ], names=["key", "block", "words"])

    return texts.select("key", F.xxhash64("key").alias("code"), "text").mapInArrow(cut, "key binary, block long, words array<long>")


def _aligned(pairs: DataFrame, threshold: float) -> DataFrame:
    """key, segment, score, word of the pairs of a segment (item) and a stretch of a text (words, from `first`) that reach the threshold."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            heads = list(zip(*(batch.column(i).to_pylist() for i in range(2, 5)), strict=True))
            item, words = ([np.array(x, np.int64) for x in batch.column(i).to_pylist()] for i in (5, 6))
            jobs = [(k, a, b) for k, (need, span, _) in enumerate(heads) for a, b in stretches(item[k], need, span, words[k])]
            jobs.sort(key=lambda j: (len(item[j[0]]), j[2] - j[1]))
            at, scores, starts = [], [], []
            for lo in range(0, len(jobs), 128):
                part = jobs[lo : lo + 128]
                # numbers that only this block of pairs uses, so that padding differs from all hashes
                flat = [item[k] for k, *_ in part] + [words[k][a:b] for k, a, b in part]
                numbers = np.unique(np.concatenate(flat), return_inverse=True)[1]
                cuts = np.split(numbers, np.cumsum([len(x) for x in flat])[:-1])
                left = np.full((len(part), max(map(len, cuts[: len(part)]))), -1, np.int64)
                right = np.full((len(part), max(map(len, cuts[len(part) :]))), -2, np.int64)
                for row in range(len(part)):
                    left[row, : len(cuts[row])] = cuts[row]
                    right[row, : len(cuts[len(part) + row])] = cuts[len(part) + row]
                for (k, a, _), score in zip(part, align(left, right).tolist(), strict=True):
                    share = score / (MATCH * len(item[k]))
                    if share >= threshold:
                        at.append(k)
                        scores.append(share)
                        starts.append(heads[k][2] + a)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(scores, pa.float64()), pa.array(starts, pa.int64())], names=["key", "segment", "score", "word"])

    return pairs.select("key", "segment", "need", "span", "first", "item", "words").mapInArrow(work, "key binary, segment long, score double, word long")


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, block: int = 1024, name: str = "hits") -> DataFrame:
    """docs plus an array `name`: the items that each text holds, whole or edited.

    An item is cut into equal segments of at most SEGMENT words. A text holds it
    if some segment's local alignment (match 2, miss and gap -1) reaches
    `threshold` (over 0.2) of a full match; `word` is where the aligned stretch of words begins.
    Seeds are pairs of words one or two apart, at each segment's rarest places, counted over all
    documents, and so many that no such alignment lacks them (see the module's head).

    Texts are searched in blocks of `block` words (the longest alignment's at least) that overlap. Their pairs are joined with
    the seeds, then the blocks that hold enough seeds of a segment with that segment,
    each by a join on a hash whose hot keys are dealt over tasks. The number of passes over docs does not
    depend on the benchmark's size; only filters of at most 2**MOST_BITS bits are broadcast.

    Null texts count as empty; items under MIN_WORDS words
    say too little and match nothing; items with equal ids count as one;
    repeated documents each get their hits; empty tables give no hits. A column of
    docs of that name is replaced; all others are kept, whatever their names.
    """
    if not threshold > 1 / MIN_WORDS:
        raise ValueError("a threshold of 0.2 or less leaves short items without a pair of words")
    kind = items.schema["item_id"].dataType.simpleString()
    empty = F.array().cast(HITS.format(id=kind))
    cut = stored(_segments(items).withColumn("segment", F.xxhash64("words")), "segments")
    if cut.isEmpty():
        return docs.withColumn(name, empty)
    need = F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("size") - 1e-6)).cast("int")
    span = F.floor((3 - 2 * threshold) * F.col("size") + 1e-6).cast("int")
    segments = cut.dropDuplicates(["segment"]).select("segment", "words", F.size("words").alias("size"))
    segments = segments.withColumn("need", need).withColumn("span", F.greatest(F.lit(1), span)).withColumn("ask", F.least(F.lit(ASK), F.col("need") - 1))
    segments = stored(segments, "distinct_segments")
    ask, over = segments.agg(F.min("ask"), F.max("span")).first()
    block = max(block, over)  # so that no alignment reaches over more than two blocks

    texts = docs.select(text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = stored(_item_grams(segments), "item_grams")
    seeds = stored(_seeds(pairs, segments, _gram_counts(docs, Filter(pairs.select("gram").distinct()))), "seeds")
    spots = stored(_spots(texts, Filter(seeds.select("gram").distinct()), ask, over, block).dropDuplicates(["key", "block"]), "spots")

    each = spots.select("key", "block", F.explode(F.arrays_zip("places", "grams")).alias("s")).select("key", "block", F.col("s.places").alias("place"), F.col("s.grams").alias("gram"))
    met = spread(each, seeds, ["gram"], each.groupBy("gram").agg(F.count("*").alias("n_rows")), ["key", "block", "place"])
    met = met.groupBy("key", "block", "segment", "ask", "span").agg(F.array_sort(F.collect_set("place")).alias("places"))  # no more places than a block has words
    near = stored(met.filter(_close("places")).select("key", "block", "segment", F.array_min("places").alias("low"), F.array_max("places").alias("high")), "near")

    passages = _passages(texts, Filter(near.select(F.xxhash64("key").alias("code")).distinct()), block, over).dropDuplicates(["key", "block"])
    begin = F.col("block") * block
    low = F.greatest(F.lit(0), F.col("low") - over - begin)
    part = F.slice("words", low.cast("int") + 1, (F.col("high") + over + 2 - begin - low).cast("int"))
    facing = near.join(passages, ["key", "block"]).select("key", "segment", (begin + low).alias("first"), part.alias("words"))
    told = segments.select("segment", "need", "span", F.col("words").alias("item"))
    facing = spread(facing, told, ["segment"], near.groupBy("segment").agg(F.count("*").alias("n_rows")), ["key", "first"])
    best = F.max(F.struct("score", (-F.col("word")).alias("back"))).alias("best")
    found = _aligned(facing, threshold).groupBy("key", "segment").agg(best)
    found = found.join(cut.select("segment", "item_id").distinct(), "segment").groupBy("key", "item_id").agg(F.max("best").alias("best"))
    hit = F.struct("item_id", F.col("best.score").alias("score"), (-F.col("best.back")).alias("word"))
    hits = stored(found.groupBy("key").agg(F.array_sort(F.collect_list(hit)).alias("found")), "hits")

    key, got = fresh(docs.drop(name), "leak_key", "found")
    out = docs.drop(name).withColumn(key, text_key()).join(hits.select(F.col("key").alias(key), F.col("found").alias(got)), key, "left")
    return out.select(*[out[c] for c in docs.columns if c != name], F.coalesce(out[got], empty).alias(name))


def _close(places: str) -> Column:
    """Whether `ask` of the sorted places lie within `span` words."""
    return F.expr(f"exists(sequence(0, size({places}) - 1), i -> i + ask <= size({places}) and {places}[least(i + ask, size({places})) - 1] - {places}[i] < span)")
