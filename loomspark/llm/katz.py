"""Katz backoff language model: Good-Turing discounted bigrams over unigrams, exactly normalised.

The corpus is cut into chunks of whole documents. A chunk keeps its words as
numbers of its own vocabulary. Counts travel in blobs: each chunk sends, for
every part of the key space, its sorted keys and counts; a part adds them up
and sends the totals back to the chunks in the same order. So a frequent word
is one entry per chunk, no task holds a whole model, and nothing but sums of fixed size
reaches the driver.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, grouped, mix, stored, text_bytes, word_hashes

#: kinds of rows: 0 chunks, 1 word totals, 2 bigram totals, 3 half-scored chunks, 4 histories, 5 backoff weights, 9 sums
ROW = "part int, chunk long, kind int, a binary, b binary, c binary"
END, START = np.uint64(0x0123456789ABCDEF), np.uint64(0x0FEDCBA987654321)
LARGEST = 5  # counts over this are not discounted


def pack(x: np.ndarray) -> bytes:
    """An array as bytes: planes of equal significance together, then deflated."""
    head = x.dtype.str.encode().ljust(4)
    return head + zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:4].decode().strip())
    planes = np.frombuffer(zlib.decompress(data[4:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    """A sorted array of unsigned numbers, by its gaps."""
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    x = unpack(data)
    return np.cumsum(x, dtype=x.dtype)


def small(x: np.ndarray) -> np.ndarray:
    """Counts in the least type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _batch(rows: list[tuple]):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [()] * 6
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "chunk", "kind", "a", "b", "c"])


def grouped_rows(frame: DataFrame, by: str, work: Callable[[int, list[tuple]], Iterator[tuple]], schema: str = ROW, make=_batch) -> DataFrame:
    """work(key, rows) on all rows of a chunk or a part, which arrive sorted by kind and the other key."""
    other = "part" if by == "chunk" else "chunk"

    def run(batches):
        last, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                key = row[1] if by == "chunk" else row[0]
                if key != last and held:
                    yield make(list(work(last, held)))
                    held = []
                last = key
                held.append(row)
        if held:
            yield make(list(work(last, held)))

    return frame.repartition(by).sortWithinPartitions(by, "kind", other).mapInArrow(run, schema)


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """One row per chunk: documents, lengths, vocabulary (most frequent first) and words as numbers."""

    def work(batches):
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list = []
        hashes: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal made, size
            tokens = np.concatenate(hashes)
            vocab, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            a = pickle.dumps({"ids": list(ids), "held": np.array(held, bool), "lens": np.array([len(h) for h in hashes], np.int64)})
            row = (0, (task << 32) + made, 0, a, pack(vocab[order]), pack(rank[inverse]))
            made += 1
            size = 0
            for x in (ids, held, hashes):
                x.clear()
            return _batch([row])

        for batch in batches:
            names, outs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, texts in grouped(batch.column(2)):
                words, at = word_hashes([t.lower() for t in texts])
                for k in range(len(texts)):
                    ids.append(names[first + k])
                    held.append(bool(outs[first + k]))
                    hashes.append(np.append(words[at[k] : at[k + 1]], END))
                    size += len(hashes[-1])
                    if size >= chunk_tokens:
                        yield flush()
        if ids:
            yield flush()

    return docs.mapInArrow(work, ROW)


class Chunk:
    """A chunk's arrays, and its distinct bigrams sorted by key."""

    def __init__(self, row: tuple):
        head = pickle.loads(row[3])
        self.ids, self.held, self.lens = head["ids"], head["held"], head["lens"]
        self.vocab, self.tokens = unpack(row[4]), unpack(row[5]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.trains = ~self.held[self.doc]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the vocabulary by key, its keys in that order, their training counts."""
        order = np.argsort(self.vocab)
        counts = np.bincount(self.tokens[self.trains], minlength=len(self.vocab))
        return order, self.vocab[order], counts[order]

    def bigrams(self):
        """Sorted keys, training counts, history and word of each distinct bigram; each token's bigram."""
        v = len(self.vocab)
        history = np.concatenate([[v], self.tokens[:-1]])
        history[np.cumsum(self.lens)[:-1]] = v
        pairs, inverse = np.unique(history * (v + 1) + self.tokens, return_inverse=True)
        h, w = np.divmod(pairs, v + 1)
        names = np.append(self.vocab, START)
        keys = mix(names[h] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(names[w]))
        counts = np.bincount(inverse[self.trains], minlength=len(pairs))
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return keys[order], counts[order], h[order], w[order], place[inverse]


def _edges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's slice of sorted keys begins; parts are equal ranges of keys."""
    step = (1 << 64) // parts
    return np.concatenate([[0], np.searchsorted(keys, np.array([step * k for k in range(1, parts)], np.uint64)), [len(keys)]]).astype(np.int64)


def _sent(keys: np.ndarray, parts: int, chunk: int, kind: int, *values: np.ndarray) -> Iterator[tuple]:
    at = _edges(keys, parts)
    for p in range(parts):
        a, b = at[p], at[p + 1]
        if b > a:
            yield (p, chunk, kind, pack_sorted(keys[a:b]), *(pack(small(v[a:b]) if v.dtype.kind in "iu" else v[a:b]) for v in values), *[None] * (2 - len(values)))


def _totals(sent: DataFrame, kind: int) -> DataFrame:
    """Totals of sent keys, back to the chunks: counts, and which chunk owns a key (the first that trains on it)."""

    def work(part, rows):
        keys = [unpack_sorted(r[3]) for r in rows]
        counts = np.concatenate([unpack(r[4]).astype(np.int64) for r in rows])
        sizes = np.cumsum([0] + [len(k) for k in keys])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
        some = np.flatnonzero(counts > 0)
        owner = np.zeros(len(counts), np.uint8)
        _, first = np.unique(inverse[some], return_index=True)
        owner[some[first]] = 1
        of_counts = np.bincount(np.minimum(totals, LARGEST + 2), minlength=LARGEST + 3)
        yield (part, -1, 9, pickle.dumps({"sum": int(totals.sum()), "distinct": int((totals > 0).sum()), "of_counts": of_counts}), None, None)
        for k, r in enumerate(rows):
            a, b = sizes[k], sizes[k + 1]
            yield (part, r[1], kind, pack(small(totals[inverse[a:b]])), pack(np.packbits(owner[a:b])), None)

    return grouped_rows(sent, "part", work)


def _sums(totals: DataFrame) -> dict:
    rows = [pickle.loads(r.a) for r in totals.filter("kind = 9").select("a").collect()]
    return {"sum": sum(r["sum"] for r in rows), "distinct": sum(r["distinct"] for r in rows), "of_counts": sum((r["of_counts"] for r in rows), np.zeros(LARGEST + 3, np.int64))}


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """Katz's Good-Turing discounts of counts 0 to LARGEST + 1; the last stands for all above: 1.

    Where counts of counts are too few to give a discount between 0 and 1,
    half an occurrence is taken off instead.
    """
    out = np.ones(LARGEST + 2)
    n = of_counts.astype(float)
    top = (LARGEST + 1) * n[LARGEST + 1] / n[1] if n[1] else 1.0
    for r in range(1, LARGEST + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _take(rows: list[tuple], column: int, sizes: list[int] | None = None) -> np.ndarray:
    """The parts' arrays, in key order, as one."""
    arrays = [unpack(r[column]) for r in rows]
    if sizes is not None:
        arrays = [np.unpackbits(x, count=n) for x, n in zip(arrays, sizes, strict=True)]
    return np.concatenate(arrays) if arrays else np.zeros(0)


def score(docs: DataFrame, by: int = 7, out: int = 2, chunk_tokens: int = 2_000_000, part_keys: int = 1_500_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from documents whose crc32 of the id modulo `by` is not `out` (a null id
    counts among them). Tokens are the words with A-Z lower-cased, then one end; null
    texts are empty and hold the end alone. base_score is the add-one unigram's log10
    probability. score is the Katz model's: with c(hw) > 0,
        P(w|h) = d(c) c(hw) / (c(h) + 1), else alpha(h) P(w);
        P(w) = d'(c) c(w) / (N + 1), and all unknown words share what is left.
    alpha(h) makes the sum over the vocabulary and the unknown word exactly 1. The added occurrence
    keeps some mass for backing off where no count is discounted. Repeated ids and rows
    are documents like others; with nothing to learn from, scores are 0; an empty table gives no rows.

    A chunk has about chunk_tokens tokens, a part about part_keys keys: these bound the
    memory of a task; the numbers of chunks and parts grow with the corpus.
    """
    held = F.coalesce(fold("doc_id", by) == out, F.lit(False))
    chunks = stored(_chunks(docs.select("doc_id", held.alias("held"), text_bytes().alias("text")), chunk_tokens), "chunks")
    parts = max(8, -(-chunks.count() * chunk_tokens // (2 * part_keys)))

    def words(chunk, rows):
        _, keys, counts = Chunk(rows[0]).words()
        return _sent(keys, parts, chunk, 0, counts)

    def pairs(chunk, rows):
        keys, counts, *_ = Chunk(rows[0]).bigrams()
        return _sent(keys, parts, chunk, 0, counts)

    def each(work):
        def run(batches):
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    yield _batch(list(work(row[1], [row])))

        return chunks.mapInArrow(run, ROW)

    uni = stored(_totals(each(words), 1), "unigrams")
    bi = stored(_totals(each(pairs), 2), "bigrams")
    one, two = _sums(uni), _sums(bi)
    d1, d2 = discounts(one["of_counts"]), discounts(two["of_counts"])
    n, v = one["sum"], one["distinct"]
    unknown = 1 - float((d1[1:-1] * np.arange(1, LARGEST + 1) * one["of_counts"][1 : LARGEST + 1]).sum() + (n - (np.arange(1, LARGEST + 1) * one["of_counts"][1 : LARGEST + 1]).sum())) / (n + 1)

    def half(chunk, rows):
        c = Chunk(rows[0])
        order, *_ = c.words()
        total = np.empty(len(c.vocab), np.int64)
        total[order] = _take([r for r in rows if r[2] == 1], 3)
        keys, _, h, w, token = c.bigrams()
        told = [r for r in rows if r[2] == 2]
        sizes = np.diff(_edges(keys, parts))
        joint, own = _take(told, 3).astype(np.int64), _take(told, 4, [int(s) for s in sizes if s]).astype(bool)
        p = np.where(total > 0, d1[np.minimum(total, LARGEST + 1)] * total / (n + 1), unknown)
        before = np.append(total, starts)[h]  # how often the history was seen
        discounted = d2[np.minimum(joint, LARGEST + 1)] * joint / (before + 1)
        seen = joint > 0
        logs = np.where(seen, np.log10(np.where(seen, discounted, 1)), np.log10(p)[w])
        docs_n = len(c.lens)
        partial = np.bincount(c.doc, logs[token], docs_n)
        base = np.bincount(c.doc, np.log10(total + 1.0)[c.tokens], docs_n) - c.lens * np.log10(n + v + 1)
        known = np.bincount(c.doc, (total > 0)[c.tokens], docs_n).astype(np.int64)
        # histories whose weight is needed here, or to which this chunk adds
        missing = ~seen[token] & (before[token] > 0)
        names = np.append(c.vocab, START)
        hist, inverse = np.unique(np.concatenate([h[own], h[token][missing]]), return_inverse=True)
        by_key = np.argsort(names[hist])
        place = np.empty(len(by_key), np.int64)
        place[by_key] = np.arange(len(by_key))
        inverse = place[inverse]
        k = int(own.sum())
        mass = np.bincount(inverse[:k], discounted[own], len(hist))
        lower = np.bincount(inverse[:k], p[w][own], len(hist))
        head = {"ids": c.ids, "held": c.held, "lens": c.lens, "known": known, "base": base, "partial": partial}
        yield (0, chunk, 3, pickle.dumps(head), pack(c.doc[missing].astype(np.uint32)), pack(inverse[k:].astype(np.uint32)))
        yield from _sent(names[hist][by_key], parts, chunk, 4, mass, lower)

    # documents that training begins: how often the start was a history
    starts = int(chunks.filter("kind = 0").select("a").mapInArrow(_count_starts, "n long").agg(F.sum("n")).first()[0] or 0)
    halves = stored(grouped_rows(chunks.union(uni.filter("kind = 1")).union(bi.filter("kind = 2")), "chunk", half), "halves")

    def weights(part, rows):
        keys = [unpack_sorted(r[3]) for r in rows]
        sizes = np.cumsum([0] + [len(k) for k in keys])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        mass = np.bincount(inverse, np.concatenate([unpack(r[4]) for r in rows]), len(distinct))
        lower = np.bincount(inverse, np.concatenate([unpack(r[5]) for r in rows]), len(distinct))
        log = np.log10(np.maximum(1 - mass, 1e-300)) - np.log10(np.maximum(1 - lower, 1e-300))
        for k, r in enumerate(rows):
            yield (part, r[1], 5, pack(log[inverse[sizes[k] : sizes[k + 1]]]), None, None)

    alphas = grouped_rows(halves.filter("kind = 4"), "part", weights)
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def whole(_, rows):
        head, doc, place = pickle.loads(rows[0][3]), unpack(rows[0][4]).astype(np.int64), unpack(rows[0][5]).astype(np.int64)
        log = _take(rows[1:], 3)
        score = head["partial"] + (np.bincount(doc, log[place], len(head["lens"])) if len(doc) else 0)
        yield from zip(head["ids"], head["held"].tolist(), head["lens"].tolist(), head["known"].tolist(), [n] * len(score), head["base"].tolist(), score.tolist(), strict=True)

    def make(rows):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        columns = list(zip(*rows, strict=True))
        types = [to_arrow_type(kind), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return grouped_rows(halves.filter("kind = 3").union(alphas), "chunk", whole, schema, make)


def _count_starts(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": pa.array([int((~pickle.loads(x)["held"]).sum()) for x in batch.column(0).to_pylist()], pa.int64())})
