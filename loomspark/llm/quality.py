"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages. Each passage is encoded; gated attention,
learned from document labels alone, weighs the encodings; the weighted sum is
scored. Counting runs in Spark tasks; only a bounded sample of labelled bags
reaches the driver, where the few thousand weights are fitted.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, grouped, text_bytes, written

PASSAGE, PIECE, HIDDEN, GATE = 50, 1 << 20, 24, 12
_CLASSES = np.full(256, 8, np.uint8)  # 8: any other mark
for _k, _chars in enumerate((b" ", b"\t\n\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"|")):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 9  # bytes of letters beyond ASCII
WIDTH = 100 + 8


def _starts(kind: np.ndarray) -> np.ndarray:
    """Where words start in bytes of these classes, the first of which starts one unless it is blank."""
    blank = kind < 2
    return np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))


def _count(text: bytes, piece: int) -> int:
    """Words of a text, counted block by block."""
    total, inside = 0, False
    for at in range(0, len(text), piece):
        kind = _CLASSES[np.frombuffer(text[at : at + piece], np.uint8)]
        total += len(_starts(kind)) - (inside and kind[0] >= 2)
        inside = bool(kind[-1] >= 2)
    return total


def encoded_pieces(text: bytes, piece: int | None = None):
    """One row of WIDTH numbers per passage of PASSAGE words, in blocks; an empty text gives none.

    The first 100 are shares of byte-class pairs, the others tell how varied,
    how long and how repetitive the passage's words and the document's lines are.
    A block ends where a passage does, and what is left of it begins the next, so
    that passages do not depend on the size of blocks. A passage longer than a block makes the block longer.
    """
    piece = piece or PIECE
    lines = [x for x in text.split(b"\n") if x]
    unlike = 1 - len(set(lines)) / len(lines) if lines else 0.0
    del lines
    n_words, at, size = _count(text, piece), 0, piece
    while at < len(text):
        last = at + size >= len(text)
        kind = _CLASSES[np.frombuffer(text[at : at + size], np.uint8)]
        starts = _starts(kind)
        count = -(-len(starts) // PASSAGE) if last else (len(starts) - 1) // PASSAGE
        if not last and count < 1:
            size *= 2
            continue
        if not count:
            return
        end = len(kind) if last else int(starts[count * PASSAGE])
        edges = np.append(starts[: count * PASSAGE : PASSAGE], end)
        edges[0] = 0
        home = np.repeat(np.arange(count), np.diff(edges))
        first = kind[:end] if not last else kind[:-1]  # each byte but the text's last makes a pair with the next
        pairs = home[: len(first)] * 100 + first * 10 + kind[1 : len(first) + 1]
        shares = np.bincount(pairs, minlength=count * 100).reshape(count, 100)[:, :100]
        sizes = np.maximum(np.diff(edges), 1)
        x = np.zeros((count, WIDTH))
        x[:, :100] = np.sqrt(shares / sizes[:, None])
        words = text[at : at + end].split()
        own = [words[k : k + PASSAGE] for k in range(0, len(words), PASSAGE)]
        n = np.array([len(w) for w in own])
        x[:, 100] = [len(set(w)) / len(w) for w in own]
        x[:, 101] = [sum(map(eq, w, w[1:])) / len(w) for w in own]
        x[:, 102] = np.minimum(sizes / n / 10, 5)
        x[:, 103] = n / PASSAGE
        x[:, 104] = [min(max(map(len, w)) / 50, 4) for w in own]
        x[:, 105] = 1
        x[:, 106] = unlike
        x[:, 107] = np.log1p(n_words) / 10
        yield x.astype(np.float32)
        at, size = at + end, piece


def encode(text: bytes) -> np.ndarray:
    """All passages of a text; an empty text is one row of zeros."""
    rows = [*encoded_pieces(text)]
    return np.concatenate(rows) if rows else np.zeros((1, WIDTH), np.float32)


def _forward(m: dict, x: np.ndarray, first: np.ndarray):
    """Scores of bags whose passages lie in x from `first` on, and what training needs again."""
    h = np.tanh(((x - m["mean"]) / m["std"]) @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * s) @ m["w"]
    size = np.diff(np.append(first, len(x)))
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
    a /= np.repeat(np.add.reduceat(a, first), size)
    z = np.add.reduceat(a[:, None] * h, first)
    return 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["c0"], -30, 30))), (h, t, s, a, z, size)


def score_long(m: dict, text: bytes) -> float:
    """The score of a text of any length, as by _forward(), with one block of passages in memory.

    The attention's greatest exponent, the sum of weights and the weighted sum
    of encodings are carried from block to block.
    """
    top, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
    for x in encoded_pieces(text):
        h = np.tanh(((x - m["mean"]) / m["std"]) @ m["W"] + m["b"])
        e = (np.tanh(h @ m["V"]) / (1 + np.exp(-(h @ m["U"])))) @ m["w"]
        now = max(top, float(e.max()))
        a, fade = np.exp(e - now), np.exp(top - now)
        top, total, z = now, total * fade + a.sum(), z * fade + a @ h
    if not total:
        return float(_forward(m, np.zeros((1, WIDTH)), np.array([0]))[0][0])
    return float(1 / (1 + np.exp(-np.clip(z / total @ m["c"] + m["c0"][0], -30, 30))))


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 20, rate: float = 0.01, seed: int = 0) -> dict:
    """Weights by Adam on the logistic loss. No bags: a model that says 0.5; one class: its base rate."""
    rng = np.random.default_rng(seed)
    m = {"W": rng.normal(0, 0.1, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, GATE)), "U": rng.normal(0, 0.2, (HIDDEN, GATE)), "w": rng.normal(0, 0.2, GATE), "c": rng.normal(0, 0.2, HIDDEN), "c0": np.zeros(1)}
    names = list(m)
    m |= {"mean": np.zeros(WIDTH), "std": np.ones(WIDTH)}
    if not len(bags):
        m["c"][:] = 0
        return m
    every = np.concatenate(bags)
    m["mean"], m["std"] = every.mean(0, dtype=np.float64), every.std(0, dtype=np.float64) + 0.02
    rate_1 = np.clip(labels.mean(), 0.01, 0.99)
    m["c0"][0] = np.log(rate_1 / (1 - rate_1))
    if labels.min() == labels.max():
        m["c"][:] = 0
        return m
    moments, step = {k: (np.zeros_like(m[k]), np.zeros_like(m[k])) for k in names}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            x = np.concatenate([bags[i] for i in pick]).astype(np.float64)
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])[:-1]])
            p, (h, t, s, a, z, size) = _forward(m, x, first)
            d = (p - labels[pick]) / len(pick)
            g = {"c": z.T @ d, "c0": d.sum(keepdims=True)}
            dz = np.repeat(d[:, None] * m["c"], size, axis=0)
            da = (dz * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, first), size))
            g["w"] = (t * s).T @ de
            dt, ds = de[:, None] * m["w"] * s * (1 - t * t), de[:, None] * m["w"] * t * s * (1 - s)
            g["V"], g["U"] = h.T @ dt, h.T @ ds
            dh = (a[:, None] * dz + dt @ m["V"].T + ds @ m["U"].T) * (1 - h * h)
            g["W"], g["b"] = ((x - m["mean"]) / m["std"]).T @ dh, dh.sum(0)
            step += 1
            pace = rate * (1 - 0.9 * epoch / epochs)
            for k in names:
                grad = g[k] + (1e-4 * m[k] if k in ("W", "c") else 0)
                u, v = moments[k]
                u += 0.1 * (grad - u)
                v += 0.001 * (grad * grad - v)
                m[k] = m[k] - pace * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, label: str = "quality", seed: int = 1, passages: int = 400_000) -> dict:
    """Fits on at most `sample` labelled rows, taken by a hash of the id, and of these on as many, in order
    of a hash of id and text, as have `passages` passages in all: the documented bounds. Rows count whole or not at all; a row that has more
    than `passages` alone is passed over, and the next ones are tried.

    labels has doc_id and the 0/1 label; null ids and labels are left out, and of several labels of an id the smallest
    counts. Their count bounds the broadcast of sampled ids. The passages of the
    sample are encoded in Spark, kept as a table, and come to the driver as numbers. Other columns
    than doc_id and text are not read, so that none can clash.
    """
    picked = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("double")).alias("label"))
    picked = picked.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)

    def encoded(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                bag = encode(batch.column(2)[k].as_py())
                yield pa.RecordBatch.from_pydict({"h": batch.column(0).slice(k, 1), "label": batch.column(1).slice(k, 1), "n": pa.array([len(bag)], pa.int64()), "bag": pa.array([bag.astype(np.float16).tobytes()], pa.binary())})

    rows = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(picked), "doc_id").select(F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), "label", "text")
    bags, at = written(rows.mapInArrow(encoded, "h long, label double, n long, bag binary"), "bags")
    left, chosen = passages, []
    for h, n in bags.select("h", "n").orderBy("h", "n").limit(sample).collect():
        if n <= left:
            left -= n
            chosen.append(h)
    keys = docs.sparkSession.createDataFrame([(h,) for h in sorted(set(chosen))], "h long")
    got = bags.join(F.broadcast(keys), "h", "left_semi").orderBy("h", "label").limit(len(chosen)).toArrow()
    discard(docs.sparkSession, at)
    return fit([np.frombuffer(x.as_py(), np.float16).reshape(-1, WIDTH).astype(np.float32) for x in got.column("bag")], got.column("label").to_numpy())


def score(docs: DataFrame, model: dict, keep: list[str], name: str = "score") -> DataFrame:
    """Columns `keep` plus the score (0 to 1; higher: label 1 likelier), named `name`, with a "_" before it where keep has that.

    Reads whole texts; null counts as empty, and an empty text, one passage of
    zeros, gets a score too. Equal texts get equal scores. An empty table
    gives no rows. Only the text is an input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            scores: list[float] = []
            for _, texts in grouped(batch.column(batch.num_columns - 1)):
                out = np.zeros(len(texts))
                short = [k for k, t in enumerate(texts) if len(t) <= PIECE]
                if short:
                    bags = [encode(texts[k]) for k in short]
                    out[short] = _forward(m, np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1])[0]
                for k in set(range(len(texts))) - set(short):
                    out[k] = score_long(m, texts[k])
                scores += out.tolist()
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=schema.names)

    kept = docs.select(*keep)
    name, utf8 = fresh(kept, name, "text_utf8")
    schema = kept.schema.add(name, "double")
    return docs.select(*keep, text_bytes().alias(utf8)).mapInArrow(work, schema)
