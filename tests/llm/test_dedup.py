"""Joins and repeats against brute force; decontamination of planted copies."""

import hashlib
import random

import numpy as np
import pytest

from loomspark.llm import decontam, jaccard, sufdedup


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    low = {k: min((x for x in ids if x is not None), default=None) for k, ids in groups.items()}
    return sorted((str(rows[k][0]), len(sets[k]), str(low[find(k)])) for k in range(len(rows)))


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["the", "of", "and"] * 5
    texts = []
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([4, 30, 60, 120]))]
        for _ in range(r.choice([1, 2, 8, 15])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice([*vocab, f"new{r.random()}"])
            texts.append(" ".join(copy))
    texts += ["", None, " \n", "one", "ONE", "one two", "the of and the of and", "x " * 3000]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(0, texts[0]), (3, "w1 w2 w3 other"), (None, texts[5]), (None, "alone in the world")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_components_are_brute_force(spark, n, num, den):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, prefix long").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_components(df, n, num, den).collect())
    assert got == brute_components(rows, n, num, den)


def test_hot_shingles_meet_all_their_places(spark, monkeypatch):
    r = random.Random(5)
    sets = [("g%d" % k, 20, [r.randrange(40) for _ in range(r.choice([1, 3, 6]))]) for k in range(50)]
    sets = [(g, n, list(dict.fromkeys(p))) for g, n, p in sets] + [("none", 20, [])]
    df = spark.createDataFrame(sets, "group string, n_shingles long, prefix array<long>").repartition(3)
    at = {}
    for g, n, p in sets:
        for i, t in enumerate(p):
            if 180 * (n - i) >= 80 * (n + 16):
                at.setdefault(t, []).append((i, n, g))
    want = sorted((t, i, n, g, min(x), len(x)) for t, x in at.items() if len(x) > 1 for i, n, g in x)
    for share, chunk in ((20_000, 1 << 20), (3, 20), (0, 1)):
        monkeypatch.setattr(jaccard, "SHARE", share)
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        got = jaccard._shared_spots(df, 80, 100).select("token", "i", "n_shingles", "group", "hub", "size").collect()
        assert sorted((x.token, x.i, x.n_shingles, x.group, tuple(x.hub), x.size) for x in got) == want
    monkeypatch.setattr(jaccard, "CHUNK", 1 << 20)
    monkeypatch.setattr(jaccard, "SHARE", 3)
    assert jaccard._hot_tokens(df).filter("n_rows <= 3").isEmpty() and not jaccard._hot_tokens(df).isEmpty()


def test_folded_parity_is_that_of_coarser_cells(spark):
    r = random.Random(6)
    words = [r.getrandbits(64) - (1 << 63) for _ in range((1 << jaccard.BITS) // 64)]
    df = spark.createDataFrame([(words,)], "bits array<long>")
    n = (1 << jaccard.COARSE) // 64
    want = [0] * n
    for k, w in enumerate(words):
        want[k % n] ^= w
    assert df.select(jaccard._folded(df.bits).alias("x")).first().x == want


def test_deduplicate_keeps_one_of_each(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard.deduplicate(df, 5, 80, 100).collect()
    blank = sum(not (t or "").split() for _, t in rows)
    full = [(k, t) for k, (_, t) in enumerate(rows) if (t or "").split()]
    assert len(kept) == blank + len({c for *_, c in brute_components(full, 5, 80, 100)})
    assert jaccard.deduplicate(df.limit(0)).count() == 0


def brute_removed(texts, span):
    starts = {}
    for t in texts:
        for k in range(len(t) - span + 1):
            starts[t[k : k + span]] = starts.get(t[k : k + span], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - span + 1):
            if starts[t[k : k + span]] > 1:
                gone[k : k + span] = True
        gone = gone[:-1]
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_are_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40), text(25), text(90)]
    texts = [text(r.randrange(5, 60)) + shared[k % 3] + text(r.randrange(1, 60)) for k in range(25)]
    texts += [shared[2], shared[2], "ab" * 400, "ab" * 100, "", None, "short", shared[0] + text(3) + shared[0], "q" * 500, texts[0][10:], text(30) + shared[1][:-1]]
    df = spark.createDataFrame([(k % 30, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, key long").repartition(4)
    got = sorted((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in sufdedup.remove_repeats(df, span=100).collect())
    assert got == brute_removed([(t or "").encode() for t in texts], 100)
    assert sufdedup.remove_repeats(df.limit(0)).count() == 0


def test_deep_shallow_is_sorting():
    r = random.Random(2)
    base = bytes(r.choice(b"ab") for _ in range(300))
    strings = [base[: r.randrange(300)] + bytes(r.choice(b"abc") for _ in range(r.randrange(120))) for _ in range(300)] + [b"", b"", base, base]
    order, common = sufdedup.deep_shallow(strings)
    assert [strings[k] for k in order] == sorted(strings)
    for k in range(1, len(order)):
        assert common[k] == sufdedup._common(strings[order[k - 1]], strings[order[k]])


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (decontam.MATCH if a[i - 1] == b[j - 1] else decontam.MISS), h[i - 1, j] + decontam.GAP, h[i, j - 1] + decontam.GAP)
    return h.max()


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(0)
    items, windows = rng.integers(1, 5, (20, 12)), rng.integers(1, 5, (20, 30))
    items[3, 7:] = -1
    windows[5, 20:] = -2
    want = [plain_alignment([x for x in a if x > 0], [x for x in b if x > 0]) for a, b in zip(items.tolist(), windows.tolist(), strict=True)]
    assert decontam.align(items, windows).tolist() == want


@pytest.mark.parametrize("block", [1024, 50])
def test_leaks(spark, block):
    r = random.Random(1)
    vocab = [f"v{k}" for k in range(400)] + ["the", "of", "and"] * 20
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = {k: text(r.choice([8, 20, 40, 150])) for k in range(12)}
    rows, planted = [], set()
    for d in range(200):
        words = text(r.randrange(0, 300))
        if d % 8 == 0:
            k = r.randrange(12)
            copy = [w.upper() + "," for w in items[k]]
            for at in range(5, len(copy), 9):
                copy[at] = f"edit{at}"
            words[10:10] = copy
            planted.add((d, k))
        rows.append((d, " ".join(words), "x"))
    rows += [(300, None, "x"), (301, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(50, None), (51, "the of"), (52, "")], "item_id long, text string")
    out = decontam.find_leaks(docs, bench, block=block).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, h.item_id) for r in out for h in r.hits} == planted
    assert all(h.score >= 0.5 for r in out for h in r.hits)
    assert all(not r.hits for r in decontam.find_leaks(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_densely_edited_leaks_equal_smith_waterman(spark, threshold):
    r = random.Random(3)
    vocab = [f"v{k}" for k in range(60)] + ["the", "of"] * 10
    items = {k: [r.choice(vocab) for _ in range(r.choice([5, 9, 30, 60]))] for k in range(10)}
    docs = {}
    for every in (2, 3, 4, 5):
        for k, item in items.items():
            replaced = [f"x{at}" if at % every == every - 1 else w for at, w in enumerate(item)]
            added = [x for at, w in enumerate(item) for x in ([w, f"y{at}"] if at % every == every - 1 else [w])]
            for edited in (replaced, added, [w for at, w in enumerate(item) if at % every != every - 1], [x for w in item for x in (w, "z")]):
                docs[len(docs)] = [r.choice(vocab) for _ in range(r.randrange(30))] + edited + [r.choice(vocab) for _ in range(r.randrange(30))]
    number = {w: n for n, w in enumerate(sorted({w for ws in [*docs.values(), *items.values()] for w in ws}), 1)}
    pad = lambda rows, fill: np.array([[number[w] for w in x] + [fill] * (180 - len(x)) for x in rows])
    pairs = [(d, k) for d in docs for k in items]
    scores = decontam.align(pad([items[k] for _, k in pairs], -1), pad([docs[d] for d, _ in pairs], -2))
    want = {(d, k): s / (2 * len(items[k])) for (d, k), s in zip(pairs, scores.tolist(), strict=True) if s / (2 * len(items[k])) >= threshold}
    assert len(want) > 60
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(x.doc_id, h.item_id): h.score for x in decontam.find_leaks(table, bench, threshold=threshold).collect() for h in x.hits}
    assert got == want


def test_keys_of_many_contexts_do_not_meet(spark, monkeypatch):
    r = random.Random(7)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = text(130)
    texts = [text(r.randrange(60, 90)) + passage[r.randrange(12) :] + text(r.randrange(60, 90)) for _ in range(60)] + [passage, passage + "x", text(400)]
    met, real = [], sufdedup._repeated

    def watched(rows, *args):
        met.append(max((x["count"] for x in rows.select("key", "ctx").distinct().groupBy("key").count().collect()), default=0))
        return real(rows, *args)

    monkeypatch.setattr(sufdedup, "_repeated", watched)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for hot in (10, 1):
        got = sorted((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in sufdedup.remove_repeats(df, span=100, hot=hot).collect())
        assert got == brute_removed([t.encode() for t in texts], 100) and sum(x[1] for x in got) > 0
        assert met[-1] <= hot
    sufdedup.remove_repeats(df, span=100)
    assert met[-1] > 10


def test_pairs_of_long_texts_are_told_apart_without_them(spark):
    r = random.Random(8)
    base = [f"w{r.randrange(500)}" for _ in range(4 * jaccard.LONG)]
    some, close = list(base), list(base)
    for k in r.sample(range(len(base)), 150):
        some[k] = "new"  # about 750 shingles of five words go and as many come: similar
    for k in range(0, len(base), 9):
        close[k] = "other"  # more than half of them go: not similar
    other = [f"w{r.randrange(500)}" for _ in range(len(base))]
    texts = {b"0": base, b"1": some, b"2": close, b"3": other, b"4": base[:100]}
    sets = {k: len(shingles(" ".join(t), 5)) for k, t in texts.items()}
    df = spark.createDataFrame([(k, sets[k], " ".join(t).encode()) for k, t in texts.items()], "set_key binary, n_shingles long, text binary")
    pairs = spark.createDataFrame([(b"0", b"1"), (b"0", b"2"), (b"0", b"3"), (b"0", b"4"), (b"1", b"0")], "a binary, b binary")
    got = sorted((bytes(x.a), bytes(x.b)) for x in jaccard._undecided(pairs, df, 5, 80, 100).collect())
    assert got == [(b"0", b"1"), (b"0", b"4"), (b"1", b"0")]  # a short text's bits have said what they can
    assert jaccard._undecided(pairs, df.filter("set_key = '4'"), 5, 80, 100).count() == 5


@pytest.mark.parametrize("long", [0, 40])
def test_components_are_brute_force_if_most_texts_are_long(spark, monkeypatch, long):
    monkeypatch.setattr(jaccard, "LONG", long)
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_components(df, 5, 80, 100).collect())
    assert got == brute_components(rows, 5, 80, 100)


def test_places_of_shingles_carry_short_names(spark):
    _, of = jaccard._classes_and_roots(spark.createDataFrame(corpus(), "doc_id long, text string"), 5, 80, 100)
    assert dict(of.dtypes)["group"] == "bigint"


def test_components_that_are_stars_need_no_round(spark, monkeypatch):
    from loomspark.llm import components

    made, stored = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: made.append(name) or stored(df, name))
    star = spark.createDataFrame([(1, 5), (6, 1), (1, 6), (2, 9), (3, 3)], "a long, b long")
    assert sorted(map(tuple, components.connected(star).collect())) == [(1, 1), (2, 2), (5, 1), (6, 1), (9, 2)] and len(made) == 1
    path = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31)], "a long, b long")
    assert sorted(map(tuple, components.connected(path).collect())) == [*((k, 0) for k in range(21)), (30, 30), (31, 30)]
    assert components.connected(path.limit(0)).count() == 0
