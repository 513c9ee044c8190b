"""Classifier, language identification and language model: accuracy and brute force."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np

from loomspark.llm import katz, langid, quality
from loomspark.llm.common import fold, word_hashes

DIR = "/root/testdata/sf0.01"


def test_words_are_those_of_the_contract():
    import re

    texts = ["a  b c\x0bd", "", " \n", "x\x1cy z", "é É"]
    hashes, first = word_hashes([t.encode() for t in texts])
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert b - a == len(words) and len(set(hashes[a:b].tolist())) == len(set(words))
    assert word_hashes([b"q w"])[0][1] == word_hashes([b"zz w "])[0][1]


def test_quality_is_learnt(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    model = quality.train(docs, labels.filter(fold() != 0))
    out = {r.doc_id: r.score for r in quality.score(docs, model, ["doc_id"]).collect()}
    held = [(r.quality, out[r.doc_id]) for r in labels.filter(fold() == 0).collect()]
    assert np.mean([(s >= 0.3) == (q == 1) for q, s in held]) > 0.95
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "x" * 300_000), (2, "word " * 250_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model, ["doc_id"]).collect())
    assert quality.score(docs.limit(0), model, ["doc_id"]).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs.limit(3), none, ["doc_id"]).collect()} == {0.5}
    sure = quality.train(docs, labels.filter("quality = 1"))
    assert min(r.score for r in quality.score(docs.limit(3), sure, ["doc_id"]).collect()) > 0.9


def test_attention_learns_and_scores_alike_in_batches():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(k, quality.WIDTH)).astype(np.float32) for k in (1, 3, 5, 2) for _ in range(30)]
    y = np.array([float(b[:, 0].max() > 0.5) for b in bags])
    m = quality.fit(bags, y, epochs=60)
    p = np.array([quality._forward(m, b, np.array([0]))[0][0] for b in bags])
    assert ((p > 0.5) == y).mean() > 0.95
    together = quality._forward(m, np.concatenate(bags[:4]), np.cumsum([0] + [len(b) for b in bags[:3]]))[0]
    assert np.allclose(together, p[:4])


def test_languages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.train(docs.filter(fold() != 0))
    out = langid.predict(docs.filter(fold() == 0), model, ["doc_id", "lang", "score"] if "score" in docs.columns else ["doc_id", "lang"]).collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 ... 3", "en"), (4, "and the of " * 100_000, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model, ["doc_id"]).collect()}
    assert [got[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] in model.names
    empty = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs.limit(5), empty, ["doc_id"]).collect()} == {"und"}


def brute_katz(rows):
    """Scores by the formulas in katz.score's docstring, with plain dictionaries."""
    end, start = object(), object()
    seqs = [(i, (t or "").encode().lower().split() + [end]) for i, t in rows]
    train = [w for i, w in seqs if i is None or crc32(str(i).encode()) % 7 != 2]
    uni, bi, hist = Counter(), Counter(), Counter()
    for w in train:
        uni.update(w)
        bi.update(zip([start, *w[:-1]], w, strict=True))
        hist.update([start, *w[:-1]])
    n, v = sum(uni.values()), len(uni)

    def of(counts):
        out = np.zeros(katz.LARGEST + 3, int)
        for c in counts.values():
            out[min(c, katz.LARGEST + 2)] += 1
        return katz.discounts(out)

    d1, d2 = of(uni), of(bi)
    p = {w: d1[min(c, katz.LARGEST + 1)] * c / (n + 1) for w, c in uni.items()}
    unknown, after = 1 - sum(p.values()), defaultdict(list)
    for (h, w), c in bi.items():
        after[h].append((w, d2[min(c, katz.LARGEST + 1)] * c / (hist[h] + 1)))
    alpha = {h: (1 - sum(x for _, x in l)) / (1 - sum(p[w] for w, _ in l)) for h, l in after.items()}

    def prob(h, w):
        c = bi.get((h, w), 0)
        return d2[min(c, katz.LARGEST + 1)] * c / (hist[h] + 1) if c else alpha.get(h, 1) * p.get(w, unknown)

    for h in [*after][:20]:
        assert abs(sum(prob(h, w) for w in uni) + alpha[h] * unknown - 1) < 1e-9
    return [(len(w), sum(x in uni for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(prob(h, x)) for h, x in zip([start, *w[:-1]], w, strict=True))) for _, w in seqs]


def test_katz_is_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(None, None), (3, ""), (3, ""), (5, "a a a a a a a a " * 50), (16, "never seen words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y").repartition(3)
    got = sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in katz.score(df, chunk_tokens=3000, part_keys=500).collect()])
    want = sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in brute_katz(rows)])
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-5 and abs(g[4] - w[4]) < 1e-5
    assert katz.score(df.limit(0)).count() == 0
    held = df.filter("doc_id = 16")
    assert {r.held_out for r in katz.score(held).collect()} == {crc32(b"16") % 7 == 2}


def test_long_texts_score_as_short_ones(monkeypatch):
    rng = np.random.default_rng(2)
    m = quality.fit([rng.normal(size=(3, quality.WIDTH)).astype(np.float32) for _ in range(40)], rng.integers(0, 2, 40).astype(float), epochs=3)
    text = b" ".join(b"word%d" % k for k in rng.integers(0, 500, 20_000))
    monkeypatch.setattr(quality, "PIECE", 20_000)
    assert abs(quality.score_long(m, text) - quality._forward(m, quality.encode(text), np.array([0]))[0][0]) < 1e-6
    assert abs(quality.score_long(m, b" ") - quality._forward(m, quality.encode(b""), np.array([0]))[0][0]) < 1e-12


def plain_passages(text):
    """One row of features per passage, byte by byte and word by word."""
    blank = b" \t\n\r\x0b\x0c"
    starts = [i for i, c in enumerate(text) if c not in blank and (i == 0 or text[i - 1] in blank)]
    lines = [x for x in text.split(b"\n") if x]
    out = []
    for k in range(0, len(starts), 50):
        a, b = (0 if k == 0 else starts[k]), (starts[k + 50] if k + 50 < len(starts) else len(text))
        x, words = np.zeros(quality.WIDTH), text[a:b].split()
        for i in range(a, b):
            if i + 1 < len(text):
                x[int(quality._CLASSES[text[i]]) * 10 + int(quality._CLASSES[text[i + 1]])] += 1
        x[:100] = np.sqrt(x[:100] / (b - a))
        x[100:106] = len(set(words)) / len(words), sum(u == v for u, v in zip(words, words[1:])) / len(words), min((b - a) / len(words) / 10, 5), len(words) / 50, min(max(map(len, words)) / 50, 4), 1
        x[106], x[107] = 1 - len(set(lines)) / len(lines), np.log1p(len(starts)) / 10
        out.append(x)
    return np.array(out).reshape(-1, quality.WIDTH)


def test_passages_do_not_depend_on_blocks():
    rng = np.random.default_rng(5)
    texts = [b"", b" \n", b"one", b"x" * 3000 + b" y", b"\n \n".join(b"w%d" % k for k in range(149)) + b"  ", b" lead " * 120, "é ü\x1c ß ".encode() * 90]
    texts += [b"".join(rng.choice([b"a", b"Bc", b" ", b"\n", b"9", b"!", b"  "], 4000).tolist()) for _ in range(3)]
    for text in texts:
        want = plain_passages(text)
        for piece in (7, 64, 1000, 1 << 20):
            got = np.concatenate([*quality.encoded_pieces(text, piece), np.zeros((0, quality.WIDTH))])
            assert got.shape == want.shape and np.allclose(got, want, atol=1e-5), (text[:20], piece)


def test_table_scores_equal_a_plain_forward_pass(spark):
    """Scores of documents, long ones in blocks, against passages and attention written out for one document at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    more = spark.createDataFrame([(-1, None), (-2, "word other " * 120_000)], "doc_id long, text string")
    rng = np.random.default_rng(6)
    m = quality.fit([rng.normal(size=(3, quality.WIDTH)).astype(np.float32) for _ in range(40)], rng.integers(0, 2, 40).astype(float), epochs=3)
    for r in quality.score(docs.union(more), m, ["doc_id", "text"]).collect():
        text = (r.text or "").encode()
        x = plain_passages(text) if len(text) < 50_000 else quality.encode(text)
        x = x if len(x) else np.zeros((1, quality.WIDTH))
        h = [np.tanh(((v - m["mean"]) / m["std"]) @ m["W"] + m["b"]) for v in x]
        e = np.array([sum(w * np.tanh(v @ t) / (1 + np.exp(-(v @ u))) for w, t, u in zip(m["w"], m["V"].T, m["U"].T)) for v in h])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        z = sum(w * v for w, v in zip(a, h))
        assert abs(r.score - 1 / (1 + np.exp(-(z @ m["c"] + m["c0"][0])))) < 1e-5


def test_training_rows_count_whole_or_not(spark, monkeypatch):
    """The bound on passages passes rows over; it cuts none."""
    docs = spark.createDataFrame([(k, "w%d " % k * (50 * (k % 4 + 1))) for k in range(40)] + [(99, "x " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in [*range(40), 99]] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, y: seen.append(sorted(len(b) for b in bags)))
    quality.train(docs, labels)
    quality.train(docs, labels, passages=30)
    assert len(seen[0]) == 41 and seen[0][-1] == 1000 and sum(seen[1]) <= 30 and sum(seen[1]) > 26 and max(seen[1]) <= 4
