"""Media containers, personal data and the pipeline."""

import hashlib
import re
import zlib

import pytest

import corpus_pipeline
from loomspark.llm import media, pii

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 64 * 256, 64 * 256 + 1, 64 * 700 + 5])
def test_container_round_trip(size):
    data = bytes(k * 7 % 256 for k in range(size))
    file = media.store(media.padded(data))
    found = media.sample_table(file)
    back = media.payload_of(file, found)
    assert back[:size] == data and not any(back[size:]) and len(back) % 64 == 0 and len(back) >= 64
    assert found["codec"] == "raw " and found["duration"] == len(back) and len(found["keys"]) == -(-len(found["sizes"]) // media.KEY)
    assert [p[-1] for p, *_ in media.walk(file)][:2] == [b"ftyp", b"moov"]


def test_probe_says_what_is_wrong(spark):
    good = media.store(media.padded(b"abc" * 900))
    rows = [(1, good), (2, None), (3, b""), (4, good[:-5]), (5, b"\0\0\0\x08free"), (6, good.replace(b"stsc", b"stsx"))]
    out = {r.doc_id: r for r in media.probe(spark.createDataFrame(rows, "doc_id long, media binary"), keep=("doc_id",)).collect()}
    assert out[1].error is None and out[1].codec == "raw " and out[1].samples == 43 and out[1].key_frames[1].length == 64
    assert good[out[1].key_frames[1].offset :][:64] == media.padded(b"abc" * 900)[1024:1088]
    assert all(out[k].error and out[k].codec is None for k in range(2, 7))


def test_round_trip_rows(spark):
    rows = [(1, "é" * 50), (1, "é" * 50), (2, ""), (None, None), (3, "x" * 200_000)]
    out = media.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    want = {}
    for i, t in rows:
        p = media.padded((t or "").encode())
        want[i] = (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len(out) == 5 and all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id] for r in out)
    assert len({r.media_sha256 for r in out if r.doc_id == 1}) == 1
    kept = media.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), with_media=True).collect()
    assert all(hashlib.sha256(r.media).hexdigest() == r.media_sha256 for r in kept)


def test_durations_tracks_and_empty_tables(spark):
    """The time table is read, and must agree with the others; of two tracks the first counts; no rows give none."""
    good = media.store(media.padded(b"abc" * 900))
    at = good.index(b"stts") + 4
    assert good[at : at + 16] == (0).to_bytes(4, "big") + (1).to_bytes(4, "big") + (43).to_bytes(4, "big") + (64).to_bytes(4, "big")
    slower = good[: at + 12] + (100).to_bytes(4, "big") + good[at + 16 :]
    assert media.sample_table(slower)["duration"] == 4300 and media.sample_table(good)["duration"] == 43 * 64
    fewer = good[: at + 8] + (42).to_bytes(4, "big") + good[at + 12 :]
    beyond = good.index(b"stss") + 12
    far = good[:beyond] + (99).to_bytes(4, "big") + good[beyond + 4 :]
    for bad, why in ((fewer, "disagree"), (far, "beyond")):
        with pytest.raises(ValueError, match=why):
            media.sample_table(bad)
    boxes = {p: (a, b) for p, a, b in media.walk(good)}
    a, b = boxes[b"moov", b"trak"]
    other = good[a - 8 : b].replace(b"raw ", b"sowt")
    start, end = boxes[(b"moov",)]
    two = good[: start - 8] + media.box(b"moov", good[start:end], other) + good[end:]
    shifted = {**media.sample_table(two)}
    assert shifted["codec"] == "raw " and len(shifted["sizes"]) == 43
    none = spark.createDataFrame([], "doc_id long, text string, media binary")
    assert media.round_trip(none).count() == 0 and media.probe(none, keep=("doc_id",)).count() == 0


FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for k, (kind, form) in enumerate(FORMS.items()):
        for m in form.finditer(text):
            digits = [int(c) for c in m[0] if c.isdigit() and c.isascii()]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            fine = {"email": True, "ip": all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{[*FORMS][k]}:{a}:{b}" for a, k, b in sorted(out))


ODD = ["a@b.c%x@d.e", "@@a@b.c", "x@y..z", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.300", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "+12", "é a@b.co 10.0.0.1", "", "9" * 5000, "a" * 50_000 + "@", "1.1.1." + "9" * 5000, "1.1.1." + "0" * 5000 + "7"]


def test_base_spans_are_the_forms(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()]
    for t in texts:
        assert pii.joined(pii.base_spans(t)) == plain_spans(t)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(k, f"Hello user{k}. contact: name{k}@mail.com and that is all that there is to say here about it") for k in range(30)]
    rows += [(100 + k, f"Some other words. contact: ZX-99{k}8817 is written here") for k in range(5)] + [(200, "The the serial ZX-7788990 of a thing"), (201, None), (202, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in pii.find(df, ["doc_id"]).collect()}
    assert len(out) == len(rows) and all(out[100 + k].spans.startswith("id:27:") and out[100 + k].base == "" for k in range(5))
    assert out[200].spans == "" and out[201].spans == "" and out[0].n_base[0] == 1
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[1] == rows[1][1].replace("name1@mail.com", "[EMAIL]") and "[ID] is written" in clean[101] and clean[201] is None
    assert pii.find(df.limit(0), ["doc_id"]).count() == 0


def test_contexts_of_rare_words_in_a_large_vocabulary(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"Hello user{k}. contact: name{k}@mail.com") for k in range(40)] + [(100 + k, f"contact: ZX-99{k}8817") for k in range(5)]
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda j: F.concat(F.lit("w"), F.translate((F.col("id") * 1000 + j).cast("string"), "0123456789", "abcdefghij"))), " ")
    many = spark.range(2000).select((F.col("id") + 1000).alias("doc_id"), words.alias("text"))
    out = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").union(many), ["doc_id"]).filter("doc_id < 1000").collect()}
    assert all(out[100 + k].startswith("id:9:") for k in range(5))


def test_contexts_are_followed_to_the_end(spark):
    name = lambda level, k: f"Q{'abcdef'[level]}-88{k}0{level}77"
    texts = [f"kzero m{k}@mail.com" for k in range(200)] + [f"kzero {name(1, k)}" for k in range(5)]
    for level in range(1, 5):
        texts += [f"k{'abcdef'[level]} {name(level, k)}" for k in range(5)] * 40 + [f"k{'abcdef'[level]} {name(level + 1, k)}" for k in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.spans for r in pii.find(df, ["doc_id"]).collect())


def test_withheld_seeds_are_discovered(spark):
    docs = spark.read.parquet(f"{DIR.replace('0.001', '0.01')}/documents.parquet")
    got = pii.discovery(docs, by=3).first()
    assert got.n_withheld > 0 and got.n_found >= 0.9 * got.n_withheld and got.n_others == 0
    assert tuple(pii.discovery(docs.limit(0)).first()) == (0, 0, 0)


def test_redaction_is_that_of_the_spans(spark):
    rows = [(k, f"to user{k}. contact: name{k}@mail.com or +1 (499) 555-650{k % 10} now", 1, k) for k in range(30)]
    rows += [(100 + k, f"contact: ZX-99{k}8817 or 10.0.0.{k}", 2, k) for k in range(5)] + [(1, rows[1][1], 1, 7), (None, None, 5, 0), (7, "", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, key long").repartition(3)
    spans = {r.text: r.spans for r in pii.find(df, ["text"]).collect()}
    want = []
    for doc, text, n, key in rows:
        clean, done = "", 0
        for kind, a, b in (x.split(":") for x in spans[text].split(",") if x):
            clean, done = clean + text[done : int(a)] + f"[{kind.upper()}]", int(b)
        want.append((doc, text if text is None else clean + text[done:], n if text is None else len(clean + text[done:]), key))
    got = pii.redact(df)
    assert got.columns == df.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum("[ID]" in (t or "") for _, t, *_ in want) == 5


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        if name != "mixing":
            assert docs.columns == columns
            now = docs.count()
            assert 0 < now <= before and (name != "personal_data" or now == before)
            before = now
            docs = docs.cache()
    assert set(columns) <= set(docs.columns) and docs.count() > 0
    assert corpus_pipeline.run(spark, DIR).count() == docs.count()


def plain_contexts(text, a, b):
    """Patterns of a to b as tuples of strings; texts here are short, so that no context is cut."""
    while b > a and not text[a].isalnum():
        a += 1
    before, after = [*re.finditer(r"[A-Za-z0-9]+", text[:a].lower())], re.search(r"[A-Za-z0-9]+", text[b:].lower())
    out = []
    if before:
        out += [("L", before[-1][0]), ("G", before[-1][0], text[:a].lower()[before[-1].end() :])]
    if len(before) > 1:
        out.append(("T", before[-2][0], before[-1][0]))
    return out + ([("R", after[0])] if after else [])


def plain_bootstrap(texts, confidence=0.8, support=5):
    from collections import Counter, defaultdict

    totals, found, edges = Counter(), [], defaultdict(Counter)
    for t in texts:
        words = [*re.finditer(r"[A-Za-z0-9]+", t.lower())]
        totals.update([("L", m[0]) for m in words] + [("R", m[0]) for m in words])
        totals.update([x for m, n in zip(words, words[1:]) for x in (("G", m[0], t.lower()[m.end() : n.start()]), ("T", m[0], n[0]))])
        base = pii.base_spans(t)
        own = [(a, b, True) for a, _, b in base]
        for m in re.finditer(r"(?<![A-Za-z0-9_.@%+-])[A-Za-z_-]*[0-9][A-Za-z0-9_-]*(?!@)", t):
            token = m[0].strip("-_")
            a = m.start() + m[0].index(token)
            if len(token) >= 6 and sum(c.isdigit() for c in token) >= 4 and not any(x < a + len(token) and a < y for x, _, y in base):
                own.append((a, a + len(token), False))
        found.append(own)
        for a, b, _ in own:
            for p in plain_contexts(t, a, b):
                edges[p][t[a:b]] += 1
    seeds = {t[a:b] for t, own in zip(texts, found) for a, b, is_base in own if is_base or re.fullmatch(r"[0-9a-f]{32,}", t[a:b])}
    weight, good = {}, {}
    while True:
        w = lambda x: 1.0 if x in seeds else weight.get(x, 0.0)
        hits = {p: sum(n * w(x) for x, n in of.items()) for p, of in edges.items()}
        scores = {p: hits[p] / (max(sum(of.values()), totals[p]) - 0.75 * (sum(of.values()) - hits[p])) for p, of in edges.items() if sum(w(x) >= confidence for x in of) >= support}
        before, good = len(good), {p: s for p, s in scores.items() if s >= confidence}
        if len(good) == before:
            break
        weight = {}
        for p, s in good.items():
            for x in edges[p]:
                weight[x] = 1 - (1 - weight.get(x, 0.0)) * max(1 - s, 1e-9)
    return [{(a, b) for a, b, is_base in own if not is_base and any(p in good for p in plain_contexts(t, a, b))} for t, own in zip(texts, found)], good


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_are_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    kinds = [lambda: f"u{r.randrange(99)}@mail.com", lambda: hexes(40), lambda: f"K-{r.randrange(10**5, 10**6)}", lambda: f"SN{r.randrange(10**5, 10**7)}x"]
    texts = []
    for _ in range(400):
        words = [r.choice(["alpha", "beta", "key", "serial", "of", "The"]) for _ in range(r.randrange(2, 12))]
        k = r.randrange(5)
        if k < 4:
            mark = [["write to "], ['token = "', "key: "], ['token = "', "serial no ", "id #"], ["serial no ", "id #", "key "]][k]
            words.insert(r.randrange(len(words)), r.choice(mark) + kinds[k]() + r.choice(['"', "", " now"]))
        texts.append(" ".join(words))
    want, good = plain_bootstrap(texts)
    out = {x.doc_id: x.spans for x in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), ["doc_id"]).collect()}
    got = [{tuple(map(int, s.split(":")[1:])) for s in out[k].split(",") if s.startswith("id:")} for k in range(len(texts))]
    assert got == want and sum(map(len, want)) > 20 and any(p[0] in "GT" for p in good)


def test_redaction_moves_each_text_once(spark, monkeypatch):
    monkeypatch.setattr(pii, "SLICE", 2)
    rows = [(k, f"write to a{k}@b.org") for k in range(7)] + [(7, None), (8, ""), (8, "nothing")]
    df = spark.createDataFrame([(x, k, "de") for k, x in rows], "text string, doc_id long, key string").coalesce(1)
    got = pii.redact(df)
    assert got.columns == df.columns
    want = sorted((k, x and ("write to [EMAIL]" if "@" in x else x), "de") for k, x in rows if x is not None) + [(7, None, "de")]
    assert sorted(((r.doc_id, r.text, r["key"]) for r in got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    there = next(line for line in plan.split("\n") if "MapInArrow" in line)
    assert there.count("text#") == 2 and "_row" not in there  # once to the tasks and once back: no second copy within a row
