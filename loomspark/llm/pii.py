"""Personal data: fixed forms as seeds, and identifiers found by bootstrapped contexts.

The forms (e-mail, IP, card, phone) and key-shaped strings are seed entities.
What stands next to them is a lexical pattern: the word before, the word after, the word
before with the marks between (`token = "`), the two words before. Spark scores the graph of patterns and instances in
rounds: a pattern is worth the share of its occurrences in the corpus that
stand next to trusted instances, where those next to unknown identifiers count less; an unseen identifier is worth the evidence
of its patterns, and counts as an instance in the next round. Identifiers
beside a pattern of high confidence are spans of kind `id`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, MARKS, fresh, grouped, mix, powers, stored, text_key

KINDS = ("email", "ip", "card", "phone", "id")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is tried once, from its start: a later start can't match either, as the run goes on alike.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.@%+-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+(?![@])")
#: Key-shaped: 32 or more hexadecimal digits. Such strings are seeds too, but no spans unless a pattern is trusted.
_KEY = re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})")
_DIGIT = re.compile(r"[0-9]")
_BITS, REACH = 24, 80
#: So many rows at once are redacted and given back.
SLICE = 500


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches, in linear time: each "@" is extended to both sides.

    The characters before an "@" can't hold another "@", so a match begins
    at the first of them that no earlier match has taken.
    """
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and at >= done and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms, sorted; failing matches are dropped, with no retry."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _low(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower()


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _mentions(text: str, spans):
    """(start, end, is base form, is seed, instance, pattern) of seeds and unknown identifiers."""
    unknown = []
    for m in _TOKEN.finditer(text):
        token = m[0].strip("-_")
        if len(token) >= 6 and sum("0" <= c <= "9" for c in token) >= 4:
            a = m.start() + m[0].index(token)
            unknown.append((a, a + len(token)))
    if unknown and spans:
        starts = np.array([s[0] for s in spans])
        ends = np.maximum.accumulate([s[2] for s in spans])
        unknown = [(a, b) for a, b in unknown if not ((k := int(np.searchsorted(starts, b))) and ends[k - 1] > a)]
    for is_base, found in ((True, [(a, b) for a, _, b in spans]), (False, unknown)):
        for a, b in found:
            token = text[a:b]
            instance, is_seed = _hash(token), is_base or bool(_KEY.fullmatch(token))
            for pattern in _around(text, a, b):
                yield a, b, is_base, is_seed, instance, pattern


def _around(text: str, a: int, b: int) -> list[int]:
    """Patterns of the characters a to b, from up to REACH characters to each side; a word cut there says nothing."""
    while b > a and not text[a].isalnum():  # what stands between is up to the first letter or digit
        a += 1
    low = max(0, a - REACH)
    codes, hashes, glue, starts = _words([_low(text[low:a]) + b"x"])[:4]
    whole = [k for k in range(len(hashes) - 1) if starts[k] > 0 or not low]
    out = []
    if len(hashes) > 1 and len(hashes) - 2 in whole:
        out += [_LEFT(hashes[-2]), _GLUED(hashes[-2], glue[-2])]
        if len(hashes) > 2 and len(hashes) - 3 in whole:
            out.append(_TWO(hashes[-3], hashes[-2]))
    hashes = _words([_low(text[b : b + REACH])])[1]
    if len(hashes) and (len(hashes) > 1 or b + REACH >= len(text) or not text[b + REACH - 1].isalnum()):
        out.append(_RIGHT(hashes[0]))
    return [int(np.uint64(x).view(np.int64)) for x in out]


def _words(texts: list[bytes]):
    """Bytes, hashes of words, of what stands between each and the next, where words begin, and where texts' words do."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    apart = MARKS[data]
    edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    if not apart[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    after = np.append(starts[1:], len(data)) if len(starts) else starts
    glue = mix((sums[after] - sums[ends]) * down[ends])
    return data, hashes, glue, starts, np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))


# patterns: the word before, the word after, the word before with the marks between, the two words before
def _LEFT(word):
    return mix(word + np.uint64(1))


def _RIGHT(word):
    return mix(word + np.uint64(2))


def _GLUED(word, glue):
    return mix(mix(word + np.uint64(3)) + glue)


def _TWO(first, word):
    return mix(mix(first + np.uint64(4)) + word)


MENTION = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("seed", T.BooleanType()), T.StructField("instance", T.LongType()), T.StructField("pattern", T.LongType())]))


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and mentions of every row of docs(kept, text); kept is a struct."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select("kept", F.coalesce("text", F.lit("")).alias("text"))
    added = [T.StructField("base", T.StringType()), T.StructField("n_base", T.ArrayType(T.LongType())), T.StructField("mentions", MENTION)]
    schema = T.StructType([T.StructField("kept", rows.schema["kept"].dataType, True), *added])

    def work(batches):
        import pyarrow as pa

        kinds = [to_arrow_type(f.dataType) for f in added]
        for batch in batches:
            base, counts, found = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                spans = base_spans(text)
                base.append(joined(spans))
                counts.append([sum(k == kind for _, k, _ in spans) for kind in range(4)])
                found.append([dict(zip(("a", "b", "base", "seed", "instance", "pattern"), m, strict=True)) for m in _mentions(text, spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kinds[0]), pa.array(counts, kinds[1]), pa.array(found, kinds[2])], names=schema.names)

    return rows.mapInArrow(work, schema)


def pattern_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each of patterns (pattern: 64-bit hashes, distinct) occurs in the texts.

    The tasks get a bitmap of fixed size, in which patterns meet by their top _BITS
    bits: it only spares the shuffle most others; the join by the whole hash decides.
    """
    cell = F.shiftrightunsigned("pattern", 64 - _BITS)
    bits = patterns.groupBy(F.shiftright(cell, 15).alias("at")).agg(F.bitmap_construct_agg(cell.bitwiseAND(32767)).alias("bits"))
    table = np.zeros((1 << (_BITS - 15), 4096), np.uint8)
    for row in bits.collect():
        table[row["at"]] = np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table.reshape(-1))

    def work(batches):
        import pyarrow as pa

        table, held, size = shared.value, [], 0

        def merged():
            key, place = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, place, np.concatenate([n for _, n in held]))
            return key, n

        def out():
            key, n = held.pop()
            for at in range(0, len(key), 20_000):
                yield pa.RecordBatch.from_pydict({"pattern": pa.array(key[at : at + 20_000].view(np.int64)), "n": pa.array(n[at : at + 20_000])})

        for batch in batches:
            for _, texts in grouped(batch.column(0), 1 << 20):
                _, words, glue, _, first = _words([_low(t) for t in texts])
                inner = np.ones(len(words), bool)  # words with another one of their text after them
                inner[first[1:][first[1:] > 0] - 1] = False
                before = np.flatnonzero(inner)
                keys = np.concatenate([_LEFT(words), _RIGHT(words), _GLUED(words[before], glue[before]), _TWO(words[before], words[before + 1])])
                top = (keys >> np.uint64(64 - _BITS)).astype(np.int64)
                keys = keys[(table[top >> 3] >> (top & 7).astype(np.uint8) & 1).astype(bool)]
                held.append((keys, np.ones(len(keys), np.int64)))
                size += len(keys)
                if size > 1 << 20:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > 1 << 19:
                        yield from out()
                        size = 0
        if held:
            held[:] = [merged()]
            yield from out()

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, "pattern long, n long")
    return rows.groupBy("pattern").agg(F.sum("n").alias("total")).join(patterns, "pattern", "left_semi")


def trusted_patterns(docs: DataFrame, found: DataFrame, confidence: float = 0.8, support: int = 5, unseen: float = 0.25, rounds: int | None = None) -> DataFrame:
    """Patterns of high confidence: (pattern), from docs and scan()'s stored rows of them.

    Edges (pattern, instance) carry counts; seeds have weight 1. In each round
    a pattern's confidence is the weighted count of its instances over all
    its occurrences in the texts, of which those beside identifiers that are not known yet count
    `unseen` each only: they are no evidence against it, as other words are, but much of them is. It needs `support` different instances. An
    unknown instance gets 1 minus the product of (1 - confidence) over its patterns.
    Weights only grow, and so does the set of patterns; rounds end with the first that adds none
    (or after `rounds`, where given). Occurrences are counted for patterns with at least `support`
    instances of any weight; the others can't come to be trusted.
    """
    edges = found.select(F.explode("mentions").alias("m")).select("m.*")
    edges = stored(edges.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    often = stored(edges.groupBy("pattern").agg(F.count("*").alias("k")).filter(F.col("k") >= support).select("pattern"), "often")
    totals = stored(pattern_totals(docs, often), "totals")
    weights, good, size, k = None, None, 0, 0
    while rounds is None or k < rounds:
        rows = edges.withColumn("w", F.col("seed").cast("double"))
        if weights is not None:
            rows = edges.join(weights, "instance", "left").withColumn("w", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0))))
        scored = rows.groupBy("pattern").agg(F.sum(F.col("n") * F.col("w")).alias("hits"), F.sum("n").alias("all"), F.count_if(F.col("w") >= confidence).alias("support"))
        scored = scored.filter(F.col("support") >= support).join(totals, "pattern", "left")
        scored = scored.withColumn("p", F.col("hits") / (F.greatest("all", F.coalesce("total", F.lit(0))) - (1 - unseen) * (F.col("all") - F.col("hits"))))
        good = stored(scored.filter(F.col("p") >= confidence).select("pattern", "p"), "patterns")
        before, size, k = size, good.count(), k + 1
        if size == before:
            break
        linked = edges.filter("not seed").join(good, "pattern")
        weights = linked.groupBy("instance").agg((1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("found"))
    return good.select("pattern")


def find(docs: DataFrame, keep: list[str], **options) -> DataFrame:
    """Columns `keep` plus base (spans of the fixed forms), n_base (their counts by kind) and spans (all).

    Null texts are empty and have no spans. Every row is read whole; equal
    texts get equal spans; an empty table gives no rows. Spans are
    kind:start:end in code points, end exclusive, sorted by start, then kind. An
    unknown identifier is a run of letters, digits, "-" and "_" of at least 6 characters,
    4 of them digits, outside the fixed forms. The three columns have a "_"
    before their names where keep has those.
    """
    names = fresh(docs.select(*keep), "base", "n_base", "spans")
    source = docs.select(F.struct(*keep).alias("kept"), "text")
    rows = stored(scan(source).withColumn("rid", F.monotonically_increasing_id()), "mentions")
    good = trusted_patterns(docs, rows, **options)
    new = rows.select("rid", F.explode("mentions").alias("m")).filter("not m.base").select("rid", F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.col("m.pattern").alias("pattern"))
    new = new.join(good, "pattern", "left_semi").groupBy("rid").agg(F.collect_set(F.concat_ws(":", F.lit("id"), "a", "b")).alias("new"))
    rows = rows.join(new, "rid", "left")
    parts = F.concat(F.filter(F.split("base", ","), lambda x: x != ""), F.coalesce("new", F.array().cast("array<string>")))
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(2)).cast("long").alias("s"), F.array_position(order, F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), x.alias("x")))
    spans = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["x"]), ",")
    return rows.select("kept.*", F.col("base").alias(names[0]), F.col("n_base").alias(names[1]), spans.alias(names[2]))


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with every span replaced by its kind in brackets, e.g. [EMAIL]; n_chars, if there, is counted anew.

    Overlapping spans count as one, named by the first. A null text stays null.
    All other columns are kept, whatever their names; an empty table gives no rows.

    Mentions travel under a 16-byte key of the text. Rows stay where they are read: they meet the
    identifiers found in their texts, which are few, in one join, and the fixed forms are sought again there.
    """
    names = docs.columns
    rows = stored(scan(docs.select(F.struct(text_key().alias("key")).alias("kept"), "text")).select("kept.key", "mentions"), "mentions")
    good = trusted_patterns(docs, rows, **options)
    own = rows.select("key", F.explode("mentions").alias("m")).filter("not m.base").select("key", F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.col("m.pattern").alias("pattern"))
    new = stored(own.join(good, "pattern", "left_semi").groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("new")), "identifiers")
    key, spans = fresh(docs, "key", "new")
    both = docs.withColumn(key, text_key()).join(new.select(F.col("key").alias(key), F.col("new").alias(spans)), key, "left").select(*names, spans)
    at = names.index("text")

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                out = []
                for value, more in zip(part.column(at), part.column(len(names)).to_pylist(), strict=True):
                    text = value.as_py()
                    out.append(text and _replaced(text, sorted([*base_spans(text), *((m["a"], len(KINDS) - 1, m["b"]) for m in more or [])])))
                columns = part.columns[:-1]
                columns[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    done = both.mapInArrow(work, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
    counted = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")).alias("n_chars") if "n_chars" in names else None
    return done.select(*[counted if c == "n_chars" else F.col(c) for c in names])


def _replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            parts += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join([*parts, text[done:]])


def discovery(docs: DataFrame, by: int = 5, **options) -> DataFrame:
    """n_withheld, n_found, n_others, one row: how well contexts find identifiers that no seed tells.

    Of the key-shaped seeds those whose instance hash modulo `by` is 0 are withheld: they are
    unknown identifiers like any other. n_found of these n_withheld different ones are beside a trusted pattern;
    n_others different unknown identifiers that are not key-shaped are, too. An empty table gives 0, 0, 0.
    """
    rows = scan(docs.select(F.struct(F.lit(0).alias("none")).alias("kept"), "text")).select("mentions")
    out = lambda m: ~m["base"] & m["seed"] & (F.pmod(m["instance"], F.lit(by)) == 0)
    told = F.transform("mentions", lambda m: m.withField("withheld", out(m)).withField("key", ~m["base"] & m["seed"]).withField("seed", m["seed"] & ~out(m)))
    rows = stored(rows.select(told.alias("mentions")), "mentions")
    good = trusted_patterns(docs, rows, **options).withColumn("good", F.lit(True))
    each = rows.select(F.explode("mentions").alias("m")).filter("not m.base").select("m.*").join(good, "pattern", "left")
    each = each.groupBy("instance").agg(F.max("withheld").alias("withheld"), F.max("key").alias("key"), F.coalesce(F.max("good"), F.lit(False)).alias("found"))
    return each.agg(F.count_if("withheld").alias("n_withheld"), F.count_if(F.expr("withheld and found")).alias("n_found"), F.count_if(F.expr("found and not key")).alias("n_others"))


def digest(joined_spans):
    """sha256 of a span list, as a column."""
    return F.sha2(joined_spans.cast("binary"), 256)


def python_digest(text: str) -> str:
    return hashlib.sha256(joined(base_spans(text)).encode()).hexdigest()
