"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mix, text_bytes

ORDERS = (1, 2, 3)
#: Texts are hashed in pieces of so many characters, which bounds memory.
PIECE = 1 << 18


@dataclass
class LanguageModel:
    """log-probabilities (bucket x language), log-priors, language names, bits."""

    matrix: np.ndarray
    priors: np.ndarray
    names: list[str]
    bits: int


def gram_buckets(text: str, bits: int) -> np.ndarray:
    """Buckets of all character 1- to 3-grams of the lower-cased text.

    Every run of other characters than letters counts as one space, so that
    digits, marks and layout say nothing about the language.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((codes >= 97) & (codes <= 122)) | (codes >= 0xAA)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    codes = np.concatenate([[np.uint64(32)], codes, [np.uint64(32)]])
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(codes) < n:
                continue
            key = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                key = (key << np.uint64(20)) + codes[k : k + len(key)]
            if n == 1:
                key = key[codes != 32]
            out.append(mix(key) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def pieces(text: str):
    for at in range(0, len(text), PIECE):
        yield text[at : at + PIECE]


def has_letter(text: str) -> bool:
    """Whether any character is a letter in Unicode's sense."""
    return any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text[200:]))


def train(docs: DataFrame, bits: int = 15, smoothing: float = 0.5, max_languages: int = 1000) -> LanguageModel:
    """Fits the model on every row with text and a non-null lang.

    Tasks count n-grams in arrays of fixed size; Spark adds them up by (lang,
    bucket), so that no language's rows meet in one task. The driver gets
    languages x 2**bits numbers; more than max_languages languages raise
    ValueError. No usable row gives a model without languages.
    """

    def count(batches):
        import pyarrow as pa

        counts: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            for raw, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = raw.as_py().decode("utf-8", "replace")
                sums = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                docs_of[lang] = docs_of.get(lang, 0) + 1
                for piece in pieces(text):
                    sums += np.bincount(gram_buckets(piece, bits), minlength=1 << bits)
        for lang, sums in counts.items():
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * (len(used) + 1), pa.string()), "bucket": pa.array(np.append(used, -1), pa.int32()), "n": pa.array(np.append(sums[used], docs_of[lang]), pa.int64())})

    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(text_bytes().alias("text"), "lang")
    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.limit(max_languages * ((1 << bits) + 1) + 1).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    at = {x: i for i, x in enumerate(names)}
    counts, priors = np.zeros((1 << bits, len(names))), np.zeros(len(names))
    for lang, bucket, n in zip(*(c.to_pylist() for c in got.columns), strict=True):
        if bucket < 0:
            priors[at[lang]] = n
        else:
            counts[bucket, at[lang]] = n
    matrix = np.log(counts + smoothing) - np.log(counts.sum(0) + smoothing * (1 << bits))
    return LanguageModel(matrix.astype(np.float32), np.log(priors / max(priors.sum(), 1)).astype(np.float32), names, bits)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns `keep` with lang_pred and score, the posterior probability; these
    have a "_" before their names where keep has those.

    The log-probability matrix is broadcast: its size is languages x 2**bits
    floats, which train() bounds. Null texts and texts without a letter are
    `und` with score 0; so is everything if the model knows no language.
    Ties go to the language that sorts first.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.matrix, model.priors, model.names, model.bits))

    def score(batches):
        import pyarrow as pa

        matrix, priors, names, bits = shared.value
        for batch in batches:
            langs, scores = [], []
            for raw in batch.column(batch.num_columns - 1):
                text = raw.as_py().decode("utf-8", "replace")
                if not names or not has_letter(text):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = priors.astype(np.float64)
                for piece in pieces(text):
                    total = total + matrix[gram_buckets(piece, bits)].sum(0, dtype=np.float64)
                odds = np.exp(total - total.max())
                best = int(odds.argmax())
                langs.append(names[best])
                scores.append(float(odds[best] / odds.sum()))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    kept = docs.select(*keep)
    lang, odds, utf8 = fresh(kept, "lang_pred", "score", "text_utf8")
    schema = kept.schema.add(lang, "string").add(odds, "double")
    return docs.select(*keep, text_bytes().alias(utf8)).mapInArrow(score, schema)
