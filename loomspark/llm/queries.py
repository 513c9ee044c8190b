"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontam, jaccard, katz, langid, media, mixing, pii, quality, sufdedup, warc, whitening
from .common import fold, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(fold() != 0))
    out = quality.score(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontam.find_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", "hit.score", "hit.word")


def jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def media_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(_table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.col("n_base")[k].alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


#: A conversation of nothing but control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in PROBE]
    probe = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return chat.digests(chat.format_chats(turns.union(probe)))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.schedule(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"))


def repeats_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sufdedup.remove_repeats(_table(spark, sf_dir, "documents"))


def language_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(fold() != 0))
    out = langid.predict(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"), ["vec_id"])
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    out = out.select("vec_id", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "identity_error", each)
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster(_table(spark, sf_dir, "embeddings"))
    sums = [F.expr(f"try_cast({c} as bigint)").alias(c) for c in ("distance", "cluster_inertia", "inertia")]
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return out.select("vec_id", "cluster", *sums, digest.alias("centroid_sha256"))


def page_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(warc.write(_table(spark, sf_dir, "pages")), "archives")
    found = warc.resolve(stored(warc.read(archives, payload=False), "records"))
    pages = found.filter(F.col("record_type").isin("response", "revisit"))
    return pages.select(warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to").alias("refers_to"))


QUERIES = {
    "op1_quality_mil": quality_scores,
    "op2_decontamination": benchmark_leaks,
    "op3_jaccard_join": jaccard_components,
    "op4_media_container": media_round_trip,
    "op5_personal_data": personal_data,
    "op6_chat_format": chat_format,
    "op7_source_mixing": source_mix,
    "op8_katz_lm": katz_scores,
    "op9_suffix_dedup": repeats_removed,
    "op10_language_id": language_ids,
    "op11_whitening": whitened_embeddings,
    "op12_lookup_clusters": embedding_clusters,
    "op13_warc": page_archives,
}


def _clusters_sql(dims: int = 64, k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Rounds of nearest centroids, one pair of steps after another."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x AS m
  FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))""",
    ]
    for r in range(rounds + 1):
        distance = f"(SELECT rid, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r})"
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, min(d) AS d, arg_min(c, d * {k} + c) AS c FROM {distance} GROUP BY rid)")
        if r < rounds:
            entries = f"(SELECT a.c, unnest(range(1, {dims + 1})) AS i, unnest(x) AS e FROM a{r} a JOIN v USING (rid))"
            moved = f"(SELECT c, list(f ORDER BY i) AS m FROM (SELECT c, i, CAST(floor(sum(e)::DOUBLE / count(*)) AS BIGINT) AS f FROM {entries} GROUP BY c, i) GROUP BY c)"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN {moved} n ON n.c = o.c)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} k ON k.c = a.c"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op3_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2
), l AS (SELECT a, b FROM p WHERE 100 * k >= 90 * (na + nb - k)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.c)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, (SELECT min(c) FROM r WHERE r.d = s.doc_id) AS component_id FROM s
""",
    "op6_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, row_number() OVER o AS i, CASE WHEN lag(role) OVER o IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS opens FROM t
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)
), x AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]|<</?SYS>>')) AS chars,
    length(role) + len(regexp_extract_all(role, '\\')) + len(regexp_extract_all(role, '<\||</?s>|\[/?INST\]|<</?SYS>>')) AS role_chars FROM m
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN opens = 1 THEN 9 + role_chars + 8 + 8 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
""",
    "op7_source_mixing": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS place FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
c AS (SELECT *, (2 * source_size)::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM k),
f AS (
  SELECT *, coalesce(sum(cap) OVER o, 0.0::DOUBLE) AS full_, sum(w) OVER () - coalesce(sum(w) OVER o, 0.0::DOUBLE) AS left_ FROM c
  WINDOW o AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (SELECT *, (budget - full_) / left_ AS lv FROM f),
g AS (SELECT *, max(CASE WHEN lv * w <= cap THEN lv END) OVER () AS level FROM v),
t AS (SELECT source, source_size, coalesce(least(cap, level * w), cap) AS target FROM g),
q AS (
  SELECT d.rid, d.doc_id, d.size, t.source_size, t.target, coalesce('=' || t.source, '') AS lane,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place % 4096, d.place, d.rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto_doc
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT rid, lane, size, CAST(upto_doc + k * source_size + size AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1)) p(k) WHERE size > 0
), z AS (SELECT rid, size, sum(size) OVER (ORDER BY finish, lane ROWS UNBOUNDED PRECEDING) AS upto FROM e),
b AS (SELECT floor(1.5 * sum(size) + 1e-6) AS budget FROM d),
x AS (SELECT rid, sum(greatest(0, least(size, budget - (upto - size)))) AS taken FROM z, b GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN x USING (rid)
""",
    "op12_lookup_clusters": _clusters_sql(),
    "op13_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to FROM f
""",
}
