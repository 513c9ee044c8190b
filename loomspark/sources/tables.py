"""Reading and writing: registry sheets, work lists, logs, answers, exports. All schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NCO_COLUMNS = ["inn", "full_name", "short_name", "address", "ogrn", "legal_form", "okved", "sonko_status", "nco_status", "inclusion_criterion", "authority_name", "decision_date", "inclusion_date"]
GRANT_COLUMNS = [
    "application_number", "contest", "organization_name", "ogrn", "inn", "region", "project_title", "grant_direction", "budget_requested",
    "budget_total", "start_date", "end_date", "status", "grant_decision_date", "grant_amount", "evaluation", "violations",
]
OPTIONAL = {"short_name", "legal_form", "sonko_status", "nco_status", "inclusion_criterion", "authority_name", "decision_date", "inclusion_date", "evaluation", "violations"}


def _sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A sheet exported as CSV, as text columns in file order; the header must name as many columns."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, mode="PERMISSIVE", enforceSchema=True)
    return rows.withColumn("row_no", F.monotonically_increasing_id())


def _text(name: str) -> Column:
    clean = F.trim(F.col(name))
    return F.nullif(clean, F.lit("")).alias(name) if name in OPTIONAL else F.coalesce(clean, F.lit("")).alias(name)


def read_nco_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry of non-profits: trimmed texts; rows whose tax id is under five characters, blank ones among them, are dropped."""
    rows = _sheet(spark, path, NCO_COLUMNS).select("row_no", *[_text(c) for c in NCO_COLUMNS])
    return rows.filter(F.length("inn") >= 5)


def read_grants(spark: SparkSession, path: str) -> DataFrame:
    """Registry of grant projects: money that is no number and dates that are none become null; short rows are padded with null."""
    rows = _sheet(spark, path, GRANT_COLUMNS)
    money, dates = {"budget_requested", "budget_total", "grant_amount"}, {"start_date", "end_date", "grant_decision_date"}

    def typed(c: str) -> Column:
        if c in money:
            return F.col(c).try_cast("double").alias(c)
        return F.substring(F.trim(F.col(c)), 1, 10).try_cast("date").alias(c) if c in dates else _text(c)

    return rows.select("row_no", *[typed(c) for c in GRANT_COLUMNS]).filter((F.col("application_number") != "") | (F.col("organization_name") != ""))


ALIASES = {"url": "base_url", "title": "org_title", "city": "city_address"}


def read_work_list(spark: SparkSession, path: str, required: list[str], fields: list[str] = ("id", "url", "title", "city", "region", "kind")) -> DataFrame:
    """A JSON object or array of work items under their own or older field names; `missing` lists required fields that are empty."""
    names = [*fields, *[a for f, a in ALIASES.items() if f in fields]]
    rows = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).json(path, multiLine=True)
    rows = rows.select(*[F.coalesce(F.col(f), F.col(ALIASES[f])).alias(f) if f in ALIASES else F.col(f) for f in fields])
    return rows.withColumn("missing", F.array_compact(F.array(*[F.when(F.coalesce(F.col(r), F.lit("")) == "", F.lit(r)) for r in required])))


RUN_LOG = T.StructType([T.StructField("org_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("tier", T.StringType()), T.StructField("verified_url", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("error", T.StringType())])


def append_run_log(rows: DataFrame, path: str) -> None:
    rows.select(*RUN_LOG.names).write.mode("append").json(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """The log without blank or broken lines and lines without an id."""
    schema = T.StructType([*RUN_LOG.fields, T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    return rows.filter("_broken is null and org_id is not null and org_id <> ''").drop("_broken")


HITS = "response struct<error:struct<_code:int>,results:struct<grouping:struct<group:array<struct<doc:array<struct<url:string,title:string,passages:struct<passage:array<string>>>>>>>>>"


def search_hits(rows: DataFrame, xml: str, *keep: str) -> DataFrame:
    """Hits of stored search answers: url, title, snippet and place over all groups; code 15 means none, other codes set `failed`."""
    plain = F.regexp_replace(F.col(xml), r"</?hlword[^>]*>", "")
    x = rows.select(*keep, F.from_xml(plain, HITS).alias("x"))
    docs = F.flatten(F.transform(F.col("x.response.results.grouping.group"), lambda g: g["doc"]))
    code = F.col("x.response.error._code")
    x = x.select(*keep, (code.isNotNull() & (code != 15)).alias("failed"), F.posexplode_outer(docs).alias("p", "d"))
    return x.select(*keep, F.coalesce("failed", F.lit(False)).alias("failed"), (F.col("p") + 1).alias("position"), F.trim("d.url").alias("url"), F.trim("d.title").alias("title"), F.array_join("d.passages.passage", " ").alias("snippet"))


def parsed_answer(answer: Column, schema: str) -> Column:
    """A stored model answer as a struct: without fences, else its outermost braces; null where neither is JSON."""
    from loomspark.functions.texts import unfenced

    bare = unfenced(F.coalesce(answer, F.lit("")))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.startswith("{"), F.from_json(c, schema))
    return F.coalesce(ok(bare), ok(inner))


def answer_decision(answer: Column) -> Column:
    """The decision of an answer that is no JSON: a word for it in the text, else rejected."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(low.contains("accepted") & ~low.contains("rejected"), "accepted").otherwise("rejected")


def write_tiers(rows: DataFrame, path: str, by: str = "tier") -> None:
    """One JSON dataset per tier (or decision)."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Active entries of a dictionary: id, code, name, parent_id."""
    schema = "id long, code string, name string, parent_id long, is_active boolean"
    return spark.read.schema(schema).json(path).filter(F.coalesce("is_active", F.lit(True))).drop("is_active")


def with_parent_code(entries: DataFrame, excluded: list[str] = ("151",)) -> DataFrame:
    """Entries with their parent's code, for export; test codes stay out."""
    parents = entries.select(F.col("id").alias("_pid"), F.col("code").alias("parent_code"))
    return entries.filter(~F.col("code").isin(list(excluded))).join(parents, F.col("parent_id") == F.col("_pid"), "left").drop("_pid")


def mapped_answer(rows: DataFrame, body: str, data_path: list[str], mapping: dict[str, str], *keep: str) -> DataFrame:
    """Rows of an API answer: the array at data_path, its fields renamed by the mapping (target to source)."""
    fields = ", ".join(f"{s} string" for s in dict.fromkeys(mapping.values()))
    schema = f"array<struct<{fields.replace(' string', ':string')}>>"
    for name in reversed(data_path):
        schema = f"struct<{name}:{schema}>"
    parsed = rows.select(*keep, F.from_json(body, schema).alias("_b"))
    parsed = parsed.select(*keep, F.explode(F.col(".".join(["_b", *data_path]))).alias("_r"))
    return parsed.select(*keep, *[F.col(f"_r.{s}").alias(t) for t, s in mapping.items()])


def read_relational(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database table, read in ranges of a key by many tasks."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)
