"""Import records: address answers, code checks, payloads, events, venues, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import dates, texts

from .grouping import first_per

# Type codes by activity; code of the usual ownership; allowed fields of an event record.
BASE_TYPE, RESIDENTIAL_TYPE, PROVIDER_TYPE, USUAL_OWNERSHIP = "142", "141", "143", "162"
EVENT_FIELDS = [
    "source_reference", "organizer_id", "title", "description", "attendance_mode", "online_url", "event_page_url",
    "rrule_string", "start_datetime", "end_datetime", "ai_metadata", "classification", "venues",
]


def filled(c: Column) -> Column:
    """A trimmed text; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def geocoded(answer: Column) -> Column:
    """A registry's address answer as struct(fias_id, fias_level, city_fias_id, kladr_id, region_iso, region_code, geo_lat, geo_lon).

    The place is the settlement, else the city, else the region (levels 6, 4, 1); where no city is told it is
    its own. The postal id is the most specific one. A region code stands in only where the ISO code is
    missing. Coordinates that are no numbers are null.
    """
    of = lambda name: filled(answer[name])
    settlement, city, region = (of(f"{k}_fias_id") for k in ("settlement", "city", "region"))
    place = F.coalesce(settlement, city, region)
    level = F.when(settlement.isNotNull(), "6").when(city.isNotNull(), "4").when(region.isNotNull(), "1")
    postal = F.coalesce(*[of(f"{k}kladr_id") for k in ("house_", "street_", "settlement_", "city_", "region_", "")])
    iso = of("region_iso_code")
    return F.struct(
        place.alias("fias_id"), level.alias("fias_level"), F.coalesce(city, place).alias("city_fias_id"), postal.alias("kladr_id"), iso.alias("region_iso"),
        F.when(iso.isNull(), region).alias("region_code"), answer["geo_lat"].try_cast("double").alias("geo_lat"), answer["geo_lon"].try_cast("double").alias("geo_lon"),
    )


def verified_venues(venues: Column) -> Column:
    """Venues that the address registry knows."""
    return F.filter(venues, lambda v: filled(v["fias_id"]).isNotNull())


def type_codes(activity: Column, provider: Column) -> Column:
    """Type codes that an activity code and a provider's status tell."""
    group = texts.code_group(activity)
    care = F.when(group == "87", RESIDENTIAL_TYPE).when((group == "88") & provider, PROVIDER_TYPE)
    return F.array_compact(F.array(F.lit(BASE_TYPE), care))


def checked_codes(types: Column, ownership: Column, known_types: list[str], known_ownership: list[str]) -> Column:
    """struct(types, ownership, issues): codes that stand in each other's place are moved.

    Unknown type codes go. A type code that is an ownership code fills the ownership if that is blank, and goes
    otherwise. An ownership code that is a type code joins the types; an unknown one stays, as an issue.
    """
    kept = F.filter(types, lambda c: c.isin(known_types))
    stray = F.filter(types, lambda c: ~c.isin(known_types) & c.isin(known_ownership))
    unknown = F.filter(types, lambda c: ~c.isin(known_types) & ~c.isin(known_ownership))
    own = F.coalesce(F.nullif(ownership, F.lit("")), F.get(stray, 0))
    swapped = F.coalesce(~own.isin(known_ownership) & own.isin(known_types), F.lit(False))
    strange = F.filter(F.array_compact(F.array(own)), lambda c: ~c.isin(known_ownership) & ~c.isin(known_types))
    issues = F.concat(F.transform(unknown, lambda c: F.concat(F.lit("type:"), c)), F.transform(strange, lambda c: F.concat(F.lit("ownership:"), c)))
    return F.struct(F.when(swapped, F.array_append(kept, own)).otherwise(kept).alias("types"), F.when(~swapped, own).alias("ownership"), issues.alias("issues"))


def unknown_codes(codes: Column, known: list[str]) -> Column:
    """Codes of the lists that are only flagged."""
    return F.filter(codes, lambda c: ~c.isin(known))


def with_geo(venues: Column, geos: Column) -> Column:
    """Venue structs with the geo struct of the same place in a parallel list; a shorter list leaves nulls, a longer one is cut."""
    return F.transform(venues, lambda v, i: F.struct(v.alias("venue"), F.get(geos, i).alias("geo")))


def event_records(rows: DataFrame) -> DataFrame:
    """The fields of an event record that rows have, in the record's order; others go."""
    return rows.select(*[c for c in EVENT_FIELDS if c in rows.columns])


def raw_events(notes: DataFrame, listed: DataFrame) -> DataFrame:
    """Two kinds of raw events in one form.

    notes (url, title, content, found_on) are sections of organisations' pages; listed (source_reference, title,
    description, date_text, location, category, is_online, registration_url, page_url) come from a platform.
    """
    own = notes.select(
        texts.stable_reference(F.col("url"), F.col("title")).alias("source_reference"), "title", F.concat(F.lit("# "), "title", F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("raw_text"),
        F.col("url").alias("source_url"), F.lit("org_website").alias("source_kind"), F.col("found_on").alias("discovered_from"),
    )
    # Labels of the lines of a listed event's text.
    lines = [("Название: ", "title", "\n\n"), ("Описание: ", "description", "\n\n"), ("Дата и время: ", "date_text", "\n"), ("Место: ", "location", "\n"), ("Категория на сайте: ", "category", "")]
    text = F.concat(*[p for label, c, end in lines for p in (F.lit(label), F.coalesce(F.col(c), F.lit("")), F.lit(end))])
    other = listed.select(
        "source_reference", "title", F.substring(text, 1, 8000).alias("raw_text"), F.coalesce("page_url", F.lit("")).alias("source_url"), F.lit("platform").alias("source_kind"),
        F.lit("platform").alias("discovered_from"), "date_text", "location", "is_online", "registration_url", "category",
    )
    return own.unionByName(other, allowMissingColumns=True)


def ingested_events(raw: DataFrame, classified: DataFrame, as_of: Column) -> DataFrame:
    """Event records from raw events and their classifications (one a reference).

    classified: source_reference, decision, score, works_with_elderly, attendance_mode, online_url, starts, ends.
    Rejected events go. Events without a classification ask for a review at 0.5. Dates come from the
    event's own text, else from the classification. What the source says of itself wins: online, link, title.
    """
    c = classified.select("source_reference", *[F.col(k).alias(f"c_{k}") for k in classified.columns if k != "source_reference"], F.lit(True).alias("_known"))
    rows = raw.join(c, "source_reference", "left").filter("c_decision is null or c_decision <> 'rejected'")
    told = dates.date_text_range(F.coalesce("date_text", F.lit("")), as_of)
    online = F.coalesce(F.col("is_online"), F.lit(False))
    trace = F.array(F.struct(F.col("source_kind"), F.col("source_url"), F.array(F.lit("title"), F.lit("raw_text")).alias("fields_extracted")))
    return rows.select(
        "source_reference", "title", F.substring("raw_text", 1, 2000).alias("description"),
        F.when(online, "online").otherwise(F.coalesce("c_attendance_mode", F.lit("offline"))).alias("attendance_mode"),
        F.coalesce("registration_url", "c_online_url").alias("online_url"), filled(F.col("source_url")).alias("event_page_url"),
        F.coalesce(told["start"], F.col("c_starts")).alias("start_datetime"), F.coalesce(told["end"], F.col("c_ends")).alias("end_datetime"),
        F.struct(
            F.coalesce("c_decision", F.lit("needs_review")).alias("decision"), F.when(F.col("_known").isNull(), 0.5).otherwise(F.col("c_score")).alias("ai_confidence_score"),
            F.when(F.col("_known").isNull(), True).otherwise(F.col("c_works_with_elderly")).alias("works_with_elderly"), trace.alias("ai_source_trace"),
        ).alias("ai_metadata"),
    )


def minimal_records(orgs: DataFrame, parties: DataFrame, kind: str, source_url: str, score: float = 0.45) -> DataFrame:
    """Records of registry organisations that were matched with none.

    orgs: inn, ogrn, full_name, address, okved, statuses (array), provider; parties (one an inn): inn, name, address
    and geo (see geocoded). The directory's name and address come before the registry's.
    """
    p = parties.select("inn", F.col("name").alias("p_name"), F.col("address").alias("p_address"), F.col("geo").alias("p_geo"))
    rows = orgs.join(p, "inn", "left")
    address = F.coalesce(filled(F.col("p_address")), filled(F.col("address")))
    about = F.concat_ws(" ", F.concat(F.lit("ОКВЭД: "), "okved", F.lit(".")), F.concat(F.lit("Статус: "), F.array_join("statuses", ", "), F.lit(".")))
    venue = F.struct(address.alias("address_raw"), F.when(F.col("p_geo.fias_id").isNotNull(), F.col("p_geo")).alias("geo"), F.col("p_geo.fias_id").isNotNull().alias("is_headquarters"))
    return rows.select(
        F.concat(F.lit(f"{kind}_"), "inn").alias("source_reference"), "inn", "ogrn", F.coalesce(filled(F.col("p_name")), F.col("full_name")).alias("title"), about.alias("description"),
        F.lit("needs_review").alias("decision"), F.lit(score).alias("ai_confidence_score"), type_codes(F.col("okved"), F.col("provider")).alias("organization_type_codes"),
        F.lit(USUAL_OWNERSHIP).alias("ownership_type_code"), F.filter(F.array(venue), lambda v: v["address_raw"].isNotNull()).alias("venues"),
        F.array(F.struct(F.lit(kind).alias("source_kind"), F.lit(source_url).alias("source_url"))).alias("ai_source_trace"),
    )


def source_defaults(rows: DataFrame) -> DataFrame:
    """New source rows (base_url, kind, name, crawl_period_days, priority) with what is missing filled in."""
    bare = F.regexp_replace(F.regexp_replace("base_url", "/+$", ""), "^https?://", "")
    made = {
        "name": F.coalesce("name", bare), "crawl_period_days": F.coalesce("crawl_period_days", F.when(F.col("kind") == "org_website", 30).otherwise(7)),
        "priority": F.coalesce("priority", F.lit(50)), "last_status": F.lit("pending"), "is_active": F.lit(True),
    }
    return rows.withColumns(made)


def resolved_venues(new: DataFrame, known: DataFrame, geo: list[str]) -> DataFrame:
    """new venues with the id of the known venue, by registry id if they have one, else by address; null: to be made.

    Of known venues with one key the least id counts. Geo columns that new has overwrite the known ones.
    """
    key = lambda f, a: F.coalesce(F.concat(F.lit("f:"), filled(f)), F.concat(F.lit("a:"), a))
    by_id = known.filter(filled(F.col("fias_id")).isNotNull()).select(F.concat(F.lit("f:"), filled(F.col("fias_id"))).alias("_key"), "id", *[F.col(c).alias(f"_{c}") for c in geo])
    by_address = known.filter("address_raw is not null").select(F.concat(F.lit("a:"), "address_raw").alias("_key"), "id", *[F.col(c).alias(f"_{c}") for c in geo])
    one = by_id.union(by_address).groupBy("_key").agg(F.min_by(F.struct("*"), "id").alias("_v")).select("_key", F.col("_v.id").alias("venue_id"), *[F.col(f"_v._{c}") for c in geo])
    out = new.withColumn("_key", key(F.col("fias_id"), F.col("address_raw"))).join(one, "_key", "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in geo}).drop("_key", *[f"_{c}" for c in geo])


def with_context(orgs: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """orgs (description, trace) with the sentence and the trace entry of notes (key, sentence, entry) added; one note a key."""
    out = orgs.join(notes, key, "left")
    more = F.btrim(F.concat(F.coalesce("description", F.lit("")), F.lit("\n\n"), "sentence"), F.lit(" \n\t\r"))
    trace = F.coalesce("trace", F.array().cast("array<string>"))
    return out.withColumns({"description": F.coalesce(more, "description"), "trace": F.when(F.col("entry").isNotNull(), F.array_append(trace, F.col("entry"))).otherwise(trace)}).drop("sentence", "entry")


def in_facets(rows: DataFrame, id_col: str, facets: list[tuple[DataFrame, str, list]]) -> DataFrame:
    """rows that have in each facet (links, column, ids) any of its ids; an empty list of ids asks for nothing."""
    for links, column, ids in facets:
        if ids:
            rows = rows.join(links.filter(F.col(column).isin(ids)).select(id_col), id_col, "left_semi")
    return rows


def at_most(notes: DataFrame, page: str, site: str, order: str, per_page: int, pages: int) -> DataFrame:
    """Notes in order, at most per_page of a page and those of the first `pages` pages of a site that have any."""
    few = first_per(notes, [page], [order], per_page).drop("_rank")
    chosen = first_per(few.select(site, page).distinct(), [site], [page], pages).select(page)
    return few.join(chosen, page, "left_semi")
