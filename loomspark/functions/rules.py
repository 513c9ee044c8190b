"""Decisions: statuses, tiers, actions; and distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score for approval; scores of the tiers; mean radius of the earth in metres.
APPROVED_FROM, AUTO_FROM, REVIEW_FROM, EARTH = 0.85, 0.8, 0.5, 6371008.8


def import_status(decision: Column, score: Column, flag: Column) -> Column:
    """Status of an imported record: approved only if accepted, sure and flagged; null or unknown decisions are drafts."""
    return (
        F.when(decision == "rejected", "rejected")
        .when(decision == "needs_review", "pending_review")
        .when((decision == "accepted") & (score >= APPROVED_FROM) & flag, "approved")
        .when(decision == "accepted", "pending_review")
        .otherwise("draft")
    )


def event_status(decision: Column, score: Column, flag: Column) -> Column:
    """As import_status, but a missing decision is an acceptance and a missing flag a no."""
    return import_status(F.coalesce(decision, F.lit("accepted")), score, F.coalesce(flag, F.lit(False)))


def tier(confidence: Column, decision: Column | None = None) -> Column:
    """auto, review or reject; a decision that asks for a review lowers auto to it."""
    base = F.when(confidence >= AUTO_FROM, "auto").when(confidence >= REVIEW_FROM, "review").otherwise("reject")
    return base if decision is None else F.when((base == "auto") & (decision == "needs_review"), "review").otherwise(base)


def sync_action(decision: Column, existing: Column) -> Column:
    """What to do with a record, given whether it is there already."""
    there = existing.isNotNull()
    return (
        F.when((decision == "rejected") & there, "mark_outdated").when(decision == "rejected", "skipped")
        .when((decision == "accepted") & there, "updated").when(decision == "accepted", "created")
        .when(there, "updated_needs_review").otherwise("created_draft")
    )


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; the spheroid's differ by up to half a percent."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_radius(lat: Column, lon: Column, lat0: float, lon0: float, km: float) -> Column:
    """Within km of a point, edge included; nulls are not. A band of latitudes is looked at first."""
    band = km * 1000 / 111_000 * 1.01
    return F.coalesce(lat.between(lat0 - band, lat0 + band) & (distance(F.lit(lat0), F.lit(lon0), lat, lon) <= km * 1000), F.lit(False))
