"""Which roads of a map count: column expressions over their tags (map<string, string>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of ways, services and accesses that no route drives.
NOT_DRIVEN = ("footway", "cycleway", "path", "pedestrian", "steps", "bridleway", "corridor", "platform", "elevator")
NOT_PUBLIC_SERVICE = ("parking_aisle", "driveway", "drive-through", "parking")
NOT_PUBLIC_ACCESS = ("private", "no", "customers")


def posted_limit_counts(tags: Column) -> Column:
    """Whether a limit posted on a way restricts drivers: a public road that can be driven. Tags that say nothing count; a way
    without tags is no road."""

    def tag(key: str) -> Column:
        return F.coalesce(F.element_at(tags, key), F.lit(""))

    has = lambda key: F.element_at(tags, key).isNotNull()
    road = has("highway") & ~tag("highway").isin(*NOT_DRIVEN)
    closed = tag("service").isin(*NOT_PUBLIC_SERVICE) | tag("access").isin(*NOT_PUBLIC_ACCESS) | (tag("amenity") == "parking") | has("parking") | has("building")
    return F.coalesce(road & ~closed, F.lit(False))
