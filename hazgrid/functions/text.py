"""Parsers of names, tags and encoded lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of county names, the longest first.
COUNTY_ENDINGS = ("CITY AND BOROUGH", "CENSUS AREA", "MUNICIPALITY", "COUNTY", "PARISH", "BOROUGH", "CITY")


def county_key(name: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(name)), " (?:" + "|".join(COUNTY_ENDINGS) + ")$", "")


def clearance_meters(tag: Column) -> Column:
    """Metres of a clearance such as 13'6", 12 ft, 3.8 m or 3.8; null if it is none of these."""
    t = F.lower(F.trim(tag))
    feet = r"""^(\d+(?:\.\d+)?)\s*(?:'|ft|feet)\s*(?:(\d+(?:\.\d+)?)\s*(?:"|in|inches)?)?$"""
    plain = r"^(\d+(?:\.\d+)?)\s*(?:m|meters?|metres?)?$"
    inches = F.regexp_extract(t, feet, 2)
    as_feet = (F.regexp_extract(t, feet, 1).try_cast("double") + F.coalesce(inches.try_cast("double"), F.lit(0.0)) / 12) * 0.3048
    return F.when(t.rlike(feet), as_feet).when(t.rlike(plain), F.regexp_extract(t, plain, 1).try_cast("double"))


def maxspeed_mph(tag: Column) -> Column:
    """Miles an hour of a speed tag: with a unit mph, km/h or knots, else kilometres an hour; null if it holds no number."""
    pattern = r"^(\d+(?:\.\d+)?)\s*(mph|km/h|kmh|kph|knots)?$"
    t = F.lower(F.trim(tag))
    n, kind = F.regexp_extract(t, pattern, 1).try_cast("double"), F.regexp_extract(t, pattern, 2)
    return F.when(t.rlike(pattern), F.when(kind == "mph", n).when(kind == "knots", n * 1.150779).otherwise(n * 0.621371))


def whole_word(text: Column, word: str) -> Column:
    return text.rlike(rf"(?<![A-Za-z0-9])\Q{word}\E(?![A-Za-z0-9])")


def coordinate(text: Column) -> Column:
    """struct(lat, lon) of a pasted pair such as '43.07, -89.4'; null when out of range."""
    pattern = r"^\s*\(?\s*(-?\d{1,2}(?:\.\d+)?)\s*[,; ]\s*(-?\d{1,3}(?:\.\d+)?)\s*\)?\s*$"
    lat, lon = (F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(text.rlike(pattern) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def decode_polyline(line: Column) -> Column:
    """array<struct<lat, lon>> of an encoded polyline: chunks of five bits, zigzag, five decimals. A fold over its characters."""
    start = F.struct(
        F.lit(0).cast("long").alias("value"), F.lit(0).alias("shift"), F.lit(0).cast("long").alias("lat"), F.lit(0).cast("long").alias("lon"),
        F.lit(True).alias("first"), F.array().cast("array<struct<lat:double,lon:double>>").alias("out"),
    )

    def add(s: Column, c: Column) -> Column:
        bits = F.ascii(c) - 63
        power = F.pow(F.lit(2.0), s["shift"]).cast("long")
        value = s["value"] + bits.bitwiseAND(F.lit(31)).cast("long") * power
        done = bits < 32
        delta = F.when(value % 2 == 1, -F.floor((value + 1) / 2)).otherwise(F.floor(value / 2)).cast("long")
        lat = F.when(done & s["first"], s["lat"] + delta).otherwise(s["lat"])
        lon = F.when(done & ~s["first"], s["lon"] + delta).otherwise(s["lon"])
        point = F.struct((lat / 1e5).alias("lat"), (lon / 1e5).alias("lon"))
        return F.struct(
            F.when(done, F.lit(0).cast("long")).otherwise(value).alias("value"), F.when(done, 0).otherwise(s["shift"] + 5).alias("shift"),
            lat.alias("lat"), lon.alias("lon"), (s["first"] != done).alias("first"),
            F.when(done & ~s["first"], F.array_append(s["out"], point)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(F.split(line, ""), start, add, lambda s: s["out"])
