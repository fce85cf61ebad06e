"""Names of recorded events to hazard families, and their weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of an event's name and the families that it counts for; the first that fits counts.
EVENT_WORDS = (
    (("tornado", "thunderstorm wind", "hail", "lightning", "waterspout"), ("convective",)),
    (("flood", "tsunami", "seiche", "heavy rain"), ("qpf_flood",)),
    (("winter storm", "heavy snow", "ice storm", "blizzard", "winter weather", "lake-effect", "sleet", "freezing", "avalanche"), ("winter",)),
    (("hurricane", "tropical storm", "tropical depression", "storm surge"), ("wind", "qpf_flood")),
    (("heat",), ("heat",)),
    (("extreme cold", "wind chill", "cold", "frost"), ("cold",)),
    (("wind",), ("wind",)),
    (("wildfire", "dense smoke"), ("fire",)),
    (("drought", "dust"), ("air",)),
)


def event_families(name: Column) -> Column:
    """array<string> of the families of an event, empty if it is of none."""
    text = F.lower(name)
    out = None
    for words, found in EVENT_WORDS:
        fits = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
        value = F.array(*map(F.lit, found))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(F.array().cast("array<string>"))


def event_weight(name: Column, magnitude: Column) -> Column:
    """Large hail and strong wind count half as much again."""
    text = F.lower(name)
    return F.when(F.contains(text, F.lit("hail")) & (magnitude >= 2), 1.5).when(F.contains(text, F.lit("wind")) & (magnitude >= 65), 1.5).otherwise(1.0)


def fahrenheit(celsius: Column) -> Column:
    return celsius * 9 / 5 + 32


def mph(kmh: Column) -> Column:
    return kmh * 0.621371


def is_peak(minutes: Column) -> Column:
    """Peak minutes of a local day: morning, noon, afternoon and evening."""
    return minutes.between(420, 539) | minutes.between(690, 779) | minutes.between(870, 959) | minutes.between(990, 1109)


def fuel_level(reply: Column) -> Column:
    """The share of fuel in a hexadecimal reply 41 2F xx."""
    digits = F.regexp_extract(F.replace(F.upper(reply), F.lit(" "), F.lit("")), "412F([0-9A-F]{2})", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("double") / 255)
