"""Readers of names, tags and short replies as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of yes and of no in a reply; several words count anywhere in it.
YES = ("yes", "yeah", "yep", "yup", "sure", "okay", "ok", "go ahead", "take it", "do it", "please", "affirmative")
NO = ("no", "nope", "nah", "cancel", "don't", "negative", "stay", "keep this route", "not now", "never mind")
# Words of the kinds of shelters, and of places that only sound like one.
SHELTERS = (("Storm shelter", ("tornado", "storm")), ("Flood shelter", ("flood", "tsunami", "high ground")), ("Cooling center", ("cooling",)), ("Warming center", ("warming",)))
NOT_SHELTERS = ("animal", "pet", "pets", "humane", "spca", "wildlife", "kennel", "veterinary", "homeless", "thrift")
# Words of parking that is free and that is paid.
FREE_PARKING = ("free", "rest area", "park and ride", "park ride", "welcome center")
PAID_PARKING = ("paid", "garage", "valet", "pay", "metered")
# Upper ends of the price tiers of a check by country, and nightly prices by tier.
CHECKS = {"us": (12.0, 30.0, 60.0, 120.0), "canada": (16.0, 40.0, 80.0, 160.0), "mexico": (90.0, 250.0, 600.0, 1500.0)}
NIGHTLY = {1: 75.0, 3: 190.0, 4: 320.0, 5: 500.0}
# Spellings of the turns of a lane, and the side that each goes to.
LEFT, RIGHT = ("sharp_left", "left", "slight_left", "merge_to_left", "reverse"), ("slight_right", "right", "sharp_right", "merge_to_right")
TURNS = (*LEFT, *RIGHT, "through", "none")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, apostrophes set aside."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "['’]", ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _says(found: Column, phrase: str) -> Column:
    """The words of ``phrase`` stand in a row among ``found``."""
    return F.contains(F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" ")), F.lit(f" {phrase} "))


def _says_any(found: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [_says(found, p) for p in phrases])


def shelter_type(name: Column, query: Column) -> Column:
    """By the name, else by what was asked for."""
    kind = None
    for text in (name, query):
        for label, phrases in SHELTERS:
            fits = _says_any(words(text), phrases)
            kind = F.when(fits, label) if kind is None else kind.when(fits, label)
    return kind.otherwise("Emergency shelter")


def is_shelter_noise(name: Column) -> Column:
    return _says_any(words(name), NOT_SHELTERS)


def parking_fee(name: Column) -> Column:
    """Whether parking of that name costs something; null if it doesn't say."""
    w = words(name)
    return F.when(_says_any(w, FREE_PARKING), False).when(name.contains("$") | _says_any(w, PAID_PARKING), True)


def cost_tier(check: Column, country: Column) -> Column:
    """1 to 5 by the average check."""
    edges = F.coalesce(F.element_at(F.create_map(*[x for c, e in CHECKS.items() for x in (F.lit(c), F.array(*map(F.lit, e)))]), country), F.array(*map(F.lit, CHECKS["us"])))
    return F.size(F.filter(edges, lambda e: check > e)) + 1


def estimated_nightly(tier: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NIGHTLY.items() for x in kv]), tier), F.lit(120.0))


def signs_tier(price: Column, rating: Column) -> Column:
    """Dollar signs as a tier; four or more are 4, and 5 where the rating is very good."""
    n = F.length(F.regexp_replace(price, r"[^$]", ""))
    return F.when(n == 0, 1).when(n <= 3, n).when(F.coalesce(rating, F.lit(0.0)) >= 4.5, 5).otherwise(4)


def turn_lanes(tag: Column) -> Column:
    """array<array<string>>: the turns of each lane; a lane without a known one has 'none'."""
    known = F.array(*map(F.lit, TURNS))
    turn = lambda t: F.when(F.trim(t) == "", "none").otherwise(F.lower(F.trim(t)))
    lane = lambda x: F.filter(F.transform(F.split(x, ";"), lambda t: turn(t)), lambda t: F.array_contains(known, t))
    lanes = F.transform(F.split(F.trim(tag), "\\|"), lambda x: F.when(F.size(lane(x)) > 0, lane(x)).otherwise(F.array(F.lit("none"))))
    return F.when(F.trim(tag) != "", lanes).otherwise(F.array().cast("array<array<string>>"))


def recommended_lanes(lanes: Column, side: Column) -> Column:
    """Places of the lanes that go to a side ('left', 'right', else straight on)."""
    has = lambda lane, some: F.exists(lane, lambda t: t.isin(*some))
    allows = lambda lane: F.when(side == "left", has(lane, LEFT)).when(side == "right", has(lane, RIGHT)).otherwise(has(lane, ("through", "none")))
    return F.array_compact(F.transform(lanes, lambda lane, i: F.when(allows(lane), i)))


def yes_or_no(reply: Column) -> Column:
    """What a spoken reply says, null if neither; a no anywhere counts before a yes."""
    lower = F.lower(reply)
    spoken = F.regexp_extract_all(lower, F.lit(r"[\p{L}']+"), F.lit(0))
    heard = lambda vocabulary: reduce(lambda a, b: a | b, [lower.contains(v) if " " in v else F.array_contains(spoken, v) for v in vocabulary])
    return F.when(heard(NO), False).when(heard(YES), True)


def dial_label(name: Column) -> Column:
    """The first place on the dial that a station's name holds: '98.1 FM' or '620 AM'."""
    tokens = F.regexp_extract_all(name, F.lit(r"[0-9.]+"), F.lit(0))

    def label(t: Column) -> Column:
        fm, am = t.try_cast("double"), t.try_cast("long")
        return F.when(t.contains("."), F.when(fm.between(87.5, 108.0), F.format_string("%.1f FM", fm))).when(am.between(530, 1700), F.format_string("%d AM", am))

    return F.get(F.array_compact(F.transform(tokens, lambda t: label(t))), F.lit(0))


def attribute_id(name: Column, lat: Column, lon: Column) -> Column:
    """A stable id of a place: its name and its position in steps of a five-hundredth of a degree, cut towards zero."""
    return F.concat_ws("|", name, (lat * 500).cast("long"), (lon * 500).cast("long"))


def wind_mph(fields: Column) -> Column:
    """Miles an hour of the best of wind fields (array of struct(key, speed, unit)): ten-metre ones first, then by key; the
    first that isn't negative."""
    lower = lambda f: F.lower(f["key"])
    some = F.filter(fields, lambda f: lower(f).contains("wnd_spd") & ~f["key"].contains("-uom") & ~f["key"].contains("-qa") & ~f["key"].contains("flag") & (f["speed"] >= 0))
    best = F.get(F.array_sort(F.transform(some, lambda f: F.struct((~f["key"].contains("10m")).alias("far"), f["key"].alias("key"), f["speed"].alias("speed"), f["unit"].alias("unit")))), F.lit(0))
    return F.when(F.coalesce(F.lower(best["unit"]).contains("m/s"), F.lit(False)), best["speed"] * 2.2369362920544).otherwise(best["speed"] / 1.609344)


def mean_fahrenheit(high: Column, low: Column) -> Column:
    """The mean of a day's high and low in Celsius, or the one that is known, as Fahrenheit."""
    return F.coalesce((high + low) / 2, high, low) * 9 / 5 + 32


def hour_bucket(weekday: Column, hour: Column) -> Column:
    """'wd' or 'we' (weekday 0 is Monday) and the block of four hours."""
    return F.concat(F.when(weekday >= 5, "we").otherwise("wd"), F.floor(F.least(F.greatest(hour, F.lit(0)), F.lit(23)) / 4).cast("string"))


def thinned_ring(ring: Column, most: int) -> Column:
    """Every so many points of a ring, so that about ``most`` are left; null where under three are."""
    step = F.when(F.size(ring) > most, F.floor(F.size(ring) / max(most, 1)) + 1).otherwise(1)
    kept = F.filter(ring, lambda p, i: i % step == 0)
    return F.when((F.size(ring) >= 3) & (F.size(kept) >= 3), kept)


def operator_name(provider: Column) -> Column:
    """What riders call an operator: of several the first; its abbreviation in brackets, if it looks like one, and without the
    bracket that only names a state."""
    whole = F.trim(provider)
    first = F.trim(F.substring_index(whole, ", ", 1))
    split = r"^(.*)\(([^(]*)\)$"
    inside, before = F.trim(F.regexp_extract(first, split, 2)), F.trim(F.regexp_extract(first, split, 1))
    capitals = inside.rlike("^[A-Z0-9&]+$")
    short = F.when(capitals & F.length(inside).between(3, 8), inside).when(capitals & (F.length(inside) == 2) & (before != ""), before).otherwise(first)
    return F.when(F.length(first) < F.length(whole), F.concat(short, F.lit(" and others"))).otherwise(short)
