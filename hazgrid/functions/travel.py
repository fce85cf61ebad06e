"""Ways of travel: their times and fares, the shape of a trip, switches to a faster route, and read-outs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazgrid.functions.scoring import RED, YELLOW, finite

METRES_PER_MILE = 1609.344
# A mode's time against driving, and its speed where driving isn't known.
MODES = {"Amtrak": (1.45, 40.0), "Greyhound": (1.35, 44.0), "Rail": (1.30, 22.0)}
OTHER_MODE = (2.00, 12.0)
# Dollars of a ride, the most that one may cost, and what it must save.
RIDE_BASE, RIDE_MILE, RIDE_CAP, RIDE_SHARE, RIDE_SECONDS, RIDE_WALK = 3.0, 1.10, 25.0, 0.40, 900.0, 1_800.0
# Codes of a packed trip shape.
MAIN = {"none": 0, "plane": 1, "train": 2, "coach": 3, "ship": 4}
ACCESS = {"own car": 0, "on foot": 1, "local": 2}
EGRESS = {"walk": 0, "local": 1, "rental": 2, "rent or ride": 3}


def worth_flying(miles: Column) -> Column:
    return miles >= 100


def flight_seconds(miles: Column) -> Column:
    return F.when(miles > 0, 2_700 + miles / 460 * 3_600).otherwise(0.0)


def door_seconds(miles: Column) -> Column:
    """A flight with 90 minutes before it and 30 after."""
    return flight_seconds(miles) + 7_200


def flight_fare(miles: Column) -> Column:
    return F.greatest(F.lit(59.0), 39 + miles * 0.11)


def typical_fare(miles: Column) -> Column:
    return 159.85 + F.greatest(miles, F.lit(0.0)) * 0.0876


def rail_fare(miles: Column) -> Column:
    return F.greatest(F.lit(15.0), miles * 0.15)


def coach_fare(miles: Column) -> Column:
    return F.greatest(F.lit(12.0), miles * 0.12)


def _of_mode(mode: Column, k: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for name, v in MODES.items() for x in (F.lit(name), F.lit(v[k]))]), mode), F.lit(OTHER_MODE[k]))


def mode_seconds(mode: Column, driving: Column, miles: Column) -> Column:
    return F.when(driving > 0, driving * _of_mode(mode, 0)).when(miles > 0, miles / _of_mode(mode, 1) * 3600).otherwise(0.0)


def ride_offer(walking: Column, driving: Column, miles: Column) -> Column:
    """struct(miles, seconds, walk, cost) of a ride as far as the cap pays for, null where it isn't worth it."""
    cost = RIDE_BASE + RIDE_MILE * miles
    share = F.when(cost <= RIDE_CAP, 1.0).otherwise((RIDE_CAP - RIDE_BASE) / RIDE_MILE / miles)
    ridden, seconds, rest, paid = share * miles, share * driving, walking * (1 - share), F.least(cost, F.lit(RIDE_CAP))
    saved = walking - seconds - rest
    worth = (walking >= RIDE_WALK) & (driving > 0) & (miles > 0) & (saved >= RIDE_SECONDS) & (saved / walking >= RIDE_SHARE)
    return F.when(worth, F.struct(ridden.alias("miles"), seconds.alias("seconds"), rest.alias("walk"), paid.alias("cost")))


def trip_shape(on_foot: Column, train: Column, bus: Column, plane: Column, rental: Column, ship: Column, miles: Column) -> Column:
    """struct(main, access, egress, fallback, cards) of a trip by what a traveller picked; names as in MAIN, ACCESS and EGRESS."""
    far = miles > 60
    main = F.when(plane & worth_flying(miles), "plane").when(ship, "ship").when(far & train, "train").when(far & bus, "coach").otherwise("none")
    some = main != "none"
    local = train | bus | (ship & (main != "ship"))
    access = F.when(~on_foot, "own car").when(some & local, "local").otherwise("on foot")
    fallback = F.when(main.isin("plane", "ship"), "rent or ride").otherwise("walk")
    egress = F.when(~some, fallback).when(rental, "rental").when(local, "local").otherwise(fallback)
    bit = lambda c, n: F.when(c, n).otherwise(0)
    cards = bit(some, 1) + bit(~some & local, 2) + bit(~some & rental, 4) + bit(plane & (main != "plane"), 8)
    return F.struct(main.alias("main"), access.alias("access"), egress.alias("egress"), fallback.alias("fallback"), cards.alias("cards"))


def packed_shape(shape: Column) -> Column:
    """The shape's codes in bytes of one number, the cards in the sixth."""
    code = lambda table, value: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value).cast("long")
    parts = [(code(MAIN, shape["main"]), 0), (code(ACCESS, shape["access"]), 8), (code(EGRESS, shape["egress"]), 16), (code(EGRESS, shape["fallback"]), 24), (shape["cards"].cast("long"), 40)]
    out = F.lit(0).cast("long")
    for value, bits in parts:
        out = out.bitwiseOR(F.shiftleft(value, bits))
    return out


def saves_enough(known: Column, other: Column, least: float) -> Column:
    """``other`` seconds save at least ``least`` on the known ones; anything real is better than an unknown time."""
    return F.when(~finite(other) | (other < 0), False).when(finite(known), other + least <= known).otherwise(True)


def _level(risk: Column) -> Column:
    return F.when(risk > RED, 2).when(risk >= YELLOW, 1).otherwise(0)


def switch_verdict(complete: Column, risk: Column, ahead_known: Column, ahead: Column, unchecked: Column) -> Column:
    """switch, riskier or unknown for a faster route, by the bands of its risk and of the one ahead."""
    unknown = unchecked | ~complete | ~ahead_known | ~finite(risk) | ~finite(ahead)
    return F.when(unknown, "unknown").when((_level(risk) == 2) | (_level(risk) > _level(ahead)), "riskier").otherwise("switch")


def keeps_road_choice(kind: Column, tolls: Column, other_kind: Column, other_tolls: Column, other_highways: Column, no_tolls: Column, no_highways: Column) -> Column:
    """A candidate keeps what was chosen: no tolls where none were to be, no highways where they were avoided."""
    refuses_tolls = no_tolls | (kind == "toll free") | ~tolls
    refuses_highways = no_highways | ((kind == "avoid highways") & (other_kind != "avoid highways"))
    return ~((refuses_tolls & other_tolls) | (refuses_highways & other_highways))


def tie_tolerance(seconds: Column) -> Column:
    """Seconds within which two arrivals count as one: 8 % of the shorter, within two and fifteen minutes."""
    return F.least(F.greatest(F.greatest(seconds, F.lit(0.0)) * 0.08, F.lit(120.0)), F.lit(900.0))


def dedupe_key(metres: Column, seconds: Column) -> Column:
    """Routes of about one length and time have one key. Quotients are cut towards zero."""
    return F.concat_ws("|", (metres / 400).cast("long"), (seconds / 45).cast("long"))


def itinerary_cost(arrival: Column, transfers: Column) -> Column:
    return arrival + 300 * transfers


def door_to_door(before: Column, board: Column, alight: Column, after: Column) -> Column:
    return F.when(alight >= board, F.coalesce(before, F.lit(0.0)) + (alight - board) + F.coalesce(after, F.lit(0.0)))


def fare_total(cents: Column, currency: Column, at_least: Column) -> Column:
    """Aggregate: struct(cents, currency, at_least) of an itinerary's legs, null if a fare is missing or currencies differ."""
    known = (F.count(cents) == F.count(F.lit(1))) & (F.count(currency) == F.count(F.lit(1))) & (F.min(currency) == F.max(currency))
    return F.when(known, F.struct(F.sum(cents).alias("cents"), F.min(currency).alias("currency"), F.bool_or(at_least).alias("at_least")))


def turn_feet(metres: Column) -> Column:
    """Feet to a near turn in steps of 50, at least 50; null from 0.19 miles on."""
    return F.when(metres / METRES_PER_MILE < 0.19, F.greatest(F.round(metres / 0.3048 / 50) * 50, F.lit(50.0)).cast("long"))


def spoken_miles(metres: Column) -> Column:
    """Tenths below ten miles, whole ones from there."""
    miles = metres / METRES_PER_MILE
    return F.when(miles < 10, F.round(miles * 10) / 10).otherwise(F.round(miles))


def clock_text(seconds: Column) -> Column:
    """'45 min', '1 h 35 min' from 90 minutes on, '2.0 d' from two days on."""
    m = F.round(seconds / 60).cast("long")
    # By the number's own binary value, halves to even, as C's printf does; Java's format rounds its shortest decimal up.
    days = F.concat(F.call_function("format_number", seconds / 86_400, F.lit("0.0")), F.lit(" d"))
    hours = F.format_string("%d h %d min", F.floor(m / 60).cast("long"), m % 60)
    return F.when(m >= 2880, days).when(m >= 90, hours).otherwise(F.format_string("%d min", m))


def exposure_percent(share: Column) -> Column:
    return F.round(share * 100).cast("long")


def look_ahead(speed: Column) -> Column:
    """struct(metres, cadence): half an hour of travel within 5 and 150 km, and seconds between checks."""
    metres = F.least(F.greatest(speed * 1800, F.lit(5_000.0)), F.lit(150_000.0))
    return F.struct(metres.alias("metres"), F.when(speed > 20, 120.0).when(speed > 3, 180.0).otherwise(300.0).alias("cadence"))


def signal_tier(radio: Column, wifi: Column, offline: Column) -> Column:
    r = F.lower(radio)
    strong, weak = r.contains("nr") | r.contains("lte"), r.contains("edge") | r.contains("gprs") | r.contains("1x")
    return F.when(offline, "offline").when(wifi, "strong").when(radio.isNull(), "fair").when(strong, "strong").when(weak, "weak").otherwise("fair")


def device_tier(cores: Column, memory: Column) -> Column:
    return F.when((cores <= 2) | (memory < 3), "low").when((cores <= 4) | (memory < 4.5), "standard").otherwise("high")


def in_season(start: Column, end: Column, day: Column) -> Column:
    """Month and day as 100 * month + day within a season, which may pass New Year; no season is all year."""
    wraps = (day >= start) | (day <= end)
    return F.when((start < 100) | (end < 100), True).when(start <= end, day.between(start, end)).otherwise(wraps)
