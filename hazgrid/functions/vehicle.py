"""Rules of vehicles and their drivers: speed, grades and clearances, towing, range, cost and driving style."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazgrid.functions.scoring import unit

# Miles an hour over a limit; hours of service in seconds; grams of CO2 a unit of fuel and a passenger mile.
OVER_STATE, OVER_FEDERAL, FEDERAL_CEILING, SIGN_SLIGHT, SIGN_OVER = 5.0, 20.0, 85.0, 5.0, 10.0
BREAK_DUE, BREAK_SOON, DRIVING_LIMIT = 28_800.0, 1_800.0, 39_600.0
CO2_UNIT = {"gas": 8_887.0, "diesel": 10_180.0, "electric": 390.0}
CO2_PASSENGER = {("rail", True): 113.0, ("coach", True): 56.0, ("rail", False): 65.0, ("coach", False): 105.0}
# Ratings in pounds of vehicles up to a height in feet (gross weight, towing, combined weight), and what a battery adds.
RATINGS = ((5.0, 4_300.0, 1_000.0, None), (6.0, 6_000.0, 3_500.0, 11_000.0), (7.0, 7_100.0, 9_000.0, 15_500.0), (10.0, 9_500.0, 5_000.0, 15_000.0), (math.inf, 26_000.0, 10_000.0, 36_000.0))
BATTERY_POUNDS = 1_200.0
# Speeds in miles an hour below which a road's limit is estimated.
ESTIMATED_LIMITS = ((30.0, 25.0), (42.0, 35.0), (52.0, 45.0), (62.0, 55.0))
EFFICIENT, FAIR = 0.25, 0.75


def _cases(pairs: list[tuple[Column, object]], rest: object) -> Column:
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(rest)


def _posted(limit: Column) -> Column:
    return F.when(limit > 0, limit)


def estimated_limit(speed: Column) -> Column:
    return _cases([(speed < below, limit) for below, limit in ESTIMATED_LIMITS], 65.0)


def state_threshold(limit: Column) -> Column:
    return _posted(limit) + OVER_STATE


def federal_threshold(limit: Column) -> Column:
    return F.when(limit > 0, F.least(limit + OVER_FEDERAL, F.lit(FEDERAL_CEILING)))


def standing(speed: Column, limit: Column) -> Column:
    """legal, state or federal; without a posted limit all speeds are legal."""
    return _cases([(speed >= federal_threshold(limit), "federal"), (speed >= state_threshold(limit), "state")], "legal")


def judgment(speed: Column, limit: Column) -> Column:
    over = speed - _posted(limit)
    return _cases([(over >= SIGN_OVER, "over"), (over >= SIGN_SLIGHT, "slightly over")], "under")


def pursuit_radius(elapsed: Column, speed: Column) -> Column:
    """Metres that a driver can be away after some seconds: at least 800, at most what three hours give."""
    seconds = F.least(F.greatest(elapsed, F.lit(0.0)), F.lit(10_800.0))
    return F.greatest(F.greatest(speed, F.lit(5.0)) * 0.44704 * seconds, F.lit(800.0))


def service_hours(driving: Column) -> Column:
    """limit, break, soon or ok for seconds of driving."""
    return _cases([(driving >= DRIVING_LIMIT, "limit"), (driving >= BREAK_DUE, "break"), (BREAK_DUE - driving <= BREAK_SOON, "soon")], "ok")


def passes_clearances(height: Column, margin: Column, clearances: Column) -> Column:
    """No clearance is at or below the height and its margin; unknown clearances pass."""
    return F.coalesce(F.forall(clearances, lambda c: c > height + margin + 1e-9), F.lit(True))


def passes_grade(limit: Column, steepest: Column) -> Column:
    return F.coalesce(steepest, F.lit(0.0)) < limit


def passes_weights(weight: Column, limits: Column) -> Column:
    """No limit is below the weight; unknown limits or weights pass."""
    return F.when((weight > 0) & limits.isNotNull(), F.forall(limits, lambda x: x >= weight - 1e-9)).otherwise(True)


def ratings(height_feet: Column, electric: Column) -> Column:
    """struct(gross, tow, combined) estimated from a vehicle's height."""
    rows = [(height_feet < top, F.struct(F.lit(g).alias("gross"), F.lit(t).alias("tow"), F.lit(c).cast("double").alias("combined"))) for top, g, t, c in RATINGS[:-1]]
    _, g, t, c = RATINGS[-1]
    found = _cases(rows, F.struct(F.lit(g).alias("gross"), F.lit(t).alias("tow"), F.lit(c).alias("combined")))
    return F.struct((found["gross"] + F.when(electric, BATTERY_POUNDS).otherwise(0.0)).alias("gross"), found["tow"].alias("tow"), found["combined"].alias("combined"))


def towing_violations(weight: Column, towed: Column, rated: Column) -> Column:
    """array<struct(kind, pounds)> of the limits that are passed and by how much; the combined one is the sum of the others where unrated."""
    combined = F.coalesce(rated["combined"], rated["gross"] + rated["tow"])

    def over(kind: str, pounds: Column) -> Column:
        return F.when(pounds > 0, F.struct(F.lit(kind).alias("kind"), pounds.alias("pounds")))

    return F.array_compact(F.array(over("gross", weight - rated["gross"]), over("tow", towed - rated["tow"]), over("combined", weight + towed - combined)))


def combined_economy(city: Column, highway: Column) -> Column:
    return 1 / (0.55 / city + 0.45 / highway)


def economy_at(mph: Column, rated: Column, city: Column, highway: Column) -> Column:
    """Miles a unit at a speed: between city and highway up to 55, falling from 65 on; the rated one where either is unknown."""
    fast = F.greatest(highway * (1 - (mph - 65) * 0.012), highway * 0.6)
    curve = _cases([(mph < 30, city), (mph < 55, city + (highway - city) * (mph - 30) / 25), (mph < 65, highway)], fast)
    return F.when(city.isNull() | highway.isNull(), rated).otherwise(curve)


def range_miles(tank: Column, rated: Column, city: Column, highway: Column, mph: Column, idle: Column) -> Column:
    """Miles that a full tank gives at a speed and share of idling."""
    idling = 1 - unit(idle) * 0.5
    plain = F.least(F.greatest(1 - F.greatest(mph - 55, F.lit(0.0)) * 0.012 - unit(idle) * 0.5, F.lit(0.5)), F.lit(1.0))
    return F.when(city.isNotNull(), tank * economy_at(mph, rated, city, highway) * idling).otherwise(tank * rated * plain)


def fuel_left(range_: Column, driven: Column) -> Column:
    """Share of the tank after some miles."""
    return F.when(range_ > 0, unit(1 - driven / range_)).otherwise(0.0)


def should_refuel(left_miles: Column, to_station: Column, reserve: float = 40.0) -> Column:
    return left_miles - reserve <= to_station


def fuel_cost(miles: Column, economy: Column, price: Column) -> Column:
    return F.when((miles >= 0) & ~F.isnan(miles) & (economy > 0) & (price > 0), miles / economy * price)


def co2_per_mile(fuel: Column, economy: Column) -> Column:
    return F.when(economy > 0, F.element_at(F.create_map(*[F.lit(x) for kv in CO2_UNIT.items() for x in kv]), fuel) / economy)


def transit_co2_per_mile(rail: Column, long_haul: Column) -> Column:
    far, near = (F.when(rail, CO2_PASSENGER["rail", k]).otherwise(CO2_PASSENGER["coach", k]) for k in (True, False))
    return F.when(long_haul, far).otherwise(near)


def headwind(wind: Column, wind_from: Column, heading: Column) -> Column:
    return F.coalesce(F.when((wind > 0) & (heading >= 0), wind * F.cos(F.radians(wind_from - heading))), F.lit(0.0))


def drive_score(speed: Column, acceleration: Column, grade: Column, cruise: Column, wind: Column, load: Column, sensitivity: Column) -> Column:
    """What throttle and grade cost under a load, and what the air costs beyond an efficient speed."""
    throttle = F.when(acceleration > 0, acceleration / 2.5).otherwise(F.greatest(acceleration / 8, F.lit(-0.3)))
    climb = F.when(grade >= 0, grade / 6).otherwise(F.greatest(grade / 12, F.lit(-0.4)))
    air = F.greatest(speed + wind, F.lit(0.0))
    drag = F.when(air > cruise, 2 * F.pow((air - cruise) / cruise, 2)).otherwise(0.0)
    return (throttle + climb) * load + drag * sensitivity


def load_factor(loaded: Column, empty: Column, fuel: Column, towing: Column) -> Column:
    weight = F.when(empty > 0, F.least(F.greatest(loaded / empty, F.lit(1.0)), F.lit(2.5)))
    return F.coalesce(weight, F.lit(1.0)) + F.coalesce(0.04 * unit(fuel), F.lit(0.0)) + F.when(towing, 0.35).otherwise(0.0)


def drag_sensitivity(city: Column, highway: Column) -> Column:
    gain = F.greatest(highway / city, F.lit(0.6))
    return F.coalesce(F.when((city > 0) & highway.isNotNull(), F.least(F.greatest(1.35 / gain, F.lit(0.7)), F.lit(1.8))), F.lit(1.0))


def drive_verdict(speed: Column, acceleration: Column, score: Column) -> Column:
    """Idling is wasteful whatever its score."""
    return _cases([((speed < 2) & (acceleration <= 0.1), "wasteful"), (score <= EFFICIENT, "efficient"), (score <= FAIR, "fair")], "wasteful")
