"""Climate types and the sun's position as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazgrid.functions import scoring


def climate_type(lat: Column, lon: Column, elevation: Column) -> Column:
    e = F.coalesce(elevation, F.lit(0.0))
    return (
        F.when(lat >= 66, "tundra").when(e >= 2000, "highland").when((lat < 25) | ((lat < 27) & (lon > -83)), "tropical")
        .when(lon <= -117, F.when(lat >= 42, "marineWestCoast").otherwise("mediterranean"))
        .when(lon <= -102, F.when((e < 1000) & (lat < 37), "hotDesert").otherwise("coldSteppe"))
        .when(lat < 37, "humidSubtropical").when(lat < 43, "humidContinentalWarm").when(lat < 50, "humidContinentalCool").otherwise("subarctic")
    )


def solar_elevation(unix: Column, lat: Column, lon: Column) -> Column:
    """Degrees of the sun above the horizon, by the usual low-precision series of the almanac."""
    n = unix / 86_400.0 + 2440587.5 - 2451545.0
    mean = F.radians(F.pmod(357.529 + 0.98560028 * n, F.lit(360.0)))
    ecliptic = F.radians(280.459 + 0.98564736 * n + 1.915 * F.sin(mean) + 0.020 * F.sin(2 * mean))
    tilt = F.radians(23.439 - 0.00000036 * n)
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    sidereal = F.radians(F.pmod(280.46061837 + 360.98564736629 * n + lon, F.lit(360.0)))
    hour = sidereal - ascension
    return F.degrees(F.asin(F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(hour)))


def civil_twilight(unix: Column, lat: Column, lon: Column) -> Column:
    return solar_elevation(unix, lat, lon).between(-6, 0)


# By climate type, the comfortable low and high, the record low and high; the lows and highs of midwinter and
# midsummer; mean and spread of the wind. Fahrenheit and miles an hour.
TYPES = {
    "marineWestCoast": ((45.0, 72.0, 12.0, 106.0), (38.0, 50.0, 58.0, 72.0), (8.0, 3.0)),
    "mediterranean": ((48.0, 82.0, 25.0, 116.0), (45.0, 58.0, 65.0, 82.0), (7.0, 2.5)),
    "hotDesert": ((55.0, 98.0, 25.0, 125.0), (38.0, 62.0, 72.0, 98.0), (9.0, 4.0)),
    "coldSteppe": ((35.0, 85.0, -25.0, 110.0), (15.0, 35.0, 55.0, 85.0), (11.0, 5.0)),
    "humidSubtropical": ((45.0, 90.0, 5.0, 112.0), (38.0, 58.0, 68.0, 90.0), (8.0, 3.5)),
    "humidContinentalWarm": ((35.0, 82.0, -20.0, 108.0), (22.0, 38.0, 62.0, 82.0), (9.0, 4.0)),
    "humidContinentalCool": ((28.0, 78.0, -35.0, 104.0), (12.0, 28.0, 58.0, 78.0), (10.0, 4.5)),
    "subarctic": ((20.0, 72.0, -55.0, 98.0), (0.0, 20.0, 50.0, 72.0), (12.0, 5.5)),
    "tropical": ((68.0, 90.0, 40.0, 106.0), (68.0, 84.0, 76.0, 90.0), (11.0, 4.0)),
    "tundra": ((10.0, 58.0, -65.0, 86.0), (-15.0, 10.0, 35.0, 58.0), (13.0, 6.0)),
    "highland": ((28.0, 74.0, -40.0, 100.0), (18.0, 35.0, 50.0, 74.0), (11.0, 5.0)),
    "temperateOceanic": ((42.0, 74.0, 5.0, 102.0), (35.0, 48.0, 55.0, 74.0), (9.0, 3.5)),
}
PREDICTORS = ("wind", "precip", "heat", "cold", "winter", "convective")


def _of_type(kind: Column, row: int, names: tuple[str, ...]) -> Column:
    pairs = [x for name, rows in TYPES.items() for x in (F.lit(name), F.struct(*(F.lit(v).alias(n) for v, n in zip(rows[row], names, strict=True))))]
    return F.element_at(F.create_map(*pairs), kind)


def comfort(kind: Column) -> Column:
    """struct(low, high, record_low, record_high) of a climate type."""
    return _of_type(kind, 0, ("low", "high", "record_low", "record_high"))


def seasonal_norms(kind: Column, week: Column) -> Column:
    """struct(low, high, wind, spread) of a climate type in a week: between midwinter and midsummer by the cosine of the year."""
    anchor, wind = _of_type(kind, 1, ("winter_low", "winter_high", "summer_low", "summer_high")), _of_type(kind, 2, ("mean", "spread"))
    phase = (1 - F.cos(2 * math.pi * F.pmod(week, F.lit(52)) / 52)) / 2
    low = anchor["winter_low"] + (anchor["summer_low"] - anchor["winter_low"]) * phase
    high = anchor["winter_high"] + (anchor["summer_high"] - anchor["winter_high"]) * phase
    return F.struct(low.alias("low"), high.alias("high"), wind["mean"].alias("wind"), wind["spread"].alias("spread"))


def temperature_beyond_normal(temp: Column, norms: Column) -> Column:
    return scoring.finite(temp) & ((temp > norms["high"] + 12) | (temp < norms["low"] - 12))


def wind_beyond_normal(wind: Column, norms: Column) -> Column:
    return scoring.finite(wind) & (wind > norms["wind"] + 2 * norms["spread"])


def _temperature(temp: Column, c: Column) -> Column:
    return scoring.temperature_risk(temp, c["low"], c["high"], c["record_low"], c["record_high"])


def forecast_score(temp: Column, wind: Column, rain: Column, c: Column) -> Column:
    """One score of a forecast in a climate (``comfort``); readings that are missing add nothing."""
    return scoring.forecast_composite(_temperature(temp, c), scoring.wind_risk(wind), scoring.precipitation_risk(rain))


def predictor_families(temp: Column, wind: Column, rain: Column, c: Column) -> Column:
    """struct of PREDICTORS: scores of a forecast by family; a missing temperature counts as 70."""
    t, w, p = _temperature(temp, c), scoring.wind_risk(wind), scoring.precipitation_risk(rain)
    felt = F.coalesce(temp, F.lit(70.0))
    one = F.lit(1.0)
    scores = {
        "wind": w, "precip": p, "heat": F.when(felt > c["high"], t).otherwise(0.0), "cold": F.when(felt < c["low"], t).otherwise(0.0),
        "winter": F.when(felt <= 34, F.least(one, 0.2 * w + 0.8 * p)).otherwise(0.0), "convective": F.when(felt > 60, F.least(one, 0.6 * p + 0.4 * w)).otherwise(0.3 * p),
    }
    return F.struct(*(scores[name].alias(name) for name in PREDICTORS))


# The box of the priors, their greatest and least score, and the borders of the latitude bands.
CONUS = (24.0, 50.0, -125.0, -66.0)
PRIOR_MOST, PRIOR_LEAST = 0.6, 0.05
BAND_SOUTH, BAND_NORTH, BAND_LEAST, BAND_MOST = 42.312985, 47.080621, 14.0, 70.0


def in_conus(lat: Column, lon: Column) -> Column:
    south, north, west, east = CONUS
    return lat.between(south, north) & lon.between(west, east)


def _ramp(x: Column, low: float, high: float) -> Column:
    return scoring.unit((x - low) / (high - low))


def _box(x: Column, low: float, high: float, soft: float) -> Column:
    return _ramp(x, low, low + soft) * (1 - _ramp(x, high - soft, high))


def family_priors(lat: Column, lon: Column, week: Column) -> Column:
    """map of family to climatological prior at a place in a week; what is too faint is 0."""
    year = F.cos(2 * math.pi * week / 52)
    winter, summer = F.greatest(year, F.lit(0.0)), F.greatest(-year, F.lit(0.0))
    gulf, atlantic = _box(lat, 24.0, 32.0, 2.0) * _box(lon, -98.5, -80.0, 2.0), _box(lat, 24.0, 36.5, 2.5) * _ramp(lon, -83.5, -80.5)
    tropical = F.when(week.between(32, 44), F.sin(math.pi * (week - 32) / 12) * F.greatest(gulf, atlantic)).otherwise(0.0)
    stormy = F.when(week.between(10, 38), F.sin(math.pi * (week - 10) / 28)).otherwise(0.0)
    desert, south = _box(lon, -120.0, -103.0, 3.0) * _box(lat, 29.0, 38.5, 2.5), 1 - _ramp(lat, 30.0, 38.0)
    raw = {
        "winter": 0.55 * winter * _ramp(lat, 30.0, 47.0), "cold": 0.5 * winter * _ramp(lat, 35.0, 48.0), "convective": 0.45 * stormy * _box(lon, -105.0, -78.0, 5.0) * _box(lat, 26.0, 47.0, 5.0),
        "heat": 0.55 * summer * F.least(desert + 0.45 * south, F.lit(1.0)), "wind": 0.3 * _box(lon, -105.5, -94.0, 3.0) * _box(lat, 27.0, 49.5, 3.0) + 0.35 * tropical,
        "qpf_flood": 0.15 * (1 - _ramp(lat, 30.0, 36.0)) * _ramp(lon, -100.0, -92.0) + 0.45 * tropical,
    }
    kept = lambda v: F.when(v < PRIOR_LEAST, 0.0).otherwise(F.least(v, F.lit(PRIOR_MOST)))
    return F.create_map(*[x for name, v in raw.items() for x in (F.lit(name), kept(v))])


def latitude_band(lat: Column) -> Column:
    """Bands of about half a degree, counted from a southern border; latitudes beyond the map count as its edge."""
    x = (F.least(F.greatest(lat, F.lit(BAND_LEAST)), F.lit(BAND_MOST)) - BAND_SOUTH) / ((BAND_NORTH - BAND_SOUTH) / 10)
    return F.when(x <= 0, F.floor(x) + 1).otherwise(F.ceil(x - 1e-9)).cast("long")


def band_comfort(lat: Column, elevation: Column) -> Column:
    """struct(band, low, high, record_low, record_high): a degree colder a band, shifted a band by high or low ground."""
    shift = F.when(scoring.finite(elevation), F.least(F.greatest(F.round((elevation - 300) / 85.47), F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)
    edges = [latitude_band(F.lit(x)) for x in (BAND_LEAST, BAND_MOST)]
    band = F.least(F.greatest(latitude_band(lat) + shift.cast("long"), edges[0]), edges[1])
    within = lambda x, low, high: F.least(F.greatest(x, low), high)
    step = (band - 1).cast("double")
    low = within(60 - step, F.lit(-10.0), F.lit(72.0))
    high = within(76 - step, low + 10, F.lit(92.0))
    return F.struct(
        band.alias("band"), low.alias("low"), high.alias("high"), within(-28 - step, F.lit(-80.0), F.lit(45.0)).alias("record_low"), within(108 - step, high + 10, F.lit(125.0)).alias("record_high")
    )
