"""Scalar risk scores as column expressions. Spark orders NaN above all numbers, so each guards against it first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The least scores of the green, yellow and red bands.
GREEN, YELLOW, RED = 0.3980, 0.6990, 0.8751


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def unit(x: Column) -> Column:
    """``x`` within 0..1; what isn't finite counts as 0."""
    return F.when(~finite(x), 0.0).when(x < 0, 0.0).when(x > 1, 1.0).otherwise(x)


def risk_band(score: Column) -> Column:
    return (
        F.when(~finite(score), "Transparent").when(score > RED, "Red").when(score >= YELLOW, "Yellow").when(score >= GREEN, "Green").otherwise("Transparent")
    )


def piecewise_score(value: Column, low, medium, high) -> Column:
    """A reading on three thresholds, mapped to the bands' cuts: 0 up to low, straight lines between, 1 at twice high."""
    low, medium, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, medium, high))
    rise = lambda base, top, start, end: base + (top - base) * ((value - start) / F.greatest(end - start, F.lit(1e-9)))
    return (
        F.when(~finite(value) | (value <= 0) | (value <= low), 0.0)
        .when(value <= medium, rise(GREEN, YELLOW, low, medium))
        .when(value <= high, rise(YELLOW, RED, medium, high))
        .otherwise(F.least(F.lit(1.0), RED + (1 - RED) * ((value - high) / F.greatest(high, F.lit(1e-9)))))
    )


def wind_risk(mph: Column) -> Column:
    return piecewise_score(mph, 15, 28, 45)


def precipitation_risk(percent: Column) -> Column:
    return piecewise_score(percent, 25, 50, 75)


def temperature_risk(temp: Column, comfort_low, comfort_high, record_low, record_high) -> Column:
    """0 within comfort, rising to 1 at the record of the side."""
    comfort_low, comfort_high, record_low, record_high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (comfort_low, comfort_high, record_low, record_high))
    below = (comfort_low - temp) / F.greatest(comfort_low - record_low, F.lit(1e-9))
    above = (temp - comfort_high) / F.greatest(record_high - comfort_high, F.lit(1e-9))
    return F.when(~finite(temp), 0.0).when(temp < comfort_low, F.least(F.lit(1.0), below)).when(temp > comfort_high, F.least(F.lit(1.0), above)).otherwise(0.0)


def temperature_anomalous(temp: Column, comfort_low, comfort_high, record_low, record_high) -> Column:
    """Beyond comfort by more than a third of the way to the record."""
    comfort_low, comfort_high, record_low, record_high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (comfort_low, comfort_high, record_low, record_high))
    high = temp - comfort_high > F.greatest((record_high - comfort_high) / 3, F.lit(1e-9))
    low = comfort_low - temp > F.greatest((comfort_low - record_low) / 3, F.lit(1e-9))
    return finite(temp) & (((temp > comfort_high) & high) | ((temp < comfort_low) & low))


def forecast_composite(temperature: Column, wind: Column, precipitation: Column) -> Column:
    return F.least(F.lit(1.0), 0.45 * temperature + 0.30 * wind + 0.25 * precipitation)


def steps(value: Column, points: list[tuple[float, float]], top: float = 1.0) -> Column:
    """Straight lines through ``points``, the last line carried on up to ``top``; no number is 0."""
    out = F.when(F.isnan(value), 0.0)
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        line = y0 + (value - x0) / (x1 - x0) * (y1 - y0)
        last = (x1, y1) == points[-1]
        if last:
            return out.otherwise(F.least(line, F.lit(top)))
        out = out.when(value < x1, line)
    return out


# Index readings and their scores.
AIR_QUALITY = [(0.0, 0.0), (50.0, 0.2), (100.0, 0.45), (150.0, 0.7), (200.0, 0.9), (500.0, 1.0)]
ULTRAVIOLET = [(0.0, 0.0), (3.0, 0.2), (6.0, 0.4), (8.0, 0.6), (11.0, 0.85), (16.0, 1.0)]


def air_score(aqi: Column) -> Column:
    return steps(aqi, AIR_QUALITY)


def uv_score(index: Column) -> Column:
    return steps(index, ULTRAVIOLET)


def flood_multiplier(elevation: Column, local_low: Column, qpf_inches: Column, evidence: Column) -> Column:
    """How much standing water worsens rain: 1 without rain, 1.6 to 2 where the rain reaches the place, else by evidence."""
    rain = qpf_inches * 0.0254
    known = unit(evidence)
    room = F.greatest(elevation - local_low, F.lit(0.0))
    deep = F.greatest(rain, F.lit(0.01))
    near = F.greatest(F.lit(0.0), 1 - (room - rain) / deep)
    return (
        F.when(~(finite(qpf_inches) & (qpf_inches > 0)), 1.0)
        .when(~(finite(elevation) & finite(local_low)), 1 + 0.5 * known * F.least(qpf_inches / 2, F.lit(1.0)))
        .when(room <= rain, 1.6 + 0.4 * F.least((rain - room) / deep, F.lit(1.0)))
        .otherwise(1 + 0.5 * known * near)
    )


def log_score(count: Column, p95: Column, top: float = 0.6, least: float = 0.05) -> Column:
    """A count against the 95th percentile on a logarithmic scale up to ``top``; below ``least`` nothing."""
    raw = F.least(F.lit(top), top * F.log1p(count) / F.log1p(p95))
    return F.when((count <= 0) | (p95 <= 0) | ~finite(count) | ~finite(p95), 0.0).when(raw < least, 0.0).otherwise(raw)


def ranking_risk(band: Column, exposure: Column, prior: Column, confidence: Column) -> Column:
    c = unit(confidence)
    return 1 - (1 - unit(band)) * (1 - 0.6 * (unit(exposure) * (1 - c) + unit(prior) * c))


def fuel_severity(fraction: Column) -> Column:
    return F.pow(1 - unit(fraction), F.lit(3.0))
