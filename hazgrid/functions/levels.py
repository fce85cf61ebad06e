"""Scores of levels that feeds report as words or small numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels and their scores.
FLOOD = {"action": 0.25, "minor": 0.45, "moderate": 0.70, "major": 1.0}
VOLCANO = {"WARNING": 1.0, "WATCH": 0.72, "ADVISORY": 0.42}
SEVERITY = {"extreme": 0.95, "severe": 0.88, "moderate": 0.72, "minor": 0.45}
OUTLOOK = {2: 0.35, 3: 0.45, 4: 0.60, 5: 0.72, 6: 0.88, 8: 1.0}
AVALANCHE = (0.0, 0.25, 0.45, 0.72, 0.90, 1.0)
SPACE_WEATHER = (0.0, 0.15, 0.30, 0.55, 0.78, 1.0)
TROPICAL_KNOTS = ((34.0, 0.30), (64.0, 0.52), (83.0, 0.72), (96.0, 0.82), (113.0, 0.90), (137.0, 0.96))
TSUNAMI = (("warning", 1.0), ("advisory", 0.82), ("watch", 0.72))


def _of(table: dict, key: Column, default: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def flood_category(category: Column) -> Column:
    return _of(FLOOD, category, 0.0)


def volcano(level: Column) -> Column:
    return _of(VOLCANO, F.upper(level), 0.0)


def severity(word: Column) -> Column:
    return _of(SEVERITY, F.lower(word), 0.30)


def outlook(number: Column) -> Column:
    return _of(OUTLOOK, number.cast("int"), 0.0)


def scale(number: Column, scores: tuple[float, ...]) -> Column:
    """A scale from 0 to 5, numbers beyond it at its ends."""
    return F.get(F.array(*map(F.lit, scores)), F.least(F.lit(5), F.greatest(F.lit(0), number)).cast("int"))


def tropical(knots: Column) -> Column:
    out = F.when(knots < TROPICAL_KNOTS[0][0], TROPICAL_KNOTS[0][1])
    for limit, score in TROPICAL_KNOTS[1:]:
        out = out.when(knots < limit, score)
    return out.otherwise(1.0)


def tsunami(level: Column) -> Column:
    out = None
    for word, score in TSUNAMI:
        fits = F.contains(F.lower(level), F.lit(word))
        out = F.when(fits, score) if out is None else out.when(fits, score)
    return out.otherwise(0.0)
