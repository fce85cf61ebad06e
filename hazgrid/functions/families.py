"""Hazard families: their weights and tiers, and what combines or names them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazgrid.functions.scoring import finite, unit

# The weight of each family in a plain combination (1 for others), and the two tiers.
WEIGHTS = {
    "air": 0.60, "avalanche": 0.86, "cold": 0.66, "convective": 0.92, "fire": 0.74, "flood": 0.96, "heat": 0.70, "precip": 0.55,
    "qpf_flood": 0.96, "radiation": 0.52, "seismic": 0.78, "tropical": 0.94, "tsunami": 0.97, "volcanic": 0.90, "wind": 0.64, "winter": 0.88,
}
PRIMARY = ("closure", "fire", "flood", "qpf_flood", "seismic", "storm", "tropical", "tsunami", "volcanic")
SECONDARY = ("air", "avalanche", "cold", "convective", "heat", "precip", "radiation", "wind", "winter")
CEILING = 0.80

# Words of an alert's name and the family that they stand for; the first that fits counts.
ALERT_WORDS = (
    ("storm", ("tornado warning", "severe thunderstorm warning", "snow squall warning", "dust storm warning", "blowing dust warning")),
    ("fire", ("fire warning",)),
    ("qpf_flood", ("flash flood warning", "flash flood emergency", "flood warning")),
    ("tsunami", ("tsunami warning",)),
    ("tropical", ("hurricane warning", "storm surge warning", "extreme wind", "tropical storm warning")),
    ("volcanic", ("ashfall", "volcano")),
    ("winter", ("winter", "ice storm", "blizzard", "snow", "freezing rain")),
    ("heat", ("heat",)),
    ("cold", ("chill", "freeze", "frost", "cold")),
    ("heat", ("red flag", "fire weather")),
    ("wind", ("hurricane", "typhoon", "tropical storm", "wind")),
    ("air", ("air quality", "smoke", "dust", "fog")),
    ("precip", ("flood",)),
    ("convective", ("tornado", "thunderstorm", "storm")),
    ("seismic", ("earthquake warning",)),
    ("avalanche", ("avalanche",)),
    ("wind", ("gale", "special marine warning")),
    ("convective", ("special weather statement",)),
    ("precip", ("rain advisory",)),
)


def weight(family: Column) -> Column:
    pairs = [F.lit(x) for item in WEIGHTS.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), family), F.lit(1.0))


def noisy_or(score: Column, weights: Column | None = None) -> Column:
    """Aggregate: the chance that at least one of independent hazards strikes."""
    return 1 - F.product(1 - (unit(score) if weights is None else weights * unit(score)))


def realized_risk(family: Column, score: Column) -> Column:
    """Aggregate over a place's families: primary hazards combine unweighted, secondary ones by weight; secondaries amplify
    primaries, and alone advise up to a ceiling. Families of neither tier don't count."""
    primary = F.coalesce(1 - F.product(F.when(family.isin(*PRIMARY), 1 - unit(score))), F.lit(0.0))
    secondary = F.coalesce(1 - F.product(F.when(family.isin(*SECONDARY), 1 - weight(family) * unit(score))), F.lit(0.0))
    return F.greatest(primary * (1 + (1 - primary) * secondary), F.least(F.lit(CEILING), secondary))


def dominant_family(family: Column, score: Column, acute: Column, floor: float = 0.0, nudge: float = 0.05) -> Column:
    """Aggregate: the family with the greatest score of at least ``floor``, acute ones a nudge ahead; ties by name."""
    lifted = score + F.when(acute, nudge).otherwise(0.0)
    best = F.min(F.when(finite(score) & (score >= floor), F.struct((-lifted).alias("rank"), family.alias("family"))))
    return best["family"]


def alert_family(event: Column) -> Column:
    """The family of an alert by its name, case set aside; null if none fits."""
    e = F.lower(event)
    any_of = lambda words: F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(e, w)), True)
    out = None
    for family, words in ALERT_WORDS:
        fits = any_of(words)
        if words == ("fire warning",):
            fits = fits & ~F.contains(e, F.lit("fire weather"))
        value = F.when(F.contains(e, F.lit("advisory")), "air").otherwise("volcanic") if family == "volcanic" else F.lit(family)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out
