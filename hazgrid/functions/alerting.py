"""What an alert asks for, how it ranks, how long it may last, and when a risk escalates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazgrid.functions.families import PRIMARY, SECONDARY, alert_family
from hazgrid.functions.scoring import GREEN, RED, YELLOW, finite

# Words of alerts that bid people look out, and of those that are a matter of life.
LOOKOUT = ("child abduction", "amber alert", "blue alert", "silver alert", "endangered", "missing person", "law enforcement warning")
LIFE_SAFETY = (
    "tornado warning", "tornado emergency", "hurricane warning", "typhoon warning", "extreme wind warning", "fire warning", "flash flood emergency", "tsunami warning", "radiological", "nuclear",
    "hazardous materials", "shelter in place", "civil danger", "evacuation", "child abduction", "amber alert", "blue alert", "silver alert", "law enforcement warning", "civil emergency",
)
# Words of an event and its usual hours; the first that fits counts, the first word names the kind.
USUAL_HOURS = (
    (("hurricane watch", "typhoon watch"), 30.0), (("tropical storm watch",), 21.0), (("storm surge watch",), 25.0), (("storm surge",), 48.0), (("hurricane", "typhoon", "tropical", "cyclone"), 42.0),
    (("volcan", "ashfall"), 15.0), (("flash flood watch",), 9.0), (("flash flood",), 3.0), (("coastal flood", "lakeshore flood"), 13.0), (("tsunami",), 18.0), (("flood advisory",), 3.0),
    (("flood watch",), 17.0), (("flood", "hydrologic"), 42.0), (("red flag", "fire weather"), 8.0), (("fire", "evacuation"), 72.0), (("tornado watch",), 6.0), (("thunderstorm watch",), 5.6),
    (("tornado",), 0.5), (("thunderstorm", "snow squall"), 0.7), (("special marine", "dust storm"), 1.0), (("extreme wind",), 2.0), (("special weather statement", "short term"), 1.0), (("blizzard",), 22.0),
    (("ice storm",), 20.0), (("lake effect",), 27.0), (("winter storm",), 27.0), (("winter weather",), 18.0), (("winter", "snow", "avalanche", "freezing rain"), 24.0), (("wind chill",), 19.0), (("cold",), 9.0),
    (("heat",), 9.0), (("freeze", "frost"), 8.0), (("fog",), 7.0), (("high surf",), 30.0), (("air stagnation",), 96.0), (("air quality",), 24.0), (("wind",), 13.0),
)
OTHER_HOURS = 12.0


def _has(event: Column, words: tuple[str, ...]) -> Column:
    e = F.lower(event)
    return reduce(lambda a, b: a | b, [e.contains(w) for w in words])


def is_lookout(event: Column) -> Column:
    return _has(event, LOOKOUT)


def is_life_safety(event: Column) -> Column:
    return _has(event, LIFE_SAFETY)


def is_warning(event: Column) -> Column:
    return _has(event, ("warning", "emergency"))


def same_hazard(badge: Column, shown: Column) -> Column:
    """A warning is only the same hazard as its like; anything else is the same as all."""
    return F.when(is_warning(badge), badge.eqNullSafe(shown)).otherwise(True)


def action(event: Column, severity: Column, seconds_left: Column) -> Column:
    """lookout, shelter, rest area (a strong alert that ends within two hours) or monitor."""
    soon = finite(severity) & (severity >= 0.60) & (seconds_left > 0) & (seconds_left <= 7_200)
    return F.when(is_lookout(event), "lookout").when(is_life_safety(event) | (finite(severity) & (severity > RED)), "shelter").when(soon, "rest area").otherwise("monitor")


def threat_rank(event: Column, severity: Column) -> Column:
    """3 for life, 2 for primary families or red, 1 for any family or green, else 0; look-outs are 0."""
    family = alert_family(event)
    two = F.coalesce(family.isin(*PRIMARY), F.lit(False)) | (finite(severity) & (severity > RED))
    return F.when(is_lookout(event), 0).when(is_life_safety(event), 3).when(two, 2).when(family.isNotNull() | (finite(severity) & (severity >= GREEN)), 1).otherwise(0)


def sample_tier(event: Column, severity: Column) -> Column:
    """The threat rank, but 1 for a red alert of a secondary family."""
    rank = threat_rank(event, severity)
    return F.when((rank == 2) & F.coalesce(alert_family(event).isin(*SECONDARY), F.lit(False)), 1).otherwise(rank)


def is_active(expires: Column, arrival: Column, now: Column) -> Column:
    """Not over by the time of arrival; an alert without an end is active."""
    return expires.isNull() | (expires > now + F.greatest(F.coalesce(arrival, F.lit(0.0)), F.lit(0.0)))


def _usual(event: Column, values: list, rest) -> Column:
    out = None
    for (words, _), value in zip(USUAL_HOURS, values, strict=True):
        out = F.when(_has(event, words), value) if out is None else out.when(_has(event, words), value)
    return out.otherwise(rest)


def usual_kind(event: Column) -> Column:
    return _usual(event, [words[0] for words, _ in USUAL_HOURS], "other")


def usual_hours(event: Column) -> Column:
    return _usual(event, [hours for _, hours in USUAL_HOURS], OTHER_HOURS)


def learned_hours(usual: Column, count: Column, mean_ln: Column) -> Column:
    """Usual hours drawn towards the mean logarithm of lengths seen: 20 events' worth of prior, within half and three times."""
    n = F.least(count, F.lit(180))
    drawn = F.exp((20 * F.log(usual) + n * mean_ln) / (20 + n))
    return F.when((count > 0) & finite(mean_ln) & (usual > 0), F.least(F.greatest(drawn, usual * 0.5), usual * 3)).otherwise(usual)


def unknown_end_hours(event: Column, severity: Column, zones: Column, certainty: Column, count: Column, mean_ln: Column) -> Column:
    """Hours that an alert without an end may last: longer if severe, wide or observed; within half an hour and a week."""
    strength = F.when(finite(severity), 0.5 + F.least(F.greatest(severity, F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    reach = 1 + 0.15 * F.floor(F.log2(F.least(F.greatest(zones, F.lit(1)), F.lit(16))))
    c = F.lower(certainty)
    sure = F.when(c.contains("observed"), 1.25).when(c.contains("unlikely"), 0.5).when(c.contains("possible"), 0.75).otherwise(1.0)
    hours = learned_hours(usual_hours(event), count, mean_ln) * strength * reach * sure
    return F.least(F.greatest(hours, F.lit(0.5)), F.lit(168.0))


def escalation(complete: Column, mean: Column, peak: Column, unseen: Column, baseline: Column, dismissed: Column) -> Column:
    """acute (a red peak that is new or well over what was dismissed), sustained (a yellow mean well over the baseline and what
    was dismissed) or null. A baseline below 0 is still to be taken."""
    acute = (peak > RED) & finite(peak) & ((peak > dismissed + 0.05) | unseen)
    sustained = finite(mean) & (mean >= YELLOW) & (mean > baseline + 0.12) & (mean > dismissed + 0.05)
    return F.when((baseline >= 0) & complete, F.when(acute, "acute").when(sustained, "sustained"))
