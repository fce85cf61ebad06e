"""The corridor of a route: samples, forecasts, a risk field, feeds and alerts, blended to a risk a sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazgrid.functions import families, scoring

FIELD = ("wind", "heat", "cold", "air", "radiation", "winter", "convective", "qpf_flood", "environmental")
DEVICE = ("wind", "precip", "heat", "cold", "winter", "convective")


def with_forecasts(samples: DataFrame, path: list[str], order: str) -> DataFrame:
    """Each sample's forecast (a nullable struct ``forecast``), else its nearest neighbour's within two samples, and the
    least known elevation within four samples."""
    w = Window.partitionBy(*path).orderBy(order)
    tries = [F.col("forecast")]
    for k in (1, 2):
        tries += [F.lag("forecast", k).over(w), F.lead("forecast", k).over(w)]
    low = F.min("forecast.elevation_m").over(w.rowsBetween(-4, 4))
    return samples.withColumns({"near": F.coalesce(*tries), "local_low": low})


def _combined(values: list[tuple[str, Column]]) -> Column:
    """The two tiers over one row's families."""
    product = lambda cs: reduce(lambda a, b: a * b, cs, F.lit(1.0))
    p = 1 - product([1 - scoring.unit(v) for f, v in values if f in families.PRIMARY])
    q = 1 - product([1 - families.WEIGHTS[f] * scoring.unit(v) for f, v in values if f in families.SECONDARY])
    return F.greatest(p * (1 + (1 - p) * q), F.least(F.lit(families.CEILING), q))


def blend(samples: DataFrame) -> DataFrame:
    """``samples`` with risk. Columns read: near (struct wind, precip, heat, cold, winter, convective, elevation_m,
    qpf_inches; null without forecast), local_low, field (struct of FIELD; null without), gauge and water (0..1), live (map
    family to score; null if unchecked), event and severity (null without alert), closure (0..1).

    Predictors take the greater of field and forecast; rain is worsened by standing water; live scores, the alert's
    family and closures raise their families; absent families count as 0.
    """
    zero = F.lit(0.0)
    field = lambda name: F.coalesce(F.col(f"field.{name}"), zero)
    device = lambda name: F.coalesce(F.col(f"near.{name}"), zero)
    evidence = 1 - (1 - F.col("gauge")) * (1 - F.col("water"))
    multiplier = scoring.flood_multiplier(F.col("near.elevation_m"), F.col("local_low"), F.col("near.qpf_inches"), evidence)
    base = {name: F.greatest(field(name), device(name)) for name in ("wind", "heat", "cold", "winter", "convective")}
    base |= {"air": field("air"), "radiation": field("radiation"), "precip": F.least(F.lit(1.0), F.greatest(field("qpf_flood"), device("precip")) * multiplier)}
    family = families.alert_family(F.col("event"))
    severe = F.when(F.col("severity") >= 0.88, F.lit("closure"))
    alert = F.coalesce(family, F.when(F.col("event").isNotNull(), severe))
    raised = []
    for name in (*families.PRIMARY, *families.SECONDARY):
        live = F.coalesce(F.try_element_at("live", F.lit(name)), zero)
        warned = F.when(alert == name, F.coalesce("severity", zero)).otherwise(0.0)
        closed = F.col("closure") if name == "closure" else zero
        raised.append((name, F.greatest(base.get(name, zero), live, warned, closed)))
    named = samples.withColumns({f"_{name}": value for name, value in raised})
    risk = _combined([(name, F.col(f"_{name}")) for name, _ in raised])
    return named.withColumn("risk", risk).drop(*(f"_{name}" for name, _ in raised))


def summary(blended: DataFrame, path: list[str]) -> DataFrame:
    """A route's mean and peak risk, the share of samples at risk, exposure, and whether live feeds were unchecked anywhere."""
    return blended.groupBy(*path).agg(
        F.avg("risk").alias("mean"), F.max("risk").alias("peak"), F.avg((F.col("risk") > 0).cast("double")).alias("coverage"),
        F.sum(F.coalesce("field.environmental", F.lit(0.0))).alias("exposure"), F.bool_or(F.col("live").isNull()).alias("unchecked"),
    )
