"""Open places of a country by kind: a place's labels and state, cleaned, as one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of places by what their labels hold (any of the first, none of the second), in order; labels that end in an
# airport; and the states of the country by code and by name.
KINDS = (
    (7, ("truck stop", "rest area"), ()),
    (0, ("fuel station", "gas station", "filling station", "electric vehicle charging", "charging station"), ()),
    (4, ("hospital", "urgent care", "emergency room", "pharmacy", "drugstore"), ("veterinar", "animal hospital")),
    (3, ("> lodging",), ()),
    (3, ("hotel", "motel"), ("hotel bar",)),
    (6, ("rail station", "train station", "metro station", "tram station", "bus station", "marine terminal"), ()),
    (1, ("dining and drinking",), ()),
    (2, ("retail",), ()),
    (5, ("arts and entertainment", "landmarks and outdoors"), ("states and municipalities",)),
)
AIRPORT_KIND, AIRPORT = 6, "> (International Airport|Private Airport|Airport|Airport Terminal)$"
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID",
    "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN",
    "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC",
    "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX",
    "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY", "DISTRICT OF COLUMBIA": "DC", "WASHINGTON DC": "DC",
    "WASHINGTON D.C.": "DC", "PUERTO RICO": "PR", "GUAM": "GU", "U.S. VIRGIN ISLANDS": "VI", "US VIRGIN ISLANDS": "VI", "VIRGIN ISLANDS": "VI", "AMERICAN SAMOA": "AS", "NORTHERN MARIANA ISLANDS": "MP",
}


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\t\\n\\r]+", " "))


def kind(labels: Column) -> Column:
    """The number of the first kind that a place's labels (array<string>) fit, null for none."""
    joined = F.lower(F.coalesce(F.array_join(labels, " | "), F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(joined, w)) if words else F.lit(False)
    found = F.lit(None).cast("int")
    for number, words, without in reversed(KINDS):
        fits = has(words) & ~has(without)
        if number == AIRPORT_KIND:
            fits = fits | F.exists(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.coalesce(x.rlike(AIRPORT), F.lit(False)))
        found = F.when(fits, number).otherwise(found)
    return found


def state(region: Column) -> Column:
    """The two-letter code of a state given by code or name, null for others."""
    upper = F.upper(F.trim(F.coalesce(region, F.lit(""))))
    codes = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))
    return F.when(upper.isin(*sorted(set(STATES.values()))), upper).otherwise(F.element_at(codes, upper))


def select(raw: DataFrame, country: str = "US") -> DataFrame:
    """(grp, latitude, longitude, name, street, city, st, postcode, website, tel, category_label) of the open places of a country
    with a name, a real place, a kind and a state. The filters stand on columns of the file, so they reach its scan."""
    open_ = (F.col("country") == country) & F.col("date_closed").isNull() & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & (F.trim("name") != "")
    df = raw.where(open_).withColumns({"grp": kind(F.col("fsq_category_labels")), "st": state(F.col("region"))}).where(F.col("grp").isNotNull() & F.col("st").isNotNull())
    texts = {"name": "name", "address": "street", "locality": "city", "postcode": "postcode", "website": "website", "tel": "tel"}
    cleaned = [clean(F.col(old)).alias(new) for old, new in texts.items()]
    return df.select("grp", "latitude", "longitude", *cleaned[:3], "st", *cleaned[3:], clean(F.get("fsq_category_labels", F.lit(0))).alias("category_label"))
