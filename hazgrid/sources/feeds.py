"""Live feeds as rows: each function takes files as texts (a column ``value`` a file, as ``texts`` reads them) and gives the
feed's rows. A file that doesn't parse, and an entry without what it needs, has no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows (value, file): a feed's answers are a few megabytes each."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def _features(files: DataFrame, schema: str, column: str = "features", keep: tuple[str, ...] = ()) -> DataFrame:
    """The structs of an array in each file, as the column f."""
    parsed = F.from_json("value", f"{column} array<struct<{schema}>>")
    return files.select(*keep, F.explode(parsed[column]).alias("f"))


def _needed(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def quakes(files: DataFrame, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """ref_lat, ref_lon, magnitude and age in hours at ``now`` (seconds) of a collection of earthquakes."""
    f = _features(files, "properties:struct<mag:double,time:double>,geometry:struct<coordinates:array<double>>", keep=keep)
    at = lambda i: F.get("f.geometry.coordinates", F.lit(i))
    rows = f.select(*keep, at(1).alias("ref_lat"), at(0).alias("ref_lon"), F.col("f.properties.mag").alias("magnitude"), ((now * 1000 - F.col("f.properties.time")) / 3_600_000).alias("age_hours"))
    return _needed(rows, "ref_lat", "ref_lon", "magnitude", "age_hours")


def gauges(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """ref_lat, ref_lon and flood category of river gauges."""
    f = _features(files, "latitude:double,longitude:double,status:struct<observed:struct<floodCategory:string>>", "gauges", keep)
    return _needed(f.select(*keep, F.col("f.latitude").alias("ref_lat"), F.col("f.longitude").alias("ref_lon"), F.col("f.status.observed.floodCategory").alias("category")), "ref_lat", "ref_lon", "category")


def storms(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """ref_lat, ref_lon and knots of active tropical storms; 35 where the wind isn't given."""
    f = _features(files, "latitudeNumeric:double,longitudeNumeric:double,intensity:string", "activeStorms", keep)
    rows = f.select(*keep, F.col("f.latitudeNumeric").alias("ref_lat"), F.col("f.longitudeNumeric").alias("ref_lon"), F.coalesce(F.col("f.intensity").try_cast("double"), F.lit(35.0)).alias("knots"))
    return _needed(rows, "ref_lat", "ref_lon")


def volcanoes(files: DataFrame, places: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Places (name in lower case, ref_lat, ref_lon) of elevated volcanoes with their level."""
    parsed = F.from_json("value", "array<struct<volcano_name:string,alert_level:string>>")
    rows = files.select(*keep, F.explode(parsed).alias("v")).select(*keep, F.lower("v.volcano_name").alias("name"), F.col("v.alert_level").alias("level"))
    return _needed(rows, "level").join(places, "name")


def space_weather(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The present scales r, s and g; 0 where one isn't a whole number."""
    scale = "struct<Scale:string>"
    now = F.from_json("value", f"`0` struct<R:{scale},S:{scale},G:{scale}>")["0"]
    value = lambda k: F.coalesce(now[k]["Scale"].try_cast("int"), F.lit(0)).alias(k.lower())
    return files.where(now.isNotNull()).select(*keep, value("R"), value("S"), value("G"))


def hotspots(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """ref_lat, ref_lon and power of fires, from lines of comma-separated values under a header line."""
    lines = files.select(*keep, F.explode(F.slice(F.split("value", "\n"), 2, 10_000_000)).alias("line")).withColumn("c", F.transform(F.split("line", ","), lambda x: F.trim(x)))
    value = lambda i: F.get("c", F.lit(i)).try_cast("double")
    return _needed(lines.where(F.size("c") >= 8).select(*keep, value(1).alias("ref_lat"), value(0).alias("ref_lon"), value(7).alias("frp")), "ref_lat", "ref_lon", "frp")


def _ring(points: Column) -> Column:
    return F.transform(F.filter(points, lambda p: F.size(p) >= 2), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def perimeters(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The outer ring of each polygon of a collection, of simple and of multiple ones."""
    shape = F.from_json("value", "features array<struct<geometry:struct<type:string,coordinates:string>>>")
    g = files.select(*keep, F.explode(shape["features"]).alias("f")).select(*keep, F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    one = F.from_json(F.concat(F.lit('{"c":'), "c", F.lit("}")), "c array<array<array<double>>>")["c"]
    many = F.from_json(F.concat(F.lit('{"c":'), "c", F.lit("}")), "c array<array<array<array<double>>>>")["c"]
    polygons = F.when(F.col("type") == "Polygon", F.array(one)).when(F.col("type") == "MultiPolygon", many)
    return g.select(*keep, F.explode(polygons).alias("p")).where(F.size("p") > 0).select(*keep, _ring(F.get("p", F.lit(0))).alias("ring"))


def closures(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Roads with all lanes closed: their line (array of struct(x, y)) and whether one direction only is meant. Of several
    loose points the first and the last count."""
    inner = "vehicle_impact:string,direction:string,core_details:struct<direction:string>"
    f = _features(files, f"properties:struct<{inner}>,geometry:struct<type:string,coordinates:string>", keep=keep)
    f = f.where(F.lower("f.properties.vehicle_impact") == "all-lanes-closed")
    text = F.concat(F.lit('{"c":'), F.col("f.geometry.coordinates"), F.lit("}"))
    single = F.from_json(text, "c array<double>")["c"]
    line = F.coalesce(F.when(F.col("f.geometry.coordinates").rlike(r"^\s*\[\s*\["), _ring(F.slice(F.from_json(text, "c array<array<double>>")["c"], 1, 5_000))), F.when(F.size(single) >= 2, F.array(F.struct(single[0].alias("x"), single[1].alias("y")))))
    way = F.lower(F.coalesce("f.properties.core_details.direction", "f.properties.direction", F.lit("")))
    rows = f.select(*keep, F.col("f.geometry.type").alias("type"), line.alias("line"), way.isin("northbound", "southbound", "eastbound", "westbound", "inner-loop", "outer-loop").alias("directed"))
    ends = F.array(F.get("line", F.lit(0)), F.element_at("line", -1))
    return rows.where(F.size("line") > 0).select(*keep, F.when((F.col("type") == "MultiPoint") & (F.size("line") > 2), ends).otherwise(F.col("line")).alias("line"), "directed")


def closure_points(roads: DataFrame) -> DataFrame:
    """The first and, of more than two, the middle point of each road, each place once."""
    n = F.size("line")
    points = F.array_compact(F.array(F.get("line", F.lit(0)), F.when(n > 2, F.get("line", F.floor(n / 2).cast("int")))))
    return roads.select(F.explode(points).alias("p")).select(F.col("p.y").alias("ref_lat"), F.col("p.x").alias("ref_lon")).distinct()


def current_hour(files: DataFrame, fields: tuple[str, ...], hour: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """The values of ``fields`` at an hour of an hourly series, the last one where the series is shorter."""
    h = F.from_json("value", "hourly struct<time:array<string>," + ",".join(f"{f}:array<double>" for f in fields) + ">")["hourly"]

    def at(field: str) -> Column:
        i = F.least(F.greatest(hour, F.lit(0)), F.size(h[field]) - 1, F.size(h["time"]) - 1).cast("int")
        v = F.when(i >= 0, F.get(h[field], i))
        return F.when(~F.isnan(v), v).alias(field)

    return files.select(*keep, *(at(f) for f in fields))


def _tag(xml: Column, name: str) -> Column:
    found = F.trim(F.regexp_extract(xml, rf"(?s)<{name}(?: [^>]*)?>(.*?)</{name}>", 1))
    return F.when(F.length(found) > 0, found)


def _blocks(xml: Column, name: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{name}(?: [^>]*)?>(.*?)</{name}>"), F.lit(1))


def tsunamis(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """ref_lat, ref_lon and level of the entries of an Atom feed that are threats and not cancelled."""
    e = files.select(*keep, F.explode(_blocks(F.col("value"), "entry")).alias("e")).withColumn("l", F.lower("e"))
    level = F.when(F.col("l").contains("tsunami warning"), "warning").when(F.col("l").contains("tsunami advisory"), "advisory").when(F.col("l").contains("tsunami watch"), "watch")
    rows = e.where(~F.col("l").contains("cancel")).select(*keep, _tag(F.col("e"), "geo:lat").try_cast("double").alias("ref_lat"), _tag(F.col("e"), "geo:long").try_cast("double").alias("ref_lon"), level.alias("level"))
    return _needed(rows, "ref_lat", "ref_lon", "level")


def cap_alerts(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One alert a file of the Common Alerting Protocol, with or without its prefix: event, severity, rings, area, expires,
    effective, web, description (280 characters), is_live, identifier and references (identifiers of older messages)."""
    x = F.regexp_replace("value", "(</?)cap:", "$1")
    docs = files.where(x.contains("<alert")).select(*keep, x.alias("x"))
    t = lambda name: _tag(F.col("x"), name)
    pair = lambda p: F.split(p, ",")
    points = lambda raw: F.transform(F.split(F.trim(raw), r"\s+"), lambda p: F.when(F.size(pair(p)) == 2, F.struct(pair(p)[1].try_cast("double").alias("x"), pair(p)[0].try_cast("double").alias("y"))))
    rings = F.filter(F.transform(_blocks(F.col("x"), "polygon"), points), lambda r: (F.size(r) >= 3) & F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    live = F.coalesce(F.lower(t("status")) == "actual", F.lit(True)) & F.coalesce(F.lower(t("msgType")) != "cancel", F.lit(True)) & F.coalesce(F.lower(t("responseType")) != "allclear", F.lit(True))
    references = F.array_compact(F.transform(F.split(F.coalesce(t("references"), F.lit("")), r"\s+"), lambda r: F.get(F.split(r, ","), F.lit(1))))
    return docs.select(
        *keep, F.coalesce(t("event"), F.lit("Weather alert")).alias("event"), F.coalesce(t("severity"), F.lit("Moderate")).alias("severity"), rings.alias("rings"), t("areaDesc").alias("area"), t("expires").alias("expires"),
        F.coalesce(t("effective"), t("onset")).alias("effective"), t("web").alias("web"), F.substring(t("description"), 1, 280).alias("description"), live.alias("is_live"), t("identifier").alias("identifier"), references.alias("references"),
    )


def fuel_prices(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(place, kind, price) of the stations of a price file; of several prices of a kind the last counts."""
    whole = F.regexp_extract_all("value", F.lit(r'(?s)<place place_id="[^"]*".*?</place>'), F.lit(0))
    places = files.select(*keep, F.posexplode(whole).alias("n", "p")).withColumn("place", F.regexp_extract("p", '<place place_id="([^"]*)"', 1))
    price = F.posexplode(F.regexp_extract_all("p", F.lit(r'<gas_price type="[^"]*"[^>]*>[^<]*<'), F.lit(0))).alias("i", "g")
    rows = places.select(*keep, "place", "n", price).select(*keep, "place", "n", "i", F.regexp_extract("g", 'type="([^"]*)"', 1).alias("kind"), F.regexp_extract("g", ">([^<]*)<", 1).try_cast("double").alias("price"))
    return rows.where("price is not null").groupBy(*keep, "place", "kind").agg(F.max_by("price", F.struct("n", "i")).alias("price"))


def fuel_places(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(place, ref_lat, ref_lon) of the stations of a places file, within the country's latitudes."""
    whole = F.regexp_extract_all("value", F.lit(r'(?s)<place place_id="[^"]*".*?</place>'), F.lit(0))
    p = files.select(*keep, F.explode(whole).alias("p"))
    rows = p.select(*keep, F.regexp_extract("p", '<place place_id="([^"]*)"', 1).alias("place"), _tag(F.col("p"), "y").try_cast("double").alias("ref_lat"), _tag(F.col("p"), "x").try_cast("double").alias("ref_lon"))
    return _needed(rows.where((F.col("ref_lat") > 13) & (F.col("ref_lat") < 34)), "ref_lon")


def first_answer(answers: DataFrame, keys: list[str], rank: str, *values: str) -> DataFrame:
    """Of several providers' answers for one place, the first by ``rank`` that says anything."""
    some = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])
    best = answers.where(some).groupBy(*keys).agg(F.min(F.struct(rank, *values)).alias("b"))
    return best.select(*keys, *(F.col(f"b.{v}").alias(v) for v in values))


def alert_lengths(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, event, hours, ends, opens) of alerts that say when they end: hours from the first of onset, effective and sent. Parts
    of the code of an event make its key, else the alert's id. Cancelled alerts and lengths under 0.1 or over 720 hours don't count."""
    props = "id:string,event:string,headline:string,messageType:string,ends:string,onset:string,effective:string,sent:string,parameters:struct<VTEC:array<string>>"
    f = _features(files, f"id:string,properties:struct<{props}>", keep=keep).select(*keep, F.col("f.id").alias("fid"), "f.properties.*")
    code = F.split(F.coalesce(F.get("parameters.VTEC", F.lit(0)), F.lit("")), "\\.")
    coded = F.size(code) >= 7
    time = lambda c: F.try_to_timestamp(F.col(c))
    begin = F.coalesce(time("onset"), time("effective"), time("sent"))
    hours = (F.unix_micros(time("ends")) - F.unix_micros(begin)) / 3.6e9
    key = F.when(coded, F.array_join(F.slice(code, 3, 4), ".")).otherwise(F.coalesce("id", "fid"))
    opens = F.when(coded, (F.get(code, F.lit(1)) == "NEW") | ~F.startswith(F.get(code, F.lit(6)), F.lit("000000T0000Z"))).otherwise(F.coalesce(F.lower("messageType") == "alert", F.lit(False)))
    rows = f.select(*keep, key.alias("key"), F.coalesce("event", "headline").alias("event"), hours.alias("hours"), time("ends").alias("ends"), opens.alias("opens"), F.coalesce(F.lower("messageType"), F.lit("")).alias("kind"))
    return rows.where((F.col("kind") != "cancel") & (F.col("event") != "") & F.col("key").isNotNull() & F.col("hours").between(0.1, 720.0)).drop("kind")
