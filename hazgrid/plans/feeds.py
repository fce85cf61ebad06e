"""Feed queries: lines of an order are written as one feed file, which the reader then reads; the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazgrid.plans.points import table
from hazgrid.sources import feeds

KEY = ("l_orderkey",)


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), F.col("l_quantity").alias("q"), (25 + F.col("l_partkey") % 97 / 4).alias("y"), (-100 + F.col("l_partkey") % 89 / 8).alias("x"))


def _json(spark, sf, column, entry, where=None):
    """A row an order: its lines (seven at most) as entries of one collection."""
    li = _lines(spark, sf) if where is None else _lines(spark, sf).where(where)
    return li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias(column))).alias("value"))


def _text(spark, sf, before, entry, after):
    li = _lines(spark, sf).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "k", "q", entry.alias("e")))), lambda s: s["e"]), "\n").alias("v"))
    return li.select("l_orderkey", F.concat(F.lit(before), "v", F.lit(after)).alias("value"))


def feed_quakes(spark, sf):
    entry = F.struct(F.struct(F.when(F.col("k") % 5 != 0, F.col("q") / 8).alias("mag"), (F.col("n") * 3_600_000.0).alias("time")).alias("properties"), F.struct(F.array("x", "y", F.lit(10.0)).alias("coordinates")).alias("geometry"))
    return feeds.quakes(_json(spark, sf, "features", entry), F.lit(36_000.0), KEY)


def feed_gauges(spark, sf):
    entry = F.struct(F.col("y").alias("latitude"), F.col("x").alias("longitude"), F.struct(F.when(F.col("k") % 3 != 0, F.struct(F.lit("minor").alias("floodCategory"))).alias("observed")).alias("status"))
    return feeds.gauges(_json(spark, sf, "gauges", entry), KEY)


def feed_storms(spark, sf):
    entry = F.struct(F.when(F.col("k") % 7 != 0, F.col("y")).alias("latitudeNumeric"), F.col("x").alias("longitudeNumeric"), F.when(F.col("k") % 2 == 0, F.col("q").cast("string")).alias("intensity"))
    return feeds.storms(_json(spark, sf, "activeStorms", entry), KEY)


def feed_closures(spark, sf):
    k = F.col("k")
    line = F.when(k % 3 == 0, F.to_json(F.array("x", "y"))).otherwise(F.to_json(F.array(F.array("x", "y"), F.array(F.col("x") + 1, F.col("y")), F.array(F.col("x") + 2, F.col("y")))))
    kind, impact = F.when(k % 3 == 0, "Point").when(k % 3 == 1, "LineString").otherwise("MultiPoint"), F.when(k % 2 == 0, "All-Lanes-Closed").otherwise("some-lanes-closed")
    entry = F.format_string('{"properties":{"vehicle_impact":"%s","core_details":{"direction":"%s"}},"geometry":{"type":"%s","coordinates":%s}}', impact, F.when(k % 5 == 0, "Northbound").otherwise("both"), kind, line)
    files = _lines(spark, sf).groupBy("l_orderkey").agg(F.concat(F.lit('{"features":['), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("]}")).alias("value"))
    roads = feeds.closures(files, KEY)
    return roads.select("l_orderkey", F.size("line").alias("points"), F.get("line", F.lit(0))["x"].alias("x"), F.element_at("line", -1)["x"].alias("x_end"), "directed")


def feed_perimeters(spark, sf):
    k = F.col("k")
    ring = F.array(F.array("x", "y"), F.array(F.col("x") + 1, F.col("y")), F.array("x", F.col("y") + 1))
    shape = F.when(k % 2 == 0, F.to_json(F.array(ring))).otherwise(F.to_json(F.array(F.array(ring), F.array(ring))))
    entry = F.format_string('{"geometry":{"type":"%s","coordinates":%s}}', F.when(k % 2 == 0, "Polygon").otherwise("MultiPolygon"), shape)
    files = _lines(spark, sf).groupBy("l_orderkey").agg(F.concat(F.lit('{"features":['), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("]}")).alias("value"))
    return feeds.perimeters(files, KEY).select("l_orderkey", F.get("ring", F.lit(0))["x"].alias("x"), F.get("ring", F.lit(0))["y"].alias("y"), F.size("ring").alias("corners"))


def feed_hotspots(spark, sf):
    entry = F.format_string(" %s, %s,2024,1200,sat,x,y,%s", F.col("x").cast("string"), F.col("y").cast("string"), F.when(F.col("k") % 4 != 0, F.col("q").cast("string")).otherwise("n/a"))
    return feeds.hotspots(_text(spark, sf, "lon,lat,yearday,time,satellite,method,ecosystem,frp\n", entry, "\n1,2\n"), KEY)


def feed_tsunamis(spark, sf):
    k = F.col("k")
    title = F.get(F.array(*map(F.lit, ("Tsunami Warning", "TSUNAMI ADVISORY", "tsunami watch", "information", "Tsunami Warning CANCELLED"))), (k % 5).cast("int"))
    entry = F.format_string("<entry><title>%s</title><geo:lat> %s </geo:lat><geo:long>%s</geo:long></entry>", title, F.col("y").cast("string"), F.col("x").cast("string"))
    return feeds.tsunamis(_text(spark, sf, "<feed>", entry, "</feed>"), KEY)


def feed_space_weather(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_custkey")
    text = F.format_string('{"0":{"R":{"Scale":"%d"},"S":{"Scale":%s},"G":{"Scale":"%d"}},"1":{}}', k % 6, F.when(k % 3 == 0, "null").otherwise('"2"'), k % 4)
    return feeds.space_weather(o.select("o_orderkey", F.when(k % 11 != 0, text).otherwise("not json").alias("value")), ("o_orderkey",))


def feed_current_hour(spark, sf):
    files = _lines(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "q"))).alias("s"))
    text = F.to_json(F.struct(F.struct(F.transform("s", lambda s: s["n"].cast("string")).alias("time"), F.transform("s", lambda s: s["q"]).alias("us_aqi")).alias("hourly")))
    return feeds.current_hour(files.select("l_orderkey", text.alias("value")), ("us_aqi", "uv_index"), F.col("l_orderkey") % 5, KEY)


def feed_cap(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_custkey")
    status, kind = F.when(k % 4 == 0, "Test").otherwise("Actual"), F.when(k % 5 == 0, "Cancel").otherwise("Alert")
    text = F.format_string(
        "<cap:alert><cap:identifier>id%d</cap:identifier><cap:status>%s</cap:status><cap:msgType>%s</cap:msgType><cap:references>a,old%d,t b,older%d,t</cap:references><cap:info><cap:event>%s</cap:event>"
        "<cap:description> text %d </cap:description><cap:onset>2024</cap:onset><cap:area><cap:polygon>1.5,2 3,4 %s 1.5,2</cap:polygon><cap:polygon>1,2 3,4</cap:polygon></cap:area></cap:info></cap:alert>",
        k, status, kind, k, k + 1, F.when(k % 3 == 0, "").otherwise("Flood"), k, F.when(k % 7 == 0, "5,x").otherwise("5,6"),
    )
    a = feeds.cap_alerts(o.select("o_orderkey", F.when(k % 9 != 0, text).otherwise("<html/>").alias("value")), ("o_orderkey",))
    return a.select("o_orderkey", "event", "severity", F.size("rings").alias("rings"), "effective", "description", "is_live", "identifier", F.array_join("references", " ").alias("refs"))


def feed_fuel_prices(spark, sf):
    entry = F.format_string('<place place_id="%d"><gas_price type="regular">%s</gas_price><gas_price type="premium">%s</gas_price></place>', F.col("n"), F.col("q").cast("string"), F.when(F.col("k") % 2 == 0, (F.col("q") + 1).cast("string")).otherwise("-"))
    return feeds.fuel_prices(_text(spark, sf, "<places>", entry, "</places>"), KEY)


def feed_fuel_places(spark, sf):
    entry = F.format_string('<place place_id="%d"><location><x>%s</x><y>%s</y></location></place>', F.col("n"), F.col("x").cast("string"), F.col("y").cast("string"))
    return feeds.fuel_places(_text(spark, sf, "<places>", entry, "</places>"), KEY)


def feed_first_answer(spark, sf):
    """Suppliers of a part as providers of its temperature and wind; every third says nothing."""
    li = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("q"))
    says = F.col("l_suppkey") % 3 != 0
    return feeds.first_answer(li.select("l_partkey", "l_suppkey", F.when(says, F.col("q")).alias("temperature"), F.when(says & (F.col("l_suppkey") % 2 == 0), F.col("q") / 2).alias("wind")), ["l_partkey"], "l_suppkey", "temperature", "wind")


def feed_alert_lengths(spark, sf):
    k = F.col("k")
    stamp = lambda h: F.date_format(F.timestamp_seconds(1_700_000_000 + h * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    props = F.struct(
        F.format_string("id%d", k).alias("id"), F.lit("Flood Watch").alias("event"), F.when(k % 9 == 0, "Cancel").otherwise("Alert").alias("messageType"), stamp(F.col("n") + F.col("q")).alias("ends"), F.when(k % 2 == 0, stamp(F.col("n"))).alias("onset"),
        stamp(F.col("n") + 1).alias("sent"), F.struct(F.when(k % 4 == 0, F.array(F.format_string("/O.%s.KMKX.FL.W.%04d.000000T0000Z-250101T0000Z/", F.when(k % 8 == 0, "NEW").otherwise("CON"), k % 50))).alias("VTEC")).alias("parameters"),
    )
    a = feeds.alert_lengths(_json(spark, sf, "features", F.struct(F.lit("f").alias("id"), props.alias("properties"))), KEY)
    return a.select("l_orderkey", "key", F.round("hours", 6).alias("hours"), "opens")


_L = "v AS (SELECT l_orderkey, l_linenumber AS n, l_partkey AS k, l_quantity AS q, 25 + l_partkey % 97 / 4 AS y, -100 + l_partkey % 89 / 8 AS x FROM lineitem)"
SQL = {
    "feed_quakes": f"WITH {_L} SELECT l_orderkey, y AS ref_lat, x AS ref_lon, q / 8 AS magnitude, (10 - n)::DOUBLE AS age_hours FROM v WHERE k % 5 <> 0",
    "feed_gauges": f"WITH {_L} SELECT l_orderkey, y AS ref_lat, x AS ref_lon, 'minor' AS category FROM v WHERE k % 3 <> 0",
    "feed_storms": f"WITH {_L} SELECT l_orderkey, y AS ref_lat, x AS ref_lon, CASE WHEN k % 2 = 0 THEN q ELSE 35 END::DOUBLE AS knots FROM v WHERE k % 7 <> 0",
    "feed_closures": f"WITH {_L} SELECT l_orderkey, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END::INTEGER AS points, x, CASE WHEN k % 3 = 0 THEN x ELSE x + 2 END AS x_end, k % 5 = 0 AS directed FROM v WHERE k % 2 = 0",
    "feed_perimeters": f"WITH {_L} SELECT l_orderkey, x, y, 3::INTEGER AS corners FROM v UNION ALL SELECT l_orderkey, x, y, 3 FROM v WHERE k % 2 <> 0",
    "feed_hotspots": f"WITH {_L} SELECT l_orderkey, y AS ref_lat, x AS ref_lon, q::DOUBLE AS frp FROM v WHERE k % 4 <> 0",
    "feed_tsunamis": f"WITH {_L} SELECT l_orderkey, y AS ref_lat, x AS ref_lon, ['warning', 'advisory', 'watch'][k % 5 + 1] AS level FROM v WHERE k % 5 < 3",
    "feed_space_weather": "SELECT o_orderkey, (o_custkey % 6)::INTEGER AS r, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 2 END::INTEGER AS s, (o_custkey % 4)::INTEGER AS g FROM orders WHERE o_custkey % 11 <> 0",
    "feed_current_hour": f"WITH {_L}, s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, q) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM v) SELECT l_orderkey, q::DOUBLE AS us_aqi, NULL::DOUBLE AS uv_index FROM s WHERE i = least(l_orderkey % 5, m - 1)",
    "feed_cap": """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'Weather alert' ELSE 'Flood' END AS event, 'Moderate' AS severity, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE 1 END::INTEGER AS rings, '2024' AS effective, 'text ' || o_custkey AS description,
o_custkey % 4 <> 0 AND o_custkey % 5 <> 0 AS is_live, 'id' || o_custkey AS identifier, 'old' || o_custkey || ' older' || (o_custkey + 1) AS refs FROM orders WHERE o_custkey % 9 <> 0""",
    "feed_fuel_prices": f"""WITH {_L}, p AS (SELECT l_orderkey, n::VARCHAR AS place, n, k, q, 'regular' AS kind, q AS price FROM v UNION ALL SELECT l_orderkey, n::VARCHAR, n, k, q, 'premium', q + 1 FROM v WHERE k % 2 = 0)
SELECT l_orderkey, place, kind, price::DOUBLE AS price FROM p QUALIFY row_number() OVER (PARTITION BY l_orderkey, place, kind ORDER BY k DESC, q DESC) = 1""",
    "feed_fuel_places": f"WITH {_L} SELECT l_orderkey, n::VARCHAR AS place, y AS ref_lat, x AS ref_lon FROM v WHERE y > 13 AND y < 34",
    "feed_first_answer": """WITH a AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS q FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY ALL) SELECT l_partkey, q::DOUBLE AS temperature, CASE WHEN l_suppkey % 2 = 0 THEN q / 2 END::DOUBLE AS wind FROM a
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) = 1""",
    "feed_alert_lengths": f"""WITH {_L} SELECT l_orderkey, CASE WHEN k % 4 = 0 THEN 'KMKX.FL.W.' || lpad((k % 50)::VARCHAR, 4, '0') ELSE 'id' || k END AS key, round(CASE WHEN k % 2 = 0 THEN q ELSE q - 1 END, 6)::DOUBLE AS hours, CASE WHEN k % 4 = 0 THEN k % 8 = 0 ELSE true END AS opens
FROM v WHERE k % 9 <> 0 AND CASE WHEN k % 2 = 0 THEN q ELSE q - 1 END BETWEEN 0.1 AND 720""",
}
QUERIES = {name: globals()[name] for name in SQL}
