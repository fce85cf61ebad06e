import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazgrid.functions.binary import OFFSET, PRIME, fnv1a64
from hazgrid.operators import climatology, head


def test_history_from_events(spark):
    zips = spark.createDataFrame([("53703", 43.07, -89.38), ("53704", 43.12, -89.35), ("60601", 41.88, -87.62)], "zip string, lat double, lon double")
    relations = spark.createDataFrame([("53703", "55025"), ("53704", "55025"), ("60601", "17031")], "zip string, county string")
    storms = spark.createDataFrame(
        [(1, 202405, 3, "Hail", 2.5, 43.08, -89.38, 55, 25), (2, 202405, 4, "Flood", None, None, None, 55, 25), (3, 202402, 31, "Hail", 1.0, 43.0, -89.0, 55, 25), (4, 202401, 1, "Hurricane", None, 0.0, 0.0, 17, 31), (5, 202401, 1, "Rip Current", None, None, None, 17, 31)],
        "id long, BEGIN_YEARMONTH int, BEGIN_DAY int, EVENT_TYPE string, MAGNITUDE double, BEGIN_LAT double, BEGIN_LON double, STATE_FIPS int, CZ_FIPS int",
    )
    got = {(r.zip, r.week, r.family): r.n for r in climatology.build_history(storms, zips, relations).collect()}
    assert got == {("53703", 17, "convective"): 1.5, ("53703", 17, "qpf_flood"): 0.5, ("53704", 17, "qpf_flood"): 0.5, ("60601", 0, "wind"): 1.0, ("60601", 0, "qpf_flood"): 1.0, ("53704", 8, "convective"): 1.0}
    field = climatology.national_field(climatology.build_history(storms, zips, relations))
    assert field.count() == 6 and field.where("mean <= 0").count() == 0
    assert climatology.build_history(storms.limit(0), zips, relations).count() == 0


def test_heads_learn_and_predict_alike(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    y = 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))
    rows = spark.createDataFrame([(1, a.tolist(), float(b), 1.0) for a, b in zip(x, y)], "k long, x array<double>, y double, weight double")
    heads = head.train_heads(rows, "k", epochs=300)
    theta = np.array(heads.first().theta)
    n = head.FEATURES * head.HIDDEN
    _, p = head.forward(theta[:n].reshape(8, 16), theta[n : n + 16], theta[n + 16 : n + 32], theta[-1], x)
    assert ((p - y) ** 2).mean() < 0.003
    got = {tuple(r.x): r.p for r in rows.join(heads, "k").select("x", head.predict(F.col("theta"), F.col("x")).alias("p")).collect()}
    assert all(got[tuple(a.tolist())] == pytest.approx(b) for a, b in zip(x, p))


def test_fnv1a(spark):
    rng = random.Random(1)
    values = [None, b"", b"a", b"foobar", *(rng.randbytes(rng.randint(0, 300)) for _ in range(40))]

    def plain(data):
        h = OFFSET
        for b in data:
            h = (h ^ b) * PRIME % 2**64
        return h.to_bytes(8, "big")

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v binary")
    for r in df.select("i", fnv1a64("v").alias("h")).collect():
        assert (None if r.h is None else bytes(r.h)) == (None if values[r.i] is None else plain(values[r.i]))
    assert plain(b"foobar").hex() == "85944171f73967e8"


def test_reference_tables(spark, tmp_path):
    from hazgrid.sources import readers

    (tmp_path / "zones.txt").write_text("WI|7|x|x|x|x|55025\nWI|061|x|x|x|x|55025|more\nbad|1|x|x|x|x|55025\nWI|8|x|x|x|x|1\nshort|line\n")
    zones = readers.zone_counties(spark, str(tmp_path / "zones.txt"))
    assert {tuple(r) for r in zones.collect()} == {("WI", "007", "55025"), ("WI", "061", "55025")}
    zips = spark.createDataFrame([("53703", "55025"), ("53703", "55025"), ("53704", "55025")], "zip string, county string")
    assert readers.zone_zips(zones, zips).count() == 4
    counties = spark.createDataFrame([("55", "DANE", "55025"), ("55", "ST. CROIX", "55109"), ("55", "POLK", "55095"), ("27", "DANE", "1")], "state string, name string, county string")
    named = spark.createDataFrame([("55", "DANE"), ("55", "SOUTHERN DANE AND POLK"), ("55", "ST. CROIX VALLEY"), ("55", "DANEVILLE")], "state string, zone_name string")
    assert {(r.zone_name, r.county) for r in readers.zones_by_name(named, counties).collect()} == {("DANE", "55025"), ("SOUTHERN DANE AND POLK", "55025"), ("SOUTHERN DANE AND POLK", "55095"), ("ST. CROIX VALLEY", "55109")}

    (tmp_path / "airports.csv").write_text("iata_code,type,name,latitude_deg,longitude_deg,iso_country,iso_region,municipality,scheduled_service\nmsn,medium_airport,Dane,43.1,-89.3,US,US-WI,Madison,yes\nXXX,heliport,H,1,1,US,US-WI,M,yes\nLHR,large_airport,L,51,0,GB,GB-E,London,yes\nMKE,large_airport,M,95,0,US,US-WI,M,yes\n")
    assert [tuple(r) for r in readers.airports(spark, str(tmp_path / "airports.csv")).collect()] == [("MSN", "Dane", "Madison", "US", "US-WI", 43.1, -89.3, "medium")]

    head = "id,data_type,location.country_code,provider,urls.direct_download,urls.latest,urls.authentication_type,status,redirect.id," + ",".join(f"location.bounding_box.{m}_{d}" for d in ("latitude", "longitude") for m in ("minimum", "maximum"))
    rows = ["12,gtfs,us,A,https://a,,,,,43,44,-90,-89", "x,gtfs-rt,US,B,https://b,,,,,1,2,1,2", "y,gtfs,US,C,,,0,,,1,2,1,2", "z,gtfs,CA,D,,http://d,1,,,1,2,1,2", "w,gtfs,MX,E,,http://e,,deprecated,,1,2,1,2", "v,gtfs,MX,F,,http://f,,,,1,,1,2", "u,gtfs,MX,G,,http://g,,,,2,1,1,2"]
    (tmp_path / "catalog.csv").write_text("\n".join([head, *rows]) + "\n")
    got = {r.provider: (r.id, r.url, r.dropped) for r in readers.transit_catalog(spark, str(tmp_path / "catalog.csv")).collect()}
    assert got["A"] == ("mdb-12", "https://a", None)
    assert {k: v[2] for k, v in got.items() if k != "A"} == {"B": "not static", "C": "no link", "D": "needs a key", "E": "deprecated", "F": "no box", "G": "unusable box"}

    (tmp_path / "rows.csv").write_text("oLat,oLon\n1,2,3,4,5,1.5,-2,1\n1,2,3,4,5,0.5,2\n1,2,3,4,5,NaN,2,0\n1,2,x,3,4,5,0.25,2,0\n")
    assert [tuple(r) for r in readers.training_rows(spark, str(tmp_path / "rows.csv")).orderBy("target").collect()] == [(1.0, 2.0, 3.0, 4.0, 5.0, 0.25, 2.0, False), (1.0, 2.0, 3.0, 4.0, 5.0, 1.0, 0.0, True)]
