"""Scalar functions against known values."""

import math

import pytest
from pyspark.sql import functions as F

from starling.functions import geo
from starling.functions import text as tx


def values(frame, rows, expr, schema="x string"):
    return [r[0] for r in frame([(r,) for r in rows], schema).select(expr).collect()]


def test_zone_names(frame):
    assert values(frame, ["Indiana (East)", "Mountain Time (US & Canada)", "London", None], tx.zone_name(F.col("x"))) == ["Indiana", "Mountain_Time", "London", None]
    assert values(frame, ["Pacific Time (US & Canada)", "Eastern Time (US & Canada)", "Central Time (US & Canada)", "Paris"], tx.us_code(F.col("x"))) == ["PST", "EST", "CST", None]


def test_coordinates(frame):
    got = values(frame, ["ÜT: 50.734910,-3.533687", "50.734910 , -3.533687", "50.7349,-3.5336", "123.456789,10.123456", "10.123456,123.456789", "50.7349101,-3.533687", "50.734910,-3.53368799"], tx.coordinates(F.col("x")))
    assert [tuple(x) if x else None for x in got] == [(50.73491, -3.533687), (50.73491, -3.533687), None, (23.456789, 10.123456), None, None, (50.73491, -3.533687)]


def test_domains(frame):
    urls = ["http://foo.co.uk/", "https://x.de", "http://a.com/b.php", "x.de/page.it", "http://a.UK/", "http://bbc.co.uk:80/", ""]
    assert values(frame, urls, tx.top_level_domains(F.col("x"))) == [["uk"], ["de"], ["com", "php"], ["de", "it"], [], [], []]
    assert values(frame, ["bbc.co.uk/news/1", "youtube.com/watch?v=1", "t.co/Abc"], F.element_at(tx.domains(F.col("x")), 1)) == ["bbc.co.uk", "youtube.com", "t.co"]


def test_other_text(frame):
    assert values(frame, ["a☃b\U0001f600c"], tx.without_emoji(F.col("x"))) == ["abc"]
    assert values(frame, ["a / b//c ", "", None], tx.parts(F.col("x"), "/")) == [["a", "b", "c"], [], None]
    assert values(frame, ["http://x/a_b", "plain"], tx.last_segment(F.col("x"))) == ["a b", "plain"]
    assert values(frame, [93784], tx.uptime(F.col("x")), "x bigint") == ["1:2:03:04"]
    assert values(frame, ["Hello world", "HELLO", None], tx.tracks(F.col("x"), "hello world,foo")) == [True, False, None]
    assert values(frame, ["Ã©tÃ©", "été", "plain", None], tx.repaired(F.col("x"))) == ["été", "été", "plain", None]


def test_distances(frame):
    # one degree along the equator and along a meridian, on the sphere and the ellipsoid
    points = frame([(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0), (51.0, 0.0, 51.0, 0.0)], "a double, b double, c double, d double")
    got = points.select(geo.haversine(*map(F.col, "abcd")).alias("h"), geo.vincenty(*map(F.col, "abcd")).alias("v")).collect()
    assert got[0].h == pytest.approx(math.radians(1) * geo.RADIUS, abs=1e-6)
    assert got[0].v == pytest.approx(111.319491, abs=1e-5)
    assert got[1].v == pytest.approx(110.574389, abs=1e-5)
    assert (got[2].h, got[2].v) == (0.0, 0.0)


def test_shoot_comes_back(frame):
    rows = frame([(float(a), 53.0, -2.0) for a in range(0, 360, 30)], "a double, lat double, lon double")
    p = rows.withColumn("p", geo.shoot(F.col("lon"), F.col("lat"), F.col("a"), F.lit(25.0)))
    far = p.select(geo.vincenty(F.col("lat"), F.col("lon"), F.col("p.lat"), F.col("p.lon")).alias("km"), geo.shoot(F.col("p.lon"), F.col("p.lat"), F.col("p.back"), F.lit(25.0)).alias("q")).collect()
    for r in far:
        assert r.km == pytest.approx(25, rel=1e-5)
        assert (r.q.lat, r.q.lon) == (pytest.approx(53, abs=1e-7), pytest.approx(-2, abs=1e-7))
    assert values(frame, [90.0], geo.shoot(F.lit(0.0), F.col("x"), F.lit(1.0), F.lit(1.0)), "x double") == [None]


def test_polygons(frame):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    rows = frame([(1.0, 1.0), (2.0, 3.0), (3.9, 3.0), (5.0, 1.0)], "x double, y double")
    given = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ring])
    got = rows.select(geo.inside(F.col("x"), F.col("y"), given).alias("a"), geo.inside_fixed(F.col("x"), F.col("y"), ring).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(True, True), (False, False), (True, True), (False, False)]
    text = ["[[(1, 2), (3, 4), (5, 6)]]", "[[[(1.5, 2), (3, 4)]], [[(5, 6), (7, 8)]]]"]
    assert [len(x) for x in values(frame, text, geo.rings(F.col("x")))] == [1, 2]


def test_population_curve(frame):
    a, b = geo.curve(0.5, 200, 10, 30)
    assert values(frame, [0.01, 0.5, 1.0, 200.0, 5000.0, 0.0], geo.required(F.col("x"), a, b, 10), "x double") == [-3, 10, 13, 30, 41, 10]
    with pytest.raises(ValueError):
        geo.curve(0, 200, 10, 30)
    from starling.operators.raster import focus

    assert values(frame, [16.0, 36.0, 64.0, 100.0, 64800.0], focus(F.col("x")), "x double") == [27, 20, 15, 13, 1]


def test_vincenty_names_each_value_once(spark):
    p = spark.createDataFrame([(51.5, -0.12)], "lat double, lon double")
    text = p.select(geo.vincenty(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(2.0)))._jdf.queryExecution().analyzed().toString()
    assert text.lower().count("atan2(") <= 2
