"""The driver's tables, and the views that give them the shapes of geo-social data.

Views use integer arithmetic and the same order of double operations as their SQL twins, so both agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is, but that times without zone count as the session's (UTC by contract)."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumns({c: rows[c].cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as located messages: lat, lon, geo (null for every fifth), timestamp_ms, ts_obj (null for every seventh)."""
    h = F.col("user_id") % 8
    lat = F.lit(50.0) + (h * 37 % 50) * F.lit(0.1) + (F.col("event_id") * 7919 % 1000) * F.lit(0.00008)
    lon = F.lit(-5.0) + (h * 53 % 60) * F.lit(0.1) + (F.col("event_id") * 104729 % 1000) * F.lit(0.0001)
    rows = table(spark, sf_dir, "events").withColumns({"h": h, "lat": lat, "lon": lon})
    kind = F.when(F.col("event_id") % 11 == 0, "Polygon").otherwise("Point")
    return rows.withColumns({
        "geo": F.when(F.col("event_id") % 5 != 0, F.struct(kind.alias("type"), F.array("lat", "lon").alias("coordinates"))),
        "timestamp_ms": F.unix_millis("ts").cast("string"),
        "ts_obj": F.when(F.col("event_id") % 7 != 0, F.col("ts")),
    })


MESSAGES_SQL = """messages AS (
  SELECT *, user_id % 8 AS h,
    50.0::DOUBLE + (user_id % 8 * 37 % 50) * 0.1::DOUBLE + (event_id * 7919 % 1000) * 0.00008::DOUBLE AS lat,
    -5.0::DOUBLE + (user_id % 8 * 53 % 60) * 0.1::DOUBLE + (event_id * 104729 % 1000) * 0.0001::DOUBLE AS lon,
    event_id % 5 <> 0 AS has_geo, CASE WHEN event_id % 11 = 0 THEN 'Polygon' ELSE 'Point' END AS geo_type,
    CAST(epoch_us(ts) // 1000 AS VARCHAR) AS timestamp_ms, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts_obj
  FROM events)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who mentions whom how often, from orders and line items: ten customers write as one user (as many users as
    events have), and mention users whose numbers are up to four away."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") * 7 % 9 - 4).alias("step"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("o_custkey div 10").alias("src"))
    return items.join(orders, "l_orderkey").select("src", F.abs(F.col("src") + F.col("step")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("cnt"))


MENTIONS_SQL = """mentions AS (
  SELECT src, dst, count(*) AS cnt FROM (SELECT o_custkey // 10 AS src, abs(o_custkey // 10 + l_suppkey * 7 % 9 - 4) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  WHERE src <> dst GROUP BY ALL)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as user profiles: location text in several styles, url, time zone name, offset in seconds."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    point = F.concat(F.lit("UT: 5"), (k % 10).cast("string"), F.lit("."), F.lpad((k * 7919 % 1000000).cast("string"), 6, "0"), F.lit(",-"), (k % 5).cast("string"), F.lit("."), F.lpad((k * 104729 % 1000000).cast("string"), 6, "0"))
    zones = F.array(*map(F.lit, ZONES))
    return rows.select(
        k.alias("user_id"), n.alias("nation"), "n_name",
        F.when(k % 6 == 0, point).when(k % 6 == 1, F.col("n_name")).when(k % 6 == 2, F.concat(F.lit("nowhere / "), F.col("n_name"))).when(k % 6 == 3, F.concat("n_name", F.lit("-"), F.concat(F.lit("NATION_"), (n + 1).cast("string")))).when(k % 6 == 4, F.lit("")).alias("location"),
        F.concat(F.lit("http://site"), k.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, TLDS)), (k % len(TLDS) + 1).cast("int")), F.lit("/page")).alias("url"),
        F.when(k % 9 != 0, F.element_at(zones, (k % len(ZONES) + 1).cast("int"))).alias("time_zone"),
        ((n % 6 - 3) * 3600).cast("int").alias("utc_offset"),
    )


TLDS = ("uk", "de", "fr", "es", "com", "it")
ZONES = ("London", "Paris", "Pacific Time (US & Canada)", "Eastern Time (US & Canada)", "Central Time (US & Canada)", "Indiana (East)", "Mountain Time (US & Canada)", "New York")
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
PROFILES_SQL = f"""profiles AS (
  SELECT c_custkey AS user_id, n_nationkey AS nation, n_name,
    CASE c_custkey % 6 WHEN 0 THEN 'UT: 5' || c_custkey % 10 || '.' || lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0') || ',-' || c_custkey % 5 || '.' || lpad(CAST(c_custkey * 104729 % 1000000 AS VARCHAR), 6, '0')
      WHEN 1 THEN n_name WHEN 2 THEN 'nowhere / ' || n_name WHEN 3 THEN n_name || '-' || 'NATION_' || (n_nationkey + 1) WHEN 4 THEN '' END AS location,
    'http://site' || c_custkey || '.' || {_list(TLDS)}[c_custkey % {len(TLDS)} + 1] || '/page' AS url,
    CASE WHEN c_custkey % 9 <> 0 THEN {_list(ZONES)}[c_custkey % {len(ZONES)} + 1] END AS time_zone,
    CAST((n_nationkey % 6 - 3) * 3600 AS INTEGER) AS utc_offset
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nations as administrative areas n1 … n5 with a square each: x0, y0, x1, y1 (degrees)."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        n.alias("area_id"),
        F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("n1"), F.col("n_name").alias("n2"),
        F.when(n % 2 == 0, F.concat(F.lit("Shire "), n.cast("string"))).alias("n3"), F.when(n % 3 == 0, F.lower("n_name")).alias("n4"), F.lit(None).cast("string").alias("n5"),
        (F.lit(-10.0) + n % 5 * 4).alias("x0"), (F.lit(45.0) + F.floor(n / 5) * 3).alias("y0"), (F.lit(-10.0) + n % 5 * 4 + 3.5).alias("x1"), (F.lit(45.0) + F.floor(n / 5) * 3 + 2.5).alias("y1"),
    )


AREAS_SQL = """areas AS (
  SELECT n_nationkey AS area_id, 'Region ' || n_regionkey AS n1, n_name AS n2, CASE WHEN n_nationkey % 2 = 0 THEN 'Shire ' || n_nationkey END AS n3,
    CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) END AS n4, CAST(NULL AS VARCHAR) AS n5,
    -10.0::DOUBLE + n_nationkey % 5 * 4 AS x0, 45.0::DOUBLE + n_nationkey // 5 * 3 AS y0, -10.0::DOUBLE + n_nationkey % 5 * 4 + 3.5::DOUBLE AS x1, 45.0::DOUBLE + n_nationkey // 5 * 3 + 2.5::DOUBLE AS y1
  FROM nation)"""


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, tld, x0, y0, x1, y1): one country for each top-level domain in use, on the first areas' squares."""
    names = spark.createDataFrame([(k, t) for k, t in enumerate(TLDS) if t != "com"], "area_id int, tld string")
    return areas(spark, sf_dir).join(F.broadcast(names), "area_id").select(F.col("n2").alias("name"), "tld", "x0", "y0", "x1", "y1")


COUNTRIES_SQL = "countries AS (SELECT n2 AS name, tld, x0, y0, x1, y1 FROM areas JOIN (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(TLDS) if t != "com") + ") t(area_id, tld) USING (area_id))"


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, code, off, x0, y0, x1, y1): time zones with a square each; off in hours as text."""
    rows = [(k, *z) for k, z in enumerate(ZONE_ROWS)]
    return areas(spark, sf_dir).join(F.broadcast(spark.createDataFrame(rows, "area_id int, zone string, code string, off string")), "area_id").select("zone", "code", "off", "x0", "y0", "x1", "y1")


#: Zone, standard-time code, offset in seconds (values of our fixture).
ZONE_ROWS = (("Europe/London", "GMT", "0"), ("Europe/Paris", "CET", "3600"), ("America/Los_Angeles", "PST", "-10800"), ("America/New_York", "EST", "-7200"), ("America/Chicago", "CST", "-3600"), ("America/Indiana/Indianapolis", "EST", "7200"), ("Pacific/Apia", "PST", "3600"))
ZONES_SQL = "zones AS (SELECT zone, code, off, x0, y0, x1, y1 FROM areas JOIN (VALUES " + ", ".join(f"({k}, '{a}', '{b}', '{c}')" for k, (a, b, c) in enumerate(ZONE_ROWS)) + ") t(area_id, zone, code, off) USING (area_id))"

#: Rows and columns of the population raster, and where it lies.
GRID = {"rows": 60, "cols": 80, "xll": -6.0, "yll": 49.5, "cell": 0.1}


def population(spark: SparkSession) -> DataFrame:
    """A raster (row, col, value); row 0 is the northern edge; -9999 stands for no data."""
    n = F.col("id")
    rows = spark.range(GRID["rows"] * GRID["cols"]).select((n / GRID["cols"]).cast("int").alias("row"), (n % GRID["cols"]).cast("int").alias("col"))
    value = (F.col("row") * 31 + F.col("col") * 17) % 997
    return rows.select("row", "col", F.when(value % 50 == 0, -9999.0).otherwise(value.cast("double")).alias("value"))


POPULATION_SQL = f"""population AS (
  SELECT CAST(i // {GRID["cols"]} AS INTEGER) AS row, CAST(i % {GRID["cols"]} AS INTEGER) AS col,
    CASE WHEN (i // {GRID["cols"]} * 31 + i % {GRID["cols"]} * 17) % 997 % 50 = 0 THEN -9999.0::DOUBLE ELSE ((i // {GRID["cols"]} * 31 + i % {GRID["cols"]} * 17) % 997)::DOUBLE END AS value
  FROM range({GRID["rows"] * GRID["cols"]}) t(i))"""
