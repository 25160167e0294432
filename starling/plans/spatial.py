"""Queries of geodesy, spatial joins, rasters of population and place lookups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from ..operators import lookups as lk
from ..operators import spatial as sp
from ..sources.tables import AREAS_SQL, COUNTRIES_SQL, GRID, MESSAGES_SQL, POPULATION_SQL, PROFILES_SQL, ZONES_SQL, areas, countries, messages, population, profiles, table, zones
from .registry import query

#: A five-sided region of interest.
REGION = [(-4.9, 50.3), (-2.2, 50.1), (0.4, 52.0), (-1.5, 54.7), (-4.6, 53.2)]
MAX_LAT = 60.0
CURVE = geo.curve(1.0, 200.0, 2, 5)


def point(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "ts", "lat", "lon")


_edges = ", ".join(f"({x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for (x1, y1), (x2, y2) in zip(REGION, [*REGION[1:], REGION[0]], strict=True))


@query(f"WITH {MESSAGES_SQL}, edges AS (SELECT * FROM (VALUES {_edges}) t(x1, y1, x2, y2)) SELECT event_id FROM messages, edges GROUP BY event_id HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1")
def pip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where(geo.inside_fixed(F.col("lon"), F.col("lat"), REGION)).select("event_id")


@query(f"WITH {MESSAGES_SQL} SELECT event_id, round({geo.haversine_sql('lat', 'lon', '51.5::DOUBLE', '-0.12::DOUBLE')}, 5) AS km FROM messages")
def geo_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("event_id", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.lit(51.5), F.lit(-0.12)), 5).alias("km"))


_MINOR = geo.MAJOR * (1 - geo.FLATTENING)


def _vincenty_sql(steps: int = geo.STEPS) -> str:
    f = repr(geo.FLATTENING) + "::DOUBLE"
    parts = [f"v0 AS (SELECT event_id, radians(-0.12::DOUBLE - lon) AS gap, radians(-0.12::DOUBLE - lon) AS lam, sin(atan(tan(radians(lat)) * (1 - {f}))) AS su1, cos(atan(tan(radians(lat)) * (1 - {f}))) AS cu1, sin(atan(tan(radians(51.5::DOUBLE)) * (1 - {f}))) AS su2, cos(atan(tan(radians(51.5::DOUBLE)) * (1 - {f}))) AS cu2, 0.0::DOUBLE AS sig, 0.0::DOUBLE AS ss, 0.0::DOUBLE AS cs, 0.0::DOUBLE AS c2a, 0.0::DOUBLE AS c2m FROM messages)"]
    for k in range(1, steps + 1):
        parts += [
            f"a{k} AS (SELECT event_id, gap, lam, su1, cu1, su2, cu2, sqrt(pow(cu2 * sin(lam), 2) + pow(cu1 * su2 - su1 * cu2 * cos(lam), 2)) AS ss, su1 * su2 + cu1 * cu2 * cos(lam) AS cs FROM v{k - 1})",
            f"b{k} AS (SELECT *, atan2(ss, cs) AS sig, cu1 * cu2 * sin(lam) / ss AS sa FROM a{k})",
            f"c{k} AS (SELECT *, 1 - sa * sa AS c2a FROM b{k})",
            f"d{k} AS (SELECT *, cs - 2 * su1 * su2 / c2a AS c2m, {f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)) AS c FROM c{k})",
            f"v{k} AS (SELECT event_id, gap, gap + (1 - c) * {f} * sa * (sig + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1))) AS lam, su1, cu1, su2, cu2, sig, ss, cs, c2a, c2m FROM d{k})",
        ]
    return ", ".join(parts)


@query(f"""WITH {MESSAGES_SQL}, {_vincenty_sql()}, u AS (SELECT *, c2a * {(geo.MAJOR**2 - _MINOR**2) / _MINOR**2!r}::DOUBLE AS uu FROM v{geo.STEPS}),
w AS (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS aa, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM u)
SELECT event_id, round({_MINOR!r}::DOUBLE * aa * (sig - bb * ss * (c2m + bb / 4 * (cs * (2 * c2m * c2m - 1) - bb / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))), 4) AS km FROM w""")
def geo_vincenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("event_id", F.round(geo.vincenty(F.col("lat"), F.col("lon"), F.lit(51.5), F.lit(-0.12)), 4).alias("km"))


def _shoot_sql(steps: int = geo.STEPS, source: str = "messages", key: str = "event_id", azimuth: str = "(event_id % 360)::DOUBLE", km: float = 10.0) -> str:
    f, a = f"{geo.FLATTENING!r}::DOUBLE", geo.SHOOT_MAJOR
    b = a * (1 - geo.FLATTENING)
    parts = [
        f"p0 AS (SELECT {key}, radians(lon) AS lon0, sin(atan(tan(radians(lat)) * (1 - {f}))) AS su, cos(atan(tan(radians(lat)) * (1 - {f}))) AS cu, tan(atan(tan(radians(lat)) * (1 - {f}))) AS tu, sin(radians({azimuth})) AS sb, cos(radians({azimuth})) AS cb FROM {source})",
        f"p1 AS (SELECT *, cu * sb AS sa, 1 - cu * sb * (cu * sb) AS c2, atan2(tu, cb) AS first FROM p0)",
        f"p2 AS (SELECT *, c2 * {(a**2 - b**2) / b**2!r}::DOUBLE AS uu FROM p1)",
        f"p3 AS (SELECT *, {km!r}::DOUBLE / ({b!r}::DOUBLE * (1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))))) AS base, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS small FROM p2)",
        "s0 AS (SELECT *, base AS arc FROM p3)",
    ]
    for k in range(1, steps + 1):
        parts.append(f"s{k} AS (SELECT * REPLACE (base + small * sin(arc) * (cos(2 * first + arc) + small / 4 * (cos(arc) * (2 * pow(cos(2 * first + arc), 2) - 1) - small / 6 * cos(2 * first + arc) * (4 * pow(sin(arc), 2) - 3) * (4 * pow(cos(2 * first + arc), 2) - 3))) AS arc) FROM s{k - 1})")
    parts += [
        f"t0 AS (SELECT *, sin(arc) AS sn, cos(arc) AS cs, cos(2 * first + arc) AS mid, {f} / 16 * c2 * (4 + {f} * (4 - 3 * c2)) AS c FROM s{steps})",
        f"t1 AS (SELECT *, su * cs + cu * sn * cb AS up, su * sn - cu * cs * cb AS aside, atan2(sn * sb, cu * cs - su * sn * cb) - (1 - c) * {f} * sa * (arc + c * sn * (mid + c * cs * (2 * mid * mid - 1))) AS gone FROM t0)",
        f"t2 AS (SELECT {key}, degrees(lon0 + gone) AS east, degrees(atan2(up, (1 - {f}) * sqrt(sa * sa + aside * aside))) AS lat, degrees(atan2(sa, -aside)) + 180 AS back FROM t1)",
    ]
    return ", ".join(parts)


@query(f"WITH {MESSAGES_SQL}, {_shoot_sql()} SELECT event_id, round(east - floor((east + 180) / 360) * 360, 6) AS lon, round(lat, 6) AS lat, round(back - floor(back / 360) * 360, 4) AS back FROM t2")
def geo_shoot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select("event_id", geo.shoot(F.col("lon"), F.col("lat"), (F.col("event_id") % 360).cast("double"), F.lit(10.0)).alias("p"))
    return rows.select("event_id", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"), F.round("p.back", 4).alias("back"))


_CIRCLE_SQL = _shoot_sql(source="(SELECT area_id, CAST(k AS INTEGER) AS k, x0 AS lon, y0 AS lat FROM areas, range(361) t(k))", key="area_id, k", azimuth="(k % 360)::DOUBLE", km=25.0)


@query(f"WITH {AREAS_SQL}, {_CIRCLE_SQL} SELECT area_id, k, round(east - floor((east + 180) / 360) * 360, 6) AS x, round(lat, 6) AS y FROM t2")
def geo_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = areas(spark, sf_dir).select("area_id", F.posexplode(geo.geodesic_circle(F.col("x0"), F.col("y0"), F.lit(25.0))).alias("k", "p"))
    return rows.select("area_id", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"WITH {AREAS_SQL} SELECT area_id, CAST(k AS INTEGER) AS k, round(x0 + cos(k * {2 * math.pi / 32!r}::DOUBLE) * 0.1::DOUBLE, 6) AS x, round(y0 + sin(k * {2 * math.pi / 32!r}::DOUBLE) * 0.1::DOUBLE, 6) AS y FROM areas, range(32) t(k)")
def circle_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = areas(spark, sf_dir).select("area_id", F.posexplode(geo.circle(F.col("x0"), F.col("y0"))).alias("k", "p"))
    return rows.select("area_id", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


_CELL = f"{GRID['rows']} - CAST(round_even(abs(lat - {GRID['yll']}::DOUBLE) / {GRID['cell']}::DOUBLE, 0) AS INTEGER) AS row, CAST(round_even(abs(lon - {GRID['xll']}::DOUBLE) / {GRID['cell']}::DOUBLE, 0) AS INTEGER) AS col"


@query(f"WITH {MESSAGES_SQL} SELECT event_id, {_CELL} FROM messages")
def pop_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col = geo.to_cell(F.col("lon"), F.col("lat"), GRID["xll"], GRID["yll"], GRID["cell"], GRID["rows"])
    return messages(spark, sf_dir).select("event_id", row.alias("row"), col.alias("col"))


@query(f"WITH {POPULATION_SQL} SELECT row, col, round(col * {GRID['cell']}::DOUBLE + {GRID['xll']}::DOUBLE, 6) AS lon, round(({GRID['rows']} - row) * {GRID['cell']}::DOUBLE + {GRID['yll']}::DOUBLE, 6) AS lat FROM population")
def pop_cell_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = geo.of_cell(F.col("row"), F.col("col"), GRID["xll"], GRID["yll"], GRID["cell"], GRID["rows"])
    return population(spark).select("row", "col", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"WITH {POPULATION_SQL} SELECT min(value) AS x1, median(value) AS x2, count(*) AS n FROM population WHERE value <> -9999 AND row BETWEEN 10 AND 50 AND col BETWEEN 10 AND 60")
def pop_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = population(spark).where("value <> -9999 AND row BETWEEN 10 AND 50 AND col BETWEEN 10 AND 60")
    return window.agg(F.min("value").alias("x1"), F.median("value").alias("x2"), F.count("*").alias("n"))


@query(f"WITH {MESSAGES_SQL}, {POPULATION_SQL}, pts AS (SELECT event_id, {_CELL} FROM messages) SELECT event_id, value FROM pts LEFT JOIN (SELECT * FROM population WHERE value <> -9999) USING (row, col)")
def pop_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.population_at(messages(spark, sf_dir).select("event_id", "lat", "lon"), population(spark), GRID).select("event_id", "value")


_REQUIRED = f"CASE WHEN value > 0 THEN CAST(ceil(round({CURVE[0]!r}::DOUBLE * ln({CURVE[1]!r}::DOUBLE * value), 9)) AS INTEGER) ELSE 2 END"


@query(f"WITH {MESSAGES_SQL}, {POPULATION_SQL}, pts AS (SELECT event_id, {_CELL} FROM messages) SELECT event_id, {_REQUIRED} AS required FROM pts JOIN (SELECT * FROM population WHERE value <> -9999) USING (row, col)")
def pop_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sp.population_at(messages(spark, sf_dir).select("event_id", "lat", "lon"), population(spark), GRID).where("value IS NOT NULL")
    return rows.select("event_id", geo.required(F.col("value"), *CURVE, 2).alias("required"))


@query(f"WITH {MESSAGES_SQL} SELECT event_id, CAST(round_even(lat, 0) AS INTEGER) || ',' || CAST(round_even(lon, 0) AS INTEGER) AS key FROM messages")
def grid_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("event_id", F.concat_ws(",", F.rint("lat").cast("int"), F.rint("lon").cast("int")).alias("key"))


@query(f"WITH {MESSAGES_SQL}, c AS (SELECT DISTINCT CAST(round_even(lat, 0) AS INTEGER) AS y, CAST(round_even(lon, 0) AS INTEGER) AS x FROM messages) SELECT DISTINCT y, x, y + dy AS ny, x + dx AS nx FROM c, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)")
def neighbour_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = messages(spark, sf_dir).select(F.rint("lat").cast("int").alias("y"), F.rint("lon").cast("int").alias("x")).distinct()
    return c.withColumn("d", F.explode(sp.around("y", "x"))).select("y", "x", (F.col("y") + F.col("d.d0")).alias("ny"), (F.col("x") + F.col("d.d1")).alias("nx")).distinct()


@query(f"WITH {MESSAGES_SQL}, g AS (SELECT event_id, CAST(floor((lon + 180) * 2) AS INTEGER) AS gx, CAST(floor((90 - lat) * 2) AS INTEGER) AS gy FROM messages) SELECT event_id, gx, gy, gx / 2.0::DOUBLE - 180 AS lon, 90 - gy / 2.0::DOUBLE AS lat FROM g")
def grid_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.raster import cell_corner, to_grid

    gx, gy = to_grid(F.col("lon"), F.col("lat"), 2.0)
    rows = messages(spark, sf_dir).select("event_id", gx.alias("gx"), gy.alias("gy"))
    lon, lat = cell_corner(F.col("gx"), F.col("gy"), 2.0)
    return rows.select("event_id", "gx", "gy", lon.alias("lon"), lat.alias("lat"))


@query("SELECT p_partkey, CAST(floor(pow(ceil(64800.0::DOUBLE / p_size), 0.4::DOUBLE)) AS INTEGER) AS scale FROM part")
def focus_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.raster import focus

    return table(spark, sf_dir, "part").select("p_partkey", focus(F.col("p_size")).alias("scale"))


_km = geo.haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")


@query(f"WITH {MESSAGES_SQL} SELECT a.event_id AS a, b.event_id AS b FROM messages a JOIN messages b ON a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 1800000000 WHERE {_km} < 10")
def st_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = point(messages(spark, sf_dir))
    return sp.near_pairs(rows, rows, 10.0, MAX_LAT, 1800).where("a_event_id <> b_event_id").select(F.col("a_event_id").alias("a"), F.col("b_event_id").alias("b"))


@query(f"WITH {MESSAGES_SQL} SELECT a.event_id AS event_id, count(*) AS near FROM messages a JOIN messages b ON abs(epoch_us(a.ts) - epoch_us(b.ts)) < 1800000000 WHERE {_km} < 10 GROUP BY 1")
def st_self_join_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = point(messages(spark, sf_dir))
    return sp.near_counts(rows, "event_id", 10.0, MAX_LAT, 1_800_000_000, 1_800_000_000)


@query(f"WITH {MESSAGES_SQL} SELECT a.event_id AS event_id, count(*) AS near FROM messages a JOIN messages b ON epoch_us(a.ts) >= epoch_us(b.ts) AND epoch_us(a.ts) - epoch_us(b.ts) < 21600000000 WHERE {_km} < 10 GROUP BY 1 HAVING count(*) >= 3")
def burst_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with at least three (themselves included) within 10 km in the six hours before."""
    rows = point(messages(spark, sf_dir))
    return sp.near_counts(rows, "event_id", 10.0, MAX_LAT, 21_600_000_000, 1).where("near >= 3")


CENTRES_SQL = "centres AS (SELECT h AS seq, min(lat) + 0.03::DOUBLE AS lat, min(lon) + 0.03::DOUBLE AS lon FROM messages GROUP BY h)"


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy(F.col("h").alias("seq")).agg((F.min("lat") + 0.03).alias("lat"), (F.min("lon") + 0.03).alias("lon"))


@query(f"WITH {MESSAGES_SQL}, {CENTRES_SQL} SELECT a.event_id AS event_id, min(b.seq) AS cluster FROM messages a, centres b WHERE {_km} < 10 GROUP BY 1")
def attach_to_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = centres(spark, sf_dir).withColumn("cluster", F.col("seq"))
    return sp.first_near(point(messages(spark, sf_dir)), given, "event_id", "seq", "cluster", 10.0, MAX_LAT)


@query(f"WITH {MESSAGES_SQL}, {CENTRES_SQL} SELECT a.seq AS a, b.seq AS b FROM centres a, centres b WHERE a.seq < b.seq AND {_km} < 150")
def centre_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = centres(spark, sf_dir)
    return sp.near_pairs(c, c, 150.0, MAX_LAT).where("a_seq < b_seq").select(F.col("a_seq").alias("a"), F.col("b_seq").alias("b"))


@query(f"""WITH {MESSAGES_SQL}, p AS (SELECT user_id * 100 + week(ts) AS g, lat, lon, count(*) AS n FROM messages GROUP BY ALL),
s AS (SELECT a.g, a.lat, a.lon, round(sum(b.n * {_km}), 5) AS km FROM p a JOIN p b ON a.g = b.g GROUP BY ALL)
SELECT g, m.lat AS lat, m.lon AS lon, round(m.km, 3) AS km FROM (SELECT g, min(struct_pack(km := km, lat := lat, lon := lon)) AS m FROM s GROUP BY g)""")
def medoid_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select((F.col("user_id") * 100 + F.weekofyear("ts")).alias("g"), "lat", "lon")
    return sp.medoids(rows, "g").withColumn("km", F.round("km", 3))


# --- lookups ---------------------------------------------------------------------------------


NAMES_SQL = "names AS (SELECT n_nationkey AS id, upper(n_name) AS name FROM nation UNION ALL SELECT 100 + r_regionkey, 'region ' || r_regionkey FROM region UNION ALL SELECT 200 + n_nationkey, 'Shire ' || n_nationkey FROM nation)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = lambda key, name: [key.alias("id"), name.alias("name")]
    out = n.select(*named(F.col("n_nationkey"), F.upper("n_name")))
    out = out.unionByName(r.select(*named(F.col("r_regionkey") + 100, F.concat(F.lit("region "), F.col("r_regionkey").cast("string")))))
    return out.unionByName(n.select(*named(F.col("n_nationkey") + 200, F.concat(F.lit("Shire "), F.col("n_nationkey").cast("string")))))


@query(f"WITH {AREAS_SQL}, {NAMES_SQL} SELECT id, area_id FROM names, areas WHERE lower(name) IN (lower(n1), lower(n2), lower(n3), lower(n4), lower(n5))")
def gadm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.by_any_name(names(spark, sf_dir), areas(spark, sf_dir), "name").select("id", "area_id")


@query(f"WITH {AREAS_SQL}, {COUNTRIES_SQL}, {NAMES_SQL} SELECT id, c.name AS country, tld FROM names n JOIN countries c ON lower(n.name) = lower(c.name)")
def country_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = countries(spark, sf_dir).withColumnRenamed("name", "country")
    return lk.by_name(names(spark, sf_dir), given, "name", "country").select("id", "country", "tld")


_ZONE_NAME = r"replace(trim(regexp_replace(time_zone, '\(.*\)', '')), ' ', '_')"


@query(rf"WITH {AREAS_SQL}, {ZONES_SQL}, {PROFILES_SQL} SELECT user_id, zone FROM (SELECT user_id, {_ZONE_NAME} AS name FROM profiles) JOIN zones ON zone ILIKE '%' || name || '%'")
def tz_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles(spark, sf_dir).select("user_id", tx.zone_name(F.col("time_zone")).alias("name"))
    return lk.by_part(rows, zones(spark, sf_dir), "name").select("user_id", "zone")


@query(f"WITH {AREAS_SQL}, {ZONES_SQL}, {PROFILES_SQL} SELECT user_id, zone FROM profiles JOIN zones ON CAST(utc_offset AS VARCHAR) = off")
def tz_offset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.by_offset(profiles(spark, sf_dir).select("user_id", "utc_offset"), zones(spark, sf_dir), "utc_offset").select("user_id", "zone")


_US_CODE = "CASE WHEN contains(time_zone, 'Pacific Time (US & Canada)') THEN 'PST' WHEN contains(time_zone, 'Eastern Time (US & Canada)') THEN 'EST' WHEN contains(time_zone, 'Central Time (US & Canada)') THEN 'CST' END"


@query(f"WITH {AREAS_SQL}, {ZONES_SQL}, {PROFILES_SQL} SELECT user_id, zone FROM (SELECT user_id, {_US_CODE} AS us FROM profiles) JOIN zones ON us = code WHERE zone ILIKE '%America%'")
def tz_america_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles(spark, sf_dir).select("user_id", tx.us_code(F.col("time_zone")).alias("us"))
    return lk.american(rows, zones(spark, sf_dir), "us").select("user_id", "zone")


@query(rf"WITH {AREAS_SQL}, {COUNTRIES_SQL}, urls AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+', 0) || '.' || ['uk', 'de', 'fr', 'com'][page_id % 4 + 1] || '/' AS url FROM pages) SELECT page_id, c.name AS country FROM (SELECT page_id, regexp_extract(url, '\.([a-z]{{2,3}})([ /]|$)', 1) AS tld FROM urls) JOIN countries c USING (tld)")
def tld_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ("uk", "de", "fr", "com"))), (F.col("page_id") % 4 + 1).cast("int"))
    urls = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "^https?://[^/?#]+", 0), F.lit("."), ending, F.lit("/")).alias("url"))
    hits = urls.select("page_id", F.explode(tx.top_level_domains(F.col("url"))).alias("tld"))
    return hits.join(countries(spark, sf_dir), "tld").select("page_id", F.col("name").alias("country"))


@query(f"WITH {AREAS_SQL} SELECT area_id, CAST(4 AS INTEGER) AS corners, x0 AS first_x, y1 AS last_y FROM areas")
def parse_polys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    at = lambda x, y: F.concat(F.lit("("), s(x), F.lit(", "), s(y), F.lit(")"))
    ring = F.concat(F.lit("["), F.concat_ws(", ", at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1")), F.lit("]"))
    text = F.when(F.col("area_id") % 2 == 0, F.concat(F.lit("["), ring, F.lit("]"))).otherwise(F.concat(F.lit("[["), ring, F.lit("]]")))
    rows = areas(spark, sf_dir).select("area_id", F.explode(geo.rings(text)).alias("ring"))
    return rows.select("area_id", F.size("ring").alias("corners"), F.col("ring")[0]["x"].alias("first_x"), F.col("ring")[3]["y"].alias("last_y"))
