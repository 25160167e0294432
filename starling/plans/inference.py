"""Queries of location inference (indicators, stacking, label propagation) and of signal analysis."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from ..operators import analytics as an
from ..operators import evidence as ev
from ..operators import labelprop as lp
from ..operators import raster as ra
from ..operators import signal as sg
from ..sources.tables import AREAS_SQL, COUNTRIES_SQL, MENTIONS_SQL, MESSAGES_SQL, PROFILES_SQL, ZONES_SQL, areas, countries, mentions, messages, profiles, table, zones
from .registry import query

BOX_SQL = "round(x0, 6) AS x, round(y0, 6) AS y"


def first() -> list:
    """What the queries show of a ring: its first point, and the weight."""
    return [F.round(F.col("ring")[0]["x"], 6).alias("x"), F.round(F.col("ring")[0]["y"], 6).alias("y"), F.round("weight", 6).alias("weight")]


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).withColumnRenamed("user_id", "key")


# --- indicators ------------------------------------------------------------------------------


@query(f"WITH {MESSAGES_SQL} SELECT event_id AS key, round(lon + 0.1::DOUBLE, 6) AS x, round(lat, 6) AS y, 10.0::DOUBLE AS weight FROM messages WHERE has_geo AND geo_type = 'Point'")
def ind_geotag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.geotag(messages(spark, sf_dir).withColumnRenamed("event_id", "key")).select("key", *first())


@query(rf"WITH {PROFILES_SQL} SELECT user_id AS key, round(CAST(regexp_extract(location, '{tx.COORDINATES}', 2) AS DOUBLE) + 0.1::DOUBLE, 6) AS x, round(CAST(regexp_extract(location, '{tx.COORDINATES}', 1) AS DOUBLE), 6) AS y, 2.72::DOUBLE AS weight FROM profiles WHERE regexp_matches(location, '{tx.COORDINATES}')")
def ind_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.coordinate(keyed(spark, sf_dir)).select("key", *first())


@query(rf"WITH {AREAS_SQL}, {COUNTRIES_SQL}, {PROFILES_SQL} SELECT user_id AS key, {BOX_SQL}, 1.07::DOUBLE AS weight FROM (SELECT user_id, regexp_extract(url, '\.([a-z]{{2,3}})([ /]|$)', 1) AS tld FROM profiles) JOIN countries USING (tld)")
def ind_website(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.website(keyed(spark, sf_dir), countries(spark, sf_dir)).select("key", *first())


_US = "CASE WHEN contains(time_zone, 'Pacific Time (US & Canada)') THEN 'PST' WHEN contains(time_zone, 'Eastern Time (US & Canada)') THEN 'EST' WHEN contains(time_zone, 'Central Time (US & Canada)') THEN 'CST' END"
TZ_SQL = rf"tz AS (SELECT user_id, {_US} AS us, replace(trim(regexp_replace(time_zone, '\(.*\)', '')), ' ', '_') AS name FROM profiles)"


@query(f"WITH {AREAS_SQL}, {ZONES_SQL}, {PROFILES_SQL}, {TZ_SQL} SELECT user_id AS key, {BOX_SQL}, 0.56::DOUBLE AS weight FROM tz JOIN zones ON CASE WHEN us IS NOT NULL THEN code = us AND zone ILIKE '%America%' ELSE zone ILIKE '%' || name || '%' END")
def ind_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.time_zone(keyed(spark, sf_dir), zones(spark, sf_dir)).select("key", *first())


@query(f"WITH {AREAS_SQL}, {ZONES_SQL}, {PROFILES_SQL} SELECT user_id AS key, {BOX_SQL}, 0.56::DOUBLE AS weight FROM profiles JOIN zones ON CAST(utc_offset AS VARCHAR) = off")
def ind_tzoffset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.zone_offset(keyed(spark, sf_dir), zones(spark, sf_dir)).select("key", *first())


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline answers of a text annotator: (text, uri, types, similarity)."""
    n = table(spark, sf_dir, "nation")
    uri = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("http://kb/resource/Shire_"), F.col("n_nationkey").cast("string"))).otherwise(F.concat(F.lit("http://kb/resource/Spot_"), F.col("n_nationkey").cast("string")))
    return n.select(F.concat(F.lit("greetings from "), F.col("n_name")).alias("text"), uri.alias("uri"), F.when(F.col("n_nationkey") % 7 != 0, "Schema:Place,Thing").otherwise("Person").alias("types"), (F.lit(0.5) + F.col("n_nationkey") * F.lit(0.01)).alias("similarity"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline answers of a knowledge base: (name, georss_point, lat_d, lon_d)."""
    n = F.col("n_nationkey")
    point = F.when(n % 2 == 0, F.concat((n + 40).cast("string"), F.lit(".5 -"), (n % 9).cast("string"), F.lit(".25")))
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("Spot "), n.cast("string")).alias("name"), point.alias("georss_point"), (n + 41.0).alias("lat_d"), F.when(n % 5 != 0, n * 1.0).alias("lon_d"))


@query(f"""WITH {AREAS_SQL}, n AS (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey % 7 <> 0)
SELECT k AS key, round(x0, 6) AS x, round(y0, 6) AS y, round(0.67::DOUBLE * (0.5::DOUBLE + k * 0.01::DOUBLE), 6) AS weight FROM n JOIN areas ON n3 = 'Shire ' || k WHERE k % 3 = 0
UNION ALL SELECT k, round(CASE WHEN k % 2 = 0 THEN -(k % 9 + 0.25::DOUBLE) ELSE k * 1.0::DOUBLE END + 0.1::DOUBLE, 6), CASE WHEN k % 2 = 0 THEN k + 40.5::DOUBLE ELSE k + 41.0::DOUBLE END, round(0.67::DOUBLE * (0.5::DOUBLE + k * 0.01::DOUBLE), 6) FROM n WHERE k % 3 <> 0 AND (k % 2 = 0 OR k % 5 <> 0)""")
def ind_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.concat(F.lit("greetings from "), F.col("n_name")).alias("text"))
    return ev.message(texts, annotations(spark, sf_dir), entities(spark, sf_dir), areas(spark, sf_dir)).select(F.col("key").cast("int").alias("key"), *first())


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline answers of a gazetteer: (query, rank, name, fcl_name, score, lng, lat)."""
    n = table(spark, sf_dir, "nation").where("n_nationkey < 20")
    hit = lambda rank, name, kind, score, dx: F.struct(F.lit(rank).alias("rank"), name.alias("name"), F.lit(kind).alias("fcl_name"), F.lit(score).alias("score"), (F.col("n_nationkey") + dx).alias("lng"), (F.col("n_nationkey") + 30.0).alias("lat"))
    hits = F.array(hit(1, F.col("n_name"), "country, state, region,...", 8.0, 0.0), hit(2, F.concat(F.lit("Shire "), F.col("n_nationkey").cast("string")), "state, region", 4.0, 0.5), hit(3, F.lit("Village"), "city, village,...", 2.0, 1.0))
    return n.select(F.col("n_name").alias("query"), F.explode(hits).alias("h")).select("query", "h.*")


@query()
def ind_locfield(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.location_field(keyed(spark, sf_dir), gazetteer(spark, sf_dir), areas(spark, sf_dir), countries(spark, sf_dir))
    return found.select("key", *first())


def gis_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline answers of the other gazetteer: (query, rank, name, placetype, score, max_score, lng, lat)."""
    return gazetteer(spark, sf_dir).select("query", "rank", "name", F.when(F.col("rank") < 3, "Adm").otherwise("Spot").alias("placetype"), "score", F.lit(8.0).alias("max_score"), "lng", "lat")


@query()
def ind_gis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.gis_field(keyed(spark, sf_dir), gis_gazetteer(spark, sf_dir), areas(spark, sf_dir), 3).select("key", *first())


def united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of profiles that SQL can say too: websites, zones and offsets."""
    rows, z = keyed(spark, sf_dir), zones(spark, sf_dir)
    return ev.united([ev.website(rows, countries(spark, sf_dir)), ev.time_zone(rows, z), ev.zone_offset(rows, z)])


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence that profiles have: coordinates, location fields by both gazetteers, websites, zones and offsets."""
    rows, a = keyed(spark, sf_dir), areas(spark, sf_dir)
    field = ev.location_field(rows, gazetteer(spark, sf_dir), a, countries(spark, sf_dir), lambda left: ev.message(left, annotations(spark, sf_dir), entities(spark, sf_dir), a, "GN_3", "location_field"))
    return ev.united([united(spark, sf_dir), ev.coordinate(rows), field, ev.gis_field(rows, gis_gazetteer(spark, sf_dir), a, 3)])


UNITED_SQL = rf"""{AREAS_SQL}, {COUNTRIES_SQL}, {ZONES_SQL}, {PROFILES_SQL}, {TZ_SQL}, united AS (
  SELECT user_id AS key, 'website' AS indicator, 1.07::DOUBLE AS weight, x0, y0, x1, y1 FROM (SELECT user_id, regexp_extract(url, '\.([a-z]{{2,3}})([ /]|$)', 1) AS tld FROM profiles) JOIN countries USING (tld)
  UNION ALL SELECT user_id, 'time_zone', 0.56::DOUBLE, x0, y0, x1, y1 FROM tz JOIN zones ON CASE WHEN us IS NOT NULL THEN code = us AND zone ILIKE '%America%' ELSE zone ILIKE '%' || name || '%' END
  UNION ALL SELECT user_id, 'zone_offset', 0.56::DOUBLE, x0, y0, x1, y1 FROM profiles JOIN zones ON CAST(utc_offset AS VARCHAR) = off)"""


@query(f"WITH {UNITED_SQL} SELECT key, indicator, {BOX_SQL}, weight FROM united")
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return united(spark, sf_dir).select("key", "indicator", *first())


@query(f"WITH {UNITED_SQL} SELECT key, count(DISTINCT indicator) AS inds, count(*) AS polys FROM united GROUP BY key")
def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return united(spark, sf_dir).groupBy("key").agg(F.countDistinct("indicator").alias("inds"), F.count("*").alias("polys"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN 1.51::DOUBLE ELSE 0.67::DOUBLE END * (o_orderkey % 10) / 10.0::DOUBLE, 6) AS weight FROM orders")
def evidence_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    override = F.when(F.col("o_orderkey") % 3 == 0, F.lit(ev.WEIGHTS["GN"]))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), override.alias("override"), ((F.col("o_orderkey") % 10) / 10.0).alias("belief"))
    found = ev.emitted(rows, "any", F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))), F.coalesce("override", F.lit(ev.WEIGHTS["SP"])), F.col("belief"))
    return found.select(F.col("key").alias("o_orderkey"), F.round("weight", 6).alias("weight"))


# --- stacking --------------------------------------------------------------------------------

#: Squares' cells by arithmetic: those whose centre is inside, or that hold a corner.
CELLS_SQL = f"""{UNITED_SQL}, spans AS (
  SELECT *, CAST(floor((x0 + 180) * 0.5) AS INTEGER) AS ga, CAST(floor((x1 + 180) * 0.5) AS INTEGER) AS gb, CAST(floor((90 - y1) * 0.5) AS INTEGER) AS gc, CAST(floor((90 - y0) * 0.5) AS INTEGER) AS gd FROM united),
cells AS (SELECT key, indicator, weight, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy FROM (SELECT *, unnest(range(ga, gb + 1)) AS gx FROM spans) s, range(0, 100) t(gy)
  WHERE gy BETWEEN gc AND gd AND (((gx + 0.5) * 2 - 180 BETWEEN x0 AND x1 AND 90 - (gy + 0.5) * 2 BETWEEN y0 AND y1) OR (gx IN (ga, gb) AND gy IN (gc, gd)))),
best AS (SELECT key, indicator, gx, gy, max(weight) AS weight FROM cells GROUP BY ALL), stack AS (SELECT key, gx, gy, sum(weight) AS weight FROM best GROUP BY ALL),
tops AS (SELECT * FROM (SELECT *, max(weight) OVER (PARTITION BY key) AS best FROM stack) WHERE weight >= best * 0.75 - 1e-9)"""


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.covered(united(spark, sf_dir), 0.5)


@query(f"WITH {CELLS_SQL} SELECT key, indicator, gx, gy, weight FROM cells")
def stack_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarse(spark, sf_dir).select("key", "indicator", "gx", "gy", "weight")


@query(f"WITH {CELLS_SQL} SELECT * FROM best")
def stack_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarse(spark, sf_dir).groupBy("key", "indicator", "gx", "gy").agg(F.max("weight").alias("weight"))


@query(f"WITH {CELLS_SQL} SELECT key, gx, gy, round(weight, 6) AS weight FROM stack")
def stack_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.stacked(coarse(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {CELLS_SQL} SELECT key, gx, gy, round(weight, 6) AS weight FROM tops")
def stack_top_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.top_cells(ra.stacked(coarse(spark, sf_dir))).select("key", "gx", "gy", F.round("weight", 6).alias("weight"))


@query(f"WITH {CELLS_SQL} SELECT key, min(gx) * 2 - 180 - 2.0::DOUBLE AS west, 90 - (max(gy) + 1) * 2 - 2.0::DOUBLE AS south, (max(gx) + 1) * 2 - 180 + 2.0::DOUBLE AS east, 90 - min(gy) * 2 + 2.0::DOUBLE AS north FROM tops GROUP BY key")
def stack_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = ra.bounds_of(ra.top_cells(ra.stacked(coarse(spark, sf_dir))), 0.5)
    return box.select("key", F.col("bx0").alias("west"), F.col("by0").alias("south"), F.col("bx1").alias("east"), F.col("by1").alias("north"))


@query(f"WITH {CELLS_SQL} SELECT key, count(*) AS cells, CAST(sum(gx) AS BIGINT) AS sx, CAST(sum(gy) AS BIGINT) AS sy FROM tops GROUP BY key")
def answer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = ra.top_cells(ra.stacked(coarse(spark, sf_dir)))
    return tops.groupBy("key").agg(F.count("*").alias("cells"), F.sum("gx").alias("sx"), F.sum("gy").alias("sy"))


FINE_SQL = f"""{CELLS_SQL}, box AS (
  SELECT key, greatest(-180.0::DOUBLE, min(gx) * 2 - 180 - 2) AS bx0, greatest(-90.0::DOUBLE, 90 - (max(gy) + 1) * 2 - 2) AS by0, least(180.0::DOUBLE, (max(gx) + 1) * 2 - 180 + 2) AS bx1, least(90.0::DOUBLE, 90 - min(gy) * 2 + 2) AS by1 FROM tops GROUP BY key),
scaled AS (SELECT *, CAST(floor(pow(ceil(64800.0::DOUBLE / ((bx1 - bx0) * (by1 - by0))), 0.4::DOUBLE)) AS INTEGER) AS scale FROM box),
fine AS (SELECT u.*, bx0, by0, bx1, by1, scale, CAST(floor((x0 + 180) * scale) AS INTEGER) AS ga, CAST(floor((x1 + 180) * scale) AS INTEGER) AS gb, CAST(floor((90 - y1) * scale) AS INTEGER) AS gc, CAST(floor((90 - y0) * scale) AS INTEGER) AS gd FROM united u JOIN scaled USING (key)),
shapes AS (SELECT DISTINCT scale, x0, y0, x1, y1, ga, gb, gc, gd FROM fine),
raster AS (SELECT scale, x0, y0, x1, y1, gx, gy FROM shapes JOIN range(20000) a(gx) ON gx BETWEEN ga AND gb JOIN range(10000) b(gy) ON gy BETWEEN gc AND gd
  WHERE ((gx + 0.5) / scale - 180 >= x0 AND (gx + 0.5) / scale - 180 < x1 AND 90 - (gy + 0.5) / scale >= y0 AND 90 - (gy + 0.5) / scale < y1) OR (gx IN (ga, gb) AND gy IN (gc, gd))),
kept AS (SELECT key, scale, indicator, gx, gy, max(weight) AS weight FROM fine JOIN raster USING (scale, x0, y0, x1, y1)
  WHERE gx BETWEEN floor((bx0 + 180) * scale) AND floor((bx1 + 180) * scale) AND gy BETWEEN floor((90 - by1) * scale) AND floor((90 - by0) * scale) GROUP BY ALL),
sums AS (SELECT key, scale, gx, gy, sum(weight) AS weight FROM kept GROUP BY ALL),
answer AS (SELECT * FROM (SELECT *, max(weight) OVER (PARTITION BY key) AS best FROM sums) WHERE weight >= best * 0.75 - 1e-9)"""


def answers(evidence: DataFrame) -> DataFrame:
    return ra.figures(evidence).select("key", "scale", "cells", "gx", "gy", F.round(F.col("best") * 0.75, 6).alias("weight"))


@query(f"WITH {FINE_SQL} SELECT key, scale, count(*) AS cells, CAST(min(gx) AS INTEGER) AS gx, CAST(min(gy) AS INTEGER) AS gy, round(max(best) * 0.75, 6) AS weight FROM answer GROUP BY ALL")
def mi_infer_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inference over the evidence that SQL can say too."""
    return answers(united(spark, sf_dir))


@query()
def mi_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inference over all evidence that profiles have."""
    return answers(whole(spark, sf_dir))


@query()
def mi_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per profile: the answer's contours (poly, and how many), threshold weight and what it rests on; profiles without evidence have no contours."""
    found = ra.results(whole(spark, sf_dir))
    rows = keyed(spark, sf_dir).select("key").join(found, "key", "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return rows.select("key", "poly", F.coalesce(F.size("poly"), F.lit(0)).alias("contours"), F.round("weight", 6).alias("weight"), none("inds").alias("inds"), none("polys").alias("polys"))


@query(f"WITH {MESSAGES_SQL} SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, CAST(floor((lon + 12) * 10) AS INTEGER) AS gx, CAST(floor((63 - lat) * 10) AS INTEGER) AS gy, count(*) AS cnt FROM messages WHERE lon >= -12 AND lon < 5 AND lat > 47 AND lat <= 63 GROUP BY ALL")
def density_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).where("lon >= -12 AND lon < 5 AND lat > 47 AND lat <= 63")
    cell = [F.floor((F.col("lon") + 12) * 10).cast("int").alias("gx"), F.floor((F.lit(63) - F.col("lat")) * 10).cast("int").alias("gy")]
    return rows.groupBy(F.date_trunc("hour", "ts").alias("hour"), *cell).agg(F.count("*").alias("cnt"))


# --- label propagation -----------------------------------------------------------------------

#: Mentions in each direction that make two users friends, geotags that make a user a seed, rounds at most.
LEAST, LEAST_TAGS, ROUNDS = 3, 60, 10
EDGES_SQL = f"{MENTIONS_SQL}, edges AS MATERIALIZED (SELECT a.src, a.dst FROM mentions a JOIN mentions b ON a.src = b.dst AND a.dst = b.src WHERE a.cnt >= {LEAST} AND b.cnt >= {LEAST})"
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp.mutual(mentions(spark, sf_dir), LEAST).select("src", "dst")


def seeded(spark: SparkSession, sf_dir: str, least: int = LEAST_TAGS) -> DataFrame:
    tags = messages(spark, sf_dir).where("geo IS NOT NULL").select(F.col("user_id").alias("user"), "lat", "lon")
    return lp.seeds(tags, least)


def _medoid_sql(points: str, out: str) -> str:
    km = geo.haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")
    return f"""{out}_p AS (SELECT "user", lat, lon, count(*) AS n FROM {points} GROUP BY ALL), {out}_s AS (SELECT a."user", a.lat, a.lon, round(sum(b.n * {km}), 5) AS km FROM {out}_p a JOIN {out}_p b ON a."user" = b."user" GROUP BY ALL),
{out} AS MATERIALIZED (SELECT "user", m.lat AS lat, m.lon AS lon, m.km AS km FROM (SELECT "user", min(struct_pack(km := km, lat := lat, lon := lon)) AS m FROM {out}_s GROUP BY "user"))"""


def _step_sql(old: str, out: str) -> str:
    return f"{out}_n AS (SELECT e.src AS \"user\", l.lat, l.lon FROM edges e JOIN {old} l ON l.\"user\" = e.dst WHERE e.src NOT IN (SELECT \"user\" FROM {old})), {_medoid_sql(out + '_n', out)}"


def seeds_sql(least: int) -> str:
    tags = f'SELECT * FROM (SELECT user_id AS "user", lat, lon, count(*) OVER (PARTITION BY user_id) AS own FROM messages WHERE has_geo) WHERE own >= {least}'
    return f"{MESSAGES_SQL}, {EDGES_SQL}, tags AS MATERIALIZED ({tags}), {_medoid_sql('tags', 'seeds')}"


SEEDS_SQL = seeds_sql(LEAST_TAGS)


@query(f"WITH {EDGES_SQL} SELECT DISTINCT src, dst FROM edges")
def slp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp.symmetric(edges(spark, sf_dir).where("src < dst"))


@query(f"WITH {SEEDS_SQL} SELECT \"user\", lat, lon, round(km, 3) AS km FROM seeds")
def slp_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir).withColumn("km", F.round("km", 3))


@query(f"""WITH {EDGES_SQL}, l0 AS (SELECT 1::BIGINT AS "user", 0 AS depth), l1 AS (SELECT DISTINCT dst AS "user", 1 AS depth FROM edges WHERE src = 1),
l2 AS (SELECT DISTINCT dst AS "user", 2 AS depth FROM edges JOIN l1 ON src = "user" WHERE dst <> 1 AND dst NOT IN (SELECT "user" FROM l1)),
l3 AS (SELECT DISTINCT dst AS "user", 3 AS depth FROM edges JOIN l2 ON src = "user" WHERE dst <> 1 AND dst NOT IN (SELECT "user" FROM l1) AND dst NOT IN (SELECT "user" FROM l2))
SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3""")
def slp_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp.network(edges(spark, sf_dir), 1, 3)


@query(f"WITH {SEEDS_SQL}, {_step_sql('seeds', 'one')} SELECT \"user\", lat, lon, round(km, 3) AS km FROM one")
def slp_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp.step(lp.symmetric(edges(spark, sf_dir)), seeded(spark, sf_dir)).withColumn("km", F.round("km", 3))


_full, _all = SEEDS_SQL, "SELECT *, 0 AS iteration FROM seeds"
for _i in range(1, ROUNDS + 1):
    _full += f", l{_i} AS MATERIALIZED ({_all}), {_step_sql(f'l{_i}', f's{_i}')}"
    _all = f"SELECT * FROM l{_i} UNION ALL SELECT *, {_i} FROM s{_i}"


@query(f"WITH {_full} SELECT \"user\", lat, lon, round(km, 3) AS km FROM ({_all})")
def slp_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp.propagate(edges(spark, sf_dir), seeded(spark, sf_dir), ROUNDS).select("user", "lat", "lon", F.round("km", 3).alias("km"))


@query(f"WITH {_full} SELECT \"user\", iteration FROM ({_all})")
def slp_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp.propagate(edges(spark, sf_dir), seeded(spark, sf_dir), ROUNDS).select("user", "iteration")


# --- signal ----------------------------------------------------------------------------------

SERIES_SQL = """hourly AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS cnt FROM events GROUP BY 1),
grid AS (SELECT unnest(range(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hourly),
points AS (SELECT row_number() OVER (ORDER BY g.hour) - 1 AS n, coalesce(cnt, 0)::DOUBLE AS x, count(*) OVER () AS size FROM grid g LEFT JOIN hourly h ON h.hour = g.hour),
bins AS (SELECT k, size, sum((x - mean) * cos(2 * pi() * (k * n % size) / size)) AS re, -sum((x - mean) * sin(2 * pi() * (k * n % size) / size)) AS im FROM points, (SELECT avg(x) AS mean FROM points), (SELECT unnest(range(max(size))) AS k FROM points) GROUP BY ALL)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.numbered(an.gap_filled(an.hourly(table(spark, sf_dir, "events"))), "hour", "cnt")


@query(f"WITH {SERIES_SQL} SELECT k, round(2 / size * sqrt(re * re + im * im), 4) AS magnitude FROM bins WHERE k < size // 2")
def dft_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.magnitudes(sg.spectrum(points(spark, sf_dir))).withColumn("magnitude", F.round("magnitude", 4))


@query(f"WITH {SERIES_SQL} SELECT n, round(sum(re * cos({2 * math.pi!r}::DOUBLE * (k * n % points.size) / points.size) - im * sin({2 * math.pi!r}::DOUBLE * (k * n % points.size) / points.size)) / max(points.size), 4) AS x FROM points JOIN bins ON k = 27 OR k = points.size - 1 GROUP BY n")
def dft_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return sg.band(p, sg.spectrum(p), [27]).withColumn("x", F.round("x", 4))
