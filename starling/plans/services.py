"""Queries of readers and writers, lookups, caches, progress and population-aware detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from ..operators import analytics as an
from ..operators import events as ed
from ..operators import labelprop as lp
from ..operators import profiles as pr
from ..operators import spatial as sp
from ..sources import providers, readers, retry, sinks
from ..sources.storage import new_path
from ..sources.tables import AREAS_SQL, COUNTRIES_SQL, GRID, MESSAGES_SQL, POPULATION_SQL, areas, countries, messages, population, table
from ..streaming.collect import matched
from ..streaming.progress import milestones
from .inference import edges, gazetteer, seeded, seeds_sql
from .registry import query
from .spatial import MAX_LAT

# --- sources ---------------------------------------------------------------------------------

SEARCHES = {"insults": "idiot", "prose": "over the,because"}


@query("""SELECT doc_id, 'insults' AS collection FROM documents WHERE contains(lower(text), 'idiot')
UNION ALL SELECT doc_id, 'prose' FROM documents WHERE (contains(lower(text), 'over') AND contains(lower(text), 'the')) OR contains(lower(text), 'because')""")
def src_multi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(table(spark, sf_dir, "documents").withColumn("timestamp_ms", F.lit("0")), SEARCHES).select("doc_id", "collection")


@query("SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || '/7'), doc_id LIMIT 1")
def src_random_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.random_row(table(spark, sf_dir, "documents"), "doc_id", 7).select("doc_id", "lang")


def esri_grid(spark: SparkSession) -> DataFrame:
    """The population raster, written as an ESRI ASCII grid to the shared folder and read back."""
    path, order = new_path(spark, "grid"), lambda c, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, v))), lambda x: x[v].cast("string")), " ")
    lines = population(spark).groupBy("row").agg(order("col", "value").alias("line"))
    body = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = f"ncols {GRID['cols']}\nnrows {GRID['rows']}\nxllcorner {GRID['xll']}\nyllcorner {GRID['yll']}\ncellsize {GRID['cell']}\nNODATA_value -9999\n"
    body.select(F.concat(F.lit(head), "body").alias("value")).coalesce(1).write.text(path)
    return sp.ascii_grid(spark, path)


@query(f"WITH {POPULATION_SQL} SELECT row, col, value, {GRID['cols']}::DOUBLE AS ncols, {GRID['rows']}::DOUBLE AS nrows, {GRID['cell']}::DOUBLE AS cellsize, -9999::DOUBLE AS nodata FROM population")
def popmap_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return esri_grid(spark).select("row", "col", "value", "ncols", "nrows", "cellsize", "nodata")


@query(f"WITH {AREAS_SQL}, {COUNTRIES_SQL} SELECT tld AS code, name AS country FROM countries")
def tld_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tld")
    countries(spark, sf_dir).select("tld", F.concat(F.lit(" "), "name", F.lit(", so called "))).write.option("quote", "|").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.top_level_domains(spark, path).select("code", F.split("country", ",")[0].alias("country"))


@query("SELECT c_name, c_acctbal FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "allowed")
    table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string"), "n_name").write.option("quote", "|").csv(path)
    allowed = readers.listed(spark, path, "c_nationkey")
    return table(spark, sf_dir, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("string")).join(allowed, "c_nationkey", "left_semi").select("c_name", "c_acctbal")


@query(f"WITH {AREAS_SQL} SELECT area_id, n2, x0, y0, x1, y1 FROM areas WHERE area_id BETWEEN 5 AND 14")
def dims_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "areas")
    sinks.dimension(areas(spark, sf_dir), path, "area_id", 4)
    return spark.read.parquet(path).where("area_id BETWEEN 5 AND 14").select("area_id", "n2", "x0", "y0", "x1", "y1")


@query("SELECT user_id, count(*) AS cnt FROM events GROUP BY user_id HAVING count(*) > 3")
def counts_csv_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "counts")
    sinks.counts_csv(an.counts_over(table(spark, sf_dir, "events"), "user_id", 3).select("user_id", "cnt"), path)
    return spark.read.schema("user_id bigint, cnt bigint").option("quote", "|").csv(path)


@query(f"WITH {MESSAGES_SQL} SELECT event_id, user_id, lat, lon FROM messages WHERE has_geo")
def json_lines_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "lines")
    sinks.json_lines(messages(spark, sf_dir).where("geo IS NOT NULL").select("event_id", "user_id", "geo"), path, 5000)
    rows = spark.read.schema("event_id bigint, user_id bigint, geo struct<type:string,coordinates:array<double>>").json(path)
    return rows.select("event_id", "user_id", F.col("geo.coordinates")[0].alias("lat"), F.col("geo.coordinates")[1].alias("lon"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def unique_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.unique(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


# --- filters, functions and order ------------------------------------------------------------


@query(f"WITH {MESSAGES_SQL} SELECT event_id FROM messages WHERE has_geo AND ts_obj IS NULL")
def filter_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where("geo IS NOT NULL AND ts_obj IS NULL").select("event_id")


@query(f"WITH {MESSAGES_SQL} SELECT event_id, geo_type AS kind FROM messages WHERE has_geo")
def filter_nested_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where(F.col("geo.type").isNotNull()).select("event_id", F.col("geo.type").alias("kind"))


@query("SELECT event_type, count(*) AS past FROM events WHERE ts < CAST(now() AS TIMESTAMP) GROUP BY event_type")
def before_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("ts") < F.current_timestamp()).groupBy("event_type").agg(F.count("*").alias("past"))


@query(f"""WITH {MESSAGES_SQL}, lists AS (SELECT user_id, list(lon ORDER BY event_id) AS xs, list(lat ORDER BY event_id) AS ys FROM messages WHERE has_geo GROUP BY user_id)
SELECT user_id, unnest(range(1, len(xs) + 1)) AS place, unnest(xs) AS x, unnest(ys) AS y FROM lists""")
def zip_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).where("geo IS NOT NULL").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "lon", "lat"))).alias("m"))
    rows = rows.select("user_id", F.col("m.lon").alias("x"), F.col("m.lat").alias("y"))
    return rows.select("user_id", F.posexplode(F.arrays_zip("x", "y")).alias("at", "p")).select("user_id", (F.col("at") + 1).cast("bigint").alias("place"), "p.x", "p.y")


@query("SELECT doc_id, 'café naïve – ' || coalesce(lang, '') AS text FROM documents")
def text_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, "café naïve – ").otherwise(F.decode(F.encode(F.lit("café naïve – "), "UTF-8"), "ISO-8859-1")), F.coalesce("lang", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", tx.repaired(text).alias("text"))


@query("SELECT doc_id FROM documents WHERE contains(lower(source), 'web') OR contains(lower(source), 'c1') OR contains(lower(source), '3')")
def contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.lower("source").rlike("web|c1|3")).select("doc_id")


@query("SELECT event_id, ts, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS place FROM events")
def cursor_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = an.allocated(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], 1 << 31, F.date_trunc("hour", "ts"))
    return rows.select("event_id", "ts", (F.col("alloc") + 1).cast("bigint").alias("place"))


@query("SELECT event_id, done FROM (SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS INTEGER) AS done FROM events) WHERE done % 250 = 0")
def progress_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milestones(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], 250, F.date_trunc("hour", "ts")).select("event_id", "done")


@query("""SELECT 'patient' AS policy, k AS attempt, least(64.0, 0.5 * power(2, k))::DOUBLE AS seconds FROM range(10) t(k)
UNION ALL SELECT 'doubling', k, power(2, k)::DOUBLE FROM range(5) t(k) UNION ALL SELECT 'counted', k, k::DOUBLE FROM range(5) t(k)""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, k, s) for name, policy in (("patient", retry.patient()), ("doubling", retry.doubling()), ("counted", retry.counted())) for k, s in zip(range(10), policy, strict=False)]
    return spark.createDataFrame(rows, "policy string, attempt bigint, seconds double")


# --- lookups ---------------------------------------------------------------------------------


@query("""SELECT n_name AS query, k AS rank, CASE k WHEN 1 THEN n_name WHEN 2 THEN 'Shire ' || n_nationkey END AS name, CASE k WHEN 1 THEN 8.0::DOUBLE WHEN 2 THEN 4.0::DOUBLE END AS score
FROM nation, range(1, 3) t(k) WHERE n_nationkey < 20""")
def gazetteer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("query"))
    return providers.Table(gazetteer(spark, sf_dir), limit=2).answers(asked).select("query", F.col("rank").cast("bigint").alias("rank"), "name", "score")


@query("""WITH known AS (SELECT DISTINCT user_id AS "user" FROM events WHERE event_id % 4 <> 0), line AS (SELECT user_id AS "user", count(*) AS n FROM events WHERE event_id % 4 = 0 GROUP BY user_id),
asked AS (SELECT DISTINCT user_id AS "user" FROM events), put AS (
  SELECT asked."user", known."user" IS NOT NULL AND asked."user" % 3 <> 0 AS hit, asked."user" % 5 = 0 AS hidden, asked."user" % 7 = 0 AS denied, n FROM asked LEFT JOIN known USING ("user") LEFT JOIN line USING ("user"))
SELECT "user", CASE WHEN hit THEN hidden ELSE denied END AS private, CASE WHEN hit THEN 'cache' WHEN denied THEN 'denied' ELSE 'timeline' END AS origin, NOT hit AS fresh,
  CAST(CASE WHEN hit AND NOT hidden THEN 1 WHEN NOT hit AND NOT denied THEN n END AS DOUBLE) AS mentions
FROM put WHERE hit OR denied OR n IS NOT NULL""")
def profile_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), "event_id")
    maps = lambda n: F.map_from_arrays(F.array(F.lit("7")), F.array(n.cast("int"))).alias("mentions")
    nowhere = F.array().cast("array<struct<lat:double,lon:double>>").alias("locations")
    cache = rows.where("event_id % 4 <> 0 AND user % 3 <> 0").select("user").distinct().select("user", maps(F.lit(1)), nowhere, (F.col("user") % 5 == 0).alias("private"))
    line = rows.where("event_id % 4 = 0").groupBy("user").agg(F.count("*").alias("n")).select("user", maps(F.col("n")), nowhere)
    found = pr.cached(rows, cache, line, rows.where("user % 7 = 0"))
    return found.select("user", "private", "origin", "fresh", F.col("mentions")["7"].cast("double").alias("mentions"))


@query(f"WITH {seeds_sql(1)} SELECT \"user\", lat, lon, round(km, 3) AS km FROM seeds WHERE \"user\" = 4")
def slp_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user whose own geotags label them: an answer without a round, as long as it isn't a test."""
    found = lp.propagate(edges(spark, sf_dir), seeded(spark, sf_dir, 1), 10, 4)
    return found.where("user = 4").select("user", "lat", "lon", F.round("km", 3).alias("km"))


# --- population-aware detection --------------------------------------------------------------


@query(f"WITH {MESSAGES_SQL} SELECT event_id AS id, CASE WHEN lat > 52 THEN 6 ELSE 3 END AS required FROM messages WHERE has_geo")
def required_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    detection = ed.EventDetection(key="event_id", popfunc=lambda lon, lat: F.when(lat > 52, 6).otherwise(3))
    return detection.messages(messages(spark, sf_dir)).select("id", "required")


@query()
def detected_by_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster file, curve and fold as one operator."""
    raster = esri_grid(spark).select("row", "col", "value")
    detection = ed.EventDetection(key="event_id", popmap=raster, grid=GRID, mincount=2, mediancount=5, params=ed.Params(radius=2.0))
    return detection.run(messages(spark, sf_dir), MAX_LAT, tallied=True).select("status", "cluster_id", "messages", F.size("centres").alias("centres"))


#: A ring around part of the messages, as the area of interest (lon, lat).
AREA = [(-5.5, 49.5), (-1.0, 49.5), (-1.0, 56.0), (-5.5, 56.0)]


@query()
def detected_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside an area only, with places given as (lon, lat)."""
    rows = messages(spark, sf_dir).where(F.col("geo.type") == "Point")
    rows = rows.withColumn("place", F.reverse("geo.coordinates")).where(geo.inside_fixed(F.col("place")[0], F.col("place")[1], AREA))
    detection = ed.EventDetection(field="place", key="event_id", popfunc=lambda lon, lat: F.lit(4), params=ed.Params(radius=2.0, swap_axes=True))
    return detection.run(rows, MAX_LAT, tallied=True).select("status", "cluster_id", "messages", F.size("centres").alias("centres"))


@query()
def detected_by_real_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a place of their own (realgeo), whatever geo says."""
    rows = messages(spark, sf_dir).withColumn("realgeo", F.when(F.col("event_id") % 3 != 0, F.struct(F.array("lat", "lon").alias("coordinates"))))
    detection = ed.EventDetection(field="realgeo.coordinates", key="event_id", popfunc=lambda lon, lat: F.lit(4), params=ed.Params(radius=2.0))
    return detection.run(rows.where("realgeo IS NOT NULL"), MAX_LAT, tallied=True).select("status", "cluster_id", "messages", F.size("centres").alias("centres"))


