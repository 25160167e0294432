"""Queries of the batch analytics, projections, filters and scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analytics as an
from ..sources.tables import MENTIONS_SQL, MESSAGES_SQL, PROFILES_SQL, mentions, messages, profiles, table
from .registry import query

HOURLY_SQL = "hourly AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS cnt FROM events GROUP BY ALL)"


# --- sources and filters ---------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'idiot') OR (contains(lower(text), 'over') AND contains(lower(text), 'the'))")
def src_track_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(tx.tracks(F.col("text"), "idiot,over the")).select("doc_id", "lang")


@query("SELECT event_id, user_id, value FROM events WHERE event_id > 100 AND event_id <= 700 ORDER BY event_id DESC LIMIT 100")
def src_backfill_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id > 100 AND event_id <= 700").orderBy(F.desc("event_id")).limit(100).select("event_id", "user_id", "value")


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id = 7")
def src_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("user_id = 7").select("event_id", "user_id", "event_type")


@query(f"WITH {MESSAGES_SQL} SELECT event_id, user_id, lat, lon FROM messages WHERE has_geo")
def copy_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where("geo IS NOT NULL").select("event_id", "user_id", F.col("geo.coordinates")[0].alias("lat"), F.col("geo.coordinates")[1].alias("lon"))


@query("SELECT event_id, ts, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 16:00:00' AND TIMESTAMP '2024-01-12 16:00:00'")
def copy_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda x: F.lit(x).cast("timestamp")
    return table(spark, sf_dir, "events").where(F.col("ts").between(t("2024-01-05 16:00:00"), t("2024-01-12 16:00:00"))).select("event_id", "ts", "user_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def proj_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(f"WITH {MESSAGES_SQL} SELECT event_id, 'study' AS collection, make_timestamp(CAST(timestamp_ms AS BIGINT) * 1000) AS timestamp_obj FROM messages")
def enrich_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("event_id", F.lit("study").alias("collection"), F.timestamp_millis(F.col("timestamp_ms").cast("bigint")).alias("timestamp_obj"))


@query("SELECT doc_id, lang FROM documents WHERE text IS NOT NULL")
def filter_has_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "lang")


@query(f"WITH {MESSAGES_SQL} SELECT event_id, geo_type FROM messages WHERE has_geo AND geo_type = 'Point'")
def filter_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where("geo IS NOT NULL AND geo.type = 'Point'").select("event_id", F.col("geo.type").alias("geo_type"))


@query(f"WITH {MESSAGES_SQL} SELECT event_id, make_timestamp(CAST(timestamp_ms AS BIGINT) * 1000) AS timestamp_obj FROM messages WHERE ts_obj IS NULL")
def backfill_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where("ts_obj IS NULL").select("event_id", F.timestamp_millis(F.col("timestamp_ms").cast("bigint")).alias("timestamp_obj"))


@query("SELECT event_id, event_id % 4 AS alloc FROM events WHERE (CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'run1' ELSE 'run2' END IS DISTINCT FROM 'run2') AND event_id % 4 IN (0, 2)")
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.when(F.col("event_id") % 3 == 1, "run1").when(F.col("event_id") % 3 == 2, "run2")
    rows = table(spark, sf_dir, "events").select("event_id", run.alias("inf_id"), (F.col("event_id") % 4).alias("alloc"))
    return rows.where((F.col("inf_id").isNull() | (F.col("inf_id") != "run2")) & F.col("alloc").isin(0, 2)).drop("inf_id")


@query("SELECT doc_id, to_json(struct_pack(mid := CAST(doc_id AS VARCHAR), lang := lang, user := source, hashtags := [lang, source])) AS line FROM documents")
def export_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.struct(F.col("lang").alias("text")), F.struct(F.col("source").alias("text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", tags.alias("entities"))
    return rows.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("mid"), "lang", F.col("source").alias("user"), F.col("entities.text").alias("hashtags"))).alias("line"))


@query(f"WITH {MESSAGES_SQL} SELECT event_id, lon AS first, lat AS second FROM messages WHERE has_geo")
def swap_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.reverse("geo.coordinates")
    return messages(spark, sf_dir).where("geo IS NOT NULL").select("event_id", c[0].alias("first"), c[1].alias("second"))


@query(f"""WITH {PROFILES_SQL}, top AS (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 66)
SELECT CASE WHEN t.user_id IS NOT NULL THEN 'removed' WHEN location IS NULL THEN 'none' ELSE 'has location' END AS class, count(*) AS cnt
FROM profiles p LEFT JOIN top t ON p.user_id = t.user_id GROUP BY ALL""")
def classify_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = an.counts_over(table(spark, sf_dir, "events"), "user_id", 66).select("user_id", F.lit(True).alias("top"))
    kind = F.when(F.col("top"), "removed").when(F.col("location").isNull(), "none").otherwise("has location")
    return profiles(spark, sf_dir).join(top, "user_id", "left").groupBy(kind.alias("class")).agg(F.count("*").alias("cnt"))


# --- counts ----------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS cnt FROM events GROUP BY user_id HAVING count(*) > 60 ORDER BY cnt DESC, user_id")
def top_posters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.counts_over(table(spark, sf_dir, "events"), "user_id", 60).orderBy(F.desc("cnt"), "user_id")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 70)")
def semi_top_posters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return rows.join(an.counts_over(rows, "user_id", 70), "user_id", "left_semi")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 70)")
def anti_top_posters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return rows.join(an.counts_over(rows, "user_id", 70), "user_id", "left_anti")


@query("SELECT posts, count(*) AS users FROM (SELECT user_id, count(*) AS posts FROM events GROUP BY 1) GROUP BY 1")
def post_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.count_histogram(table(spark, sf_dir, "events"), "user_id")


@query("SELECT CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, count(*) AS cnt FROM events GROUP BY ALL ORDER BY y DESC, m, d, h")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h")]
    return table(spark, sf_dir, "events").groupBy(*parts).agg(F.count("*").alias("cnt")).orderBy(F.desc("y"), "m", "d", "h")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS cnt FROM events GROUP BY 1")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("cnt"))


@query(f"WITH {HOURLY_SQL} SELECT CAST(hour(hour) AS INTEGER) AS hod, round(avg(cnt), 6) AS hour_mean FROM hourly GROUP BY 1")
def hour_of_day_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.hour_means(an.hourly(table(spark, sf_dir, "events"))).withColumn("hour_mean", F.round("hour_mean", 6))


@query(f"WITH {HOURLY_SQL} SELECT min(hour)::TIMESTAMP AS earliest, max(hour)::TIMESTAMP AS latest, count(*) AS hours FROM hourly")
def hourly_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.hourly(table(spark, sf_dir, "events")).agg(F.min("hour").alias("earliest"), F.max("hour").alias("latest"), F.count("*").alias("hours"))


@query(f"""WITH {HOURLY_SQL}, means AS (SELECT hour(hour) AS hod, avg(cnt) AS hour_mean FROM hourly GROUP BY 1),
grid AS (SELECT unnest(range(min(hour)::TIMESTAMP, max(hour)::TIMESTAMP, INTERVAL 1 HOUR)) AS hour FROM hourly)
SELECT g.hour AS hour, coalesce(cnt, 0) AS cnt, round(hour_mean, 6) AS hour_mean FROM grid g LEFT JOIN hourly h ON h.hour = g.hour LEFT JOIN means ON hod = hour(g.hour)""")
def hourly_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.gap_filled(an.hourly(table(spark, sf_dir, "events"))).withColumn("hour_mean", F.round("hour_mean", 6))


@query(f"WITH {HOURLY_SQL} SELECT hour::TIMESTAMP AS hour, cnt, round(avg(cnt) OVER (PARTITION BY hour(hour)), 6) AS hour_mean FROM hourly")
def hourly_vs_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = an.hourly(table(spark, sf_dir, "events"))
    joined = series.withColumn("hod", F.hour("hour")).join(F.broadcast(an.hour_means(series)), "hod")  # 24 means
    return joined.select("hour", "cnt", F.round("hour_mean", 6).alias("hour_mean"))


@query("SELECT prev_ts, ts AS next_ts FROM (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev_ts FROM events) WHERE epoch_us(ts) - epoch_us(prev_ts) > 900000000")
def gap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.gaps(table(spark, sf_dir, "events"), "ts", 900)


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) % 6 AS INTEGER) AS alloc FROM events")
def allocate_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.allocated(table(spark, sf_dir, "events"), ["ts", "event_id"], 6, F.date_trunc("day", "ts")).select("event_id", "alloc")


@query(f"""WITH RECURSIVE {HOURLY_SQL}, steps AS (SELECT *, row_number() OVER (ORDER BY hour) AS k FROM hourly), fold AS (
  SELECT k, hour, cnt, cnt::DOUBLE * 0.04::DOUBLE + 0.0::DOUBLE * 0.96::DOUBLE AS ewma FROM steps WHERE k = 1
  UNION ALL SELECT s.k, s.hour, s.cnt, s.cnt::DOUBLE * 0.04::DOUBLE + f.ewma * 0.96::DOUBLE FROM fold f JOIN steps s ON s.k = f.k + 1)
SELECT hour::TIMESTAMP AS hour, cnt::DOUBLE AS cnt, round(ewma, 6) AS ewma FROM fold""")
def ewma_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = an.hourly(table(spark, sf_dir, "events")).select(F.lit("all").alias("cell"), "hour", F.col("cnt").cast("double").alias("cnt"))
    return an.smoothed(series, ["cell"], "hour", "cnt", 0.04).select("hour", "cnt", F.round("ewma", 6).alias("ewma"))


@query("SELECT event_id, user_id, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS latest FROM events")
def running_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    so_far = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.max("ts").over(so_far).alias("latest"))


@query(r"SELECT tag, count(*) AS cnt FROM (SELECT unnest(list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS tag FROM documents) GROUP BY tag ORDER BY cnt DESC, tag LIMIT 200")
def hashtag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.explode(F.array_remove(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), "")).alias("tag")
    return table(spark, sf_dir, "documents").select(tags).groupBy("tag").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "tag").limit(200)


@query(rf"SELECT domain, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(url, '{tx.DOMAIN}', 2)) AS domain FROM pages) GROUP BY domain ORDER BY cnt DESC, domain")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.explode(tx.domains(F.col("url"))).alias("domain")).groupBy("domain").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "domain")


@query(f"WITH {MENTIONS_SQL} SELECT * FROM mentions")
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir)


@query(f"WITH {MENTIONS_SQL} SELECT a.src, a.dst, a.cnt AS cnt_out, b.cnt AS cnt_in FROM mentions a JOIN mentions b ON a.src = b.dst AND a.dst = b.src WHERE a.cnt >= 3 AND b.cnt >= 3 AND a.src < a.dst")
def mutual_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.labelprop import mutual

    return mutual(mentions(spark, sf_dir), 3).where("src < dst")


@query(f"WITH {MESSAGES_SQL} SELECT user_id, count(*) AS n, string_agg(event_id, ',' ORDER BY event_id) AS ids, round(min(lat), 6) AS south, round(max(lat), 6) AS north FROM messages WHERE has_geo GROUP BY user_id")
def user_geotags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = messages(spark, sf_dir).where("geo IS NOT NULL").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "lat", "lon"))).alias("tags"))
    return tags.select("user_id", F.size("tags").cast("bigint").alias("n"), F.array_join(F.col("tags.event_id").cast("array<string>"), ",").alias("ids"), F.round(F.array_min("tags.lat"), 6).alias("south"), F.round(F.array_max("tags.lat"), 6).alias("north"))


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts)::TIMESTAMP AS start, event_type, count(*) AS cnt FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.counters import tumbling

    return tumbling(table(spark, sf_dir, "events"), "ts", "event_type", "15 minutes")


# --- scalar text -----------------------------------------------------------------------------


@query("SELECT doc_id, length(regexp_replace(text || chr(9731) || chr(128512) || 'x', '[\\x{2600}-\\x{27BF}\\x{1F300}-\\x{1F64F}\\x{1F680}-\\x{1F6FF}]', '', 'g')) AS n FROM documents")
def filter_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(tx.without_emoji(F.concat("text", F.lit("☃\U0001f600x")))).cast("bigint").alias("n"))


@query(rf"WITH {PROFILES_SQL} SELECT user_id, CAST(regexp_extract(location, '{tx.COORDINATES}', 1) AS DOUBLE) AS lat, CAST(regexp_extract(location, '{tx.COORDINATES}', 2) AS DOUBLE) AS lon FROM profiles WHERE regexp_matches(location, '{tx.COORDINATES}')")
def coord_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("user_id", tx.coordinates(F.col("location")).alias("c")).where("c IS NOT NULL").select("user_id", "c.lat", "c.lon")


@query(rf"WITH {PROFILES_SQL} SELECT user_id, regexp_extract(url, '\.([a-z]{{2,3}})([ /]|$)', 1) AS tld FROM profiles")
def tld_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("user_id", F.element_at(tx.top_level_domains(F.col("url")), 1).alias("tld"))


@query(rf"WITH {PROFILES_SQL} SELECT user_id, replace(trim(regexp_replace(time_zone, '\(.*\)', '')), ' ', '_') AS zone FROM profiles")
def tz_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("user_id", tx.zone_name(F.col("time_zone")).alias("zone"))


@query(f"WITH {PROFILES_SQL} SELECT user_id, CASE WHEN contains(time_zone, 'Pacific Time (US & Canada)') THEN 'PST' WHEN contains(time_zone, 'Eastern Time (US & Canada)') THEN 'EST' WHEN contains(time_zone, 'Central Time (US & Canada)') THEN 'CST' END AS code FROM profiles")
def tz_us_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("user_id", tx.us_code(F.col("time_zone")).alias("code"))


@query(f"WITH {PROFILES_SQL} SELECT user_id, array_to_string(list_filter(list_transform(string_split(location, '/'), lambda x: trim(x)), lambda x: x <> ''), '|') AS by_slash, array_to_string(list_filter(list_transform(string_split(location, '-'), lambda x: trim(x)), lambda x: x <> ''), '|') AS by_dash FROM profiles")
def loc_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda mark: F.array_join(tx.parts(F.col("location"), mark), "|")
    return profiles(spark, sf_dir).select("user_id", part("/").alias("by_slash"), part("-").alias("by_dash"))


@query("SELECT page_id, replace(list_extract(string_split(url, '/'), -1), '_', ' ') AS segment FROM pages")
def last_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.last_segment(F.col("url")).alias("segment"))


@query("SELECT n_nationkey, replace(n_name || ',' || n_regionkey, ',', ' OR ') AS terms FROM nation")
def track_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.or_terms(F.concat("n_name", F.lit(","), F.col("n_regionkey").cast("string"))).alias("terms"))


@query("SELECT event_id, format('{}:{}:{:02d}:{:02d}', event_id * 977 // 86400, event_id * 977 // 3600 % 24, event_id * 977 // 60 % 60, event_id * 977 % 60) AS up FROM events")
def format_uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.uptime(F.col("event_id") * 977).alias("up"))


@query("SELECT s_suppkey, len(list_filter(xs, lambda x: x > 10)) > 0 AS any_big, list_sum(xs)::BIGINT AS total, len(xs)::INTEGER AS n FROM (SELECT s_suppkey, [s_suppkey % 7, s_suppkey % 13, s_suppkey % 3] AS xs FROM supplier)")
def array_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = F.array(F.col("s_suppkey") % 7, F.col("s_suppkey") % 13, F.col("s_suppkey") % 3)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", xs.alias("xs"))
    return rows.select("s_suppkey", F.exists("xs", lambda x: x > 10).alias("any_big"), F.aggregate("xs", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size("xs").alias("n"))


@query("SELECT s_suppkey, list_reduce([s_suppkey % 7, s_suppkey % 13, s_suppkey % 3], lambda a, x: a * 10 + x)::BIGINT AS folded FROM supplier")
def list_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = F.array(F.col("s_suppkey") % 7, F.col("s_suppkey") % 13, F.col("s_suppkey") % 3)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.reduce(xs, F.lit(0).cast("bigint"), lambda a, x: a * 10 + x).alias("folded"))


@query(f"WITH {MENTIONS_SQL} SELECT p.i AS src, coalesce(m.cnt, 0) AS to_one, m.cnt IS NOT NULL AS knows_one FROM (SELECT DISTINCT src AS i FROM mentions) p LEFT JOIN mentions m ON m.src = p.i AND m.dst = 1")
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = mentions(spark, sf_dir).groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "cnt"))).alias("mentions"))
    one = F.lit(1).cast("bigint")
    return maps.select("src", F.coalesce(F.try_element_at("mentions", one), F.lit(0)).alias("to_one"), F.map_contains_key("mentions", one).alias("knows_one"))


@query("SELECT s_suppkey, s_name, coalesce(CASE WHEN s_nationkey % 2 = 0 THEN 'code' || s_nationkey END, 'old') AS code FROM supplier")
def dim_update_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit("code"), F.col("n_nationkey").cast("string")).alias("new"))
    rows = table(spark, sf_dir, "supplier").withColumn("code", F.lit("old"))
    return rows.join(new, "s_nationkey", "left").select("s_suppkey", "s_name", F.coalesce("new", "code").alias("code"))


@query("SELECT o_custkey AS query, o_orderkey AS hit, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.top_each(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("hit"), "rank")


@query("SELECT o_custkey AS query, o_orderkey AS hit, round(o_totalprice / first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), 6) AS belief FROM orders")
def belief_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    first = F.first("o_totalprice").over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("hit"), F.round(F.col("o_totalprice") / first, 6).alias("belief"))
