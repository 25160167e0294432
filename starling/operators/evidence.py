"""Indicators: each turns a field of messages or profiles into evidence (key, indicator, ring, weight).

A registry names them, so that others can be added; an indicator is a function from DataFrames to a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from ..sources.storage import stored
from . import lookups as lk

#: Weights of the indicators (fixed values): geotag, coordinates, message, location field and its fallbacks, website, zone.
WEIGHTS = {"TAG": 10.0, "COD": 2.72, "SP": 0.67, "GN": 1.51, "GN_1": 2.01, "GN_2": 1.96, "GN_3": 1.96, "WS_1": 1.07, "TZ": 0.56}
INDICATORS: dict[str, Callable[..., DataFrame]] = {}


def indicator(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    INDICATORS[f.__name__] = f
    return f


def emitted(rows: DataFrame, name: str, ring: Column, weight: str | Column, belief: Column | None = None) -> DataFrame:
    """Evidence of rows with a key: the indicator's weight times the belief."""
    w = weight if isinstance(weight, Column) else F.lit(WEIGHTS[weight])
    return rows.select("key", F.lit(name).alias("indicator"), ring.alias("ring"), (w * belief if belief is not None else w).alias("weight")).where("ring IS NOT NULL")


def box() -> Column:
    """The square of columns x0, y0, x1, y1."""
    return geo.square(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))


@indicator
def geotag(rows: DataFrame, test: bool = False) -> DataFrame:
    """A circle at the point of geo (type, coordinates = [lat, lon]); nothing in test mode."""
    rows = rows.where((F.col("geo.type") == "Point") & (not test))
    return emitted(rows, "geotag", geo.circle(F.col("geo.coordinates")[1], F.col("geo.coordinates")[0]), "TAG")


@indicator
def coordinate(rows: DataFrame, transposed: bool = False) -> DataFrame:
    """A circle at coordinates written in location; transposed plots (lat, lon) as (x, y)."""
    rows = rows.withColumn("c", tx.coordinates(F.col("location"))).where("c IS NOT NULL")
    x, y = (F.col("c.lat"), F.col("c.lon")) if transposed else (F.col("c.lon"), F.col("c.lat"))
    return emitted(rows, "coordinate", geo.circle(x, y), "COD")


@indicator
def website(rows: DataFrame, countries: DataFrame) -> DataFrame:
    """The countries of the top-level domains of url."""
    hits = rows.select("key", F.explode(tx.top_level_domains(F.col("url"))).alias("tld"))
    return emitted(hits.join(countries, "tld"), "website", box(), "WS_1")


@indicator
def time_zone(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """American zones of a United States name's code; else zones whose name holds the field's."""
    rows = rows.select("key", tx.us_code(F.col("time_zone")).alias("us"), tx.zone_name(F.col("time_zone")).alias("name"))
    a = lk.american(rows.where("us IS NOT NULL"), zones, "us")
    b = lk.by_part(rows.where("us IS NULL"), zones, "name")
    return emitted(a, "time_zone", box(), "TZ").unionByName(emitted(b, "time_zone", box(), "TZ"))


@indicator
def zone_offset(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones of the field's offset from UTC."""
    return emitted(lk.by_offset(rows, zones, "utc_offset"), "zone_offset", box(), "TZ")


@indicator
def message(rows: DataFrame, annotations: DataFrame, entities: DataFrame, areas: DataFrame, weight: str = "SP", name: str = "message") -> DataFrame:
    """Places named in text: annotations (text, uri, types, similarity) of places, by the entity's name an area, else
    its point (georss "lat lon", else lat_d, lon_d). Empty texts name nothing."""
    hits = rows.where("text <> ''").select("key", "text").join(annotations.where(F.col("types").contains("Schema:Place")), "text")
    hits = hits.withColumn("name", tx.last_segment(F.col("uri"))).withColumn("hit", F.xxhash64("key", "uri"))
    by_area = lk.by_any_name(hits.select("key", "name", "similarity", "hit"), areas, "name")
    left = hits.join(by_area.select("hit").distinct(), "hit", "left_anti").join(entities, "name")
    at = F.split("georss_point", " ")
    lat, lon = F.coalesce(F.try_element_at(at, F.lit(1)).cast("double"), F.col("lat_d")), F.coalesce(F.try_element_at(at, F.lit(2)).cast("double"), F.col("lon_d"))
    points = left.withColumns({"lat": lat, "lon": lon}).where("lat IS NOT NULL AND lon IS NOT NULL")
    return emitted(by_area, name, box(), weight, F.col("similarity")).unionByName(emitted(points, name, geo.circle(F.col("lon"), F.col("lat")), weight, F.col("similarity")))


def gazetted(asked: DataFrame, gazetteer: DataFrame, areas: DataFrame, countries: DataFrame, weight: str, name: str) -> DataFrame:
    """Evidence of (key, query) by a gazetteer (query, rank, name, fcl_name, score, lng, lat).

    Belief is the score over the first hit's. A country's polygon if the class says so and there is one; else an
    area's for states and regions; else a circle at the point.
    """
    first = gazetteer.groupBy("query").agg(F.min_by("score", "rank").alias("top"))
    hits = asked.join(gazetteer, "query").join(first, "query").withColumn("belief", F.col("score") / F.col("top")).withColumn("hit", F.xxhash64("key", "query", "rank"))
    kind = F.lower("fcl_name")
    cols = ["key", "hit", "name", "belief", "fcl_name", "lng", "lat"]
    hits = stored(hits.select(*cols))  # read five times below
    one = lk.by_name(hits.where(kind.contains("country")), countries.withColumnRenamed("name", "country"), "name", "country")
    rest = hits.join(one.select("hit").distinct(), "hit", "left_anti")
    two = lk.by_any_name(rest.where(kind.contains("state") | kind.contains("region")).select("key", "name", "belief", "hit"), areas, "name")
    three = rest.join(two.select("hit").distinct(), "hit", "left_anti")
    out = [emitted(one, name, box(), weight, F.col("belief")), emitted(two, name, box(), weight, F.col("belief")), emitted(three, name, geo.circle(F.col("lng"), F.col("lat")), weight, F.col("belief"))]
    return reduce(DataFrame.unionByName, out)


@indicator
def location_field(rows: DataFrame, gazetteer: DataFrame, areas: DataFrame, countries: DataFrame, annotated: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The location field as a whole; where that gives nothing its parts between slashes, then between dashes, then annotations."""
    rows = rows.where("location IS NOT NULL").select("key", "location")
    stage = stored(gazetted(rows.select("key", F.col("location").alias("query")), gazetteer, areas, countries, "GN", "location_field"))
    out, left = stage, rows
    for mark, weight in (("/", "GN_1"), ("-", "GN_2")):
        left = left.join(stage.select("key").distinct(), "key", "left_anti")
        split = left.withColumn("parts", tx.parts(F.col("location"), mark)).where("size(parts) > 1").select("key", F.explode("parts").alias("query"))
        stage = stored(gazetted(split, gazetteer, areas, countries, weight, "location_field"))
        out = out.unionByName(stage)
    if annotated is not None:
        left = left.join(stage.select("key").distinct(), "key", "left_anti")
        out = out.unionByName(annotated(left.withColumnRenamed("location", "text")))
    return out


@indicator
def gis_field(rows: DataFrame, gazetteer: DataFrame, areas: DataFrame, limit: int = 5) -> DataFrame:
    """The location field by the other gazetteer (query, rank, name, placetype, score, max_score, lng, lat).

    Belief is score over the best; administrative places and cities take an area's polygon, others their point; at
    most ``limit`` hits of a query. Whole field first, then parts between commas, then between spaces.
    """
    rows = rows.where("location <> ''").select("key", "location")
    out = left = None
    for mark in (None, ",", " "):
        if mark is None:
            left, asked = rows, rows.select("key", F.col("location").alias("query"))
        else:
            left = left.join(stage.select("key").distinct(), "key", "left_anti")
            asked = left.withColumn("parts", tx.parts(F.col("location"), mark)).where("size(parts) > 1").select("key", F.explode("parts").alias("query"))
        hits = asked.join(gazetteer.where(F.col("rank") <= limit), "query").withColumn("belief", F.col("score") / F.col("max_score")).withColumn("hit", F.xxhash64("key", "query", "rank"))
        named = hits.where(F.col("placetype").contains("Adm") | F.col("placetype").contains("City")).select("key", "name", "belief", "hit")
        area = lk.by_any_name(named, areas, "name")
        points = hits.join(area.select("hit").distinct(), "hit", "left_anti")
        stage = stored(emitted(area, "gis_field", box(), "GN", F.col("belief")).unionByName(emitted(points, "gis_field", geo.circle(F.col("lng"), F.col("lat")), "GN", F.col("belief"))))
        out = stage if out is None else out.unionByName(stage)
    return out


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
