"""Geodesy and plane geometry as Column expressions; no Python on the executors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS-84 (fixed values), and the mean radius of the sphere for haversine distances, in km.
MAJOR, FLATTENING, RADIUS = 6378.137, 1 / 298.257223563, 6371.0088
#: The ellipsoid of geodesic circles: equatorial radius in km (fixed value).
SHOOT_MAJOR = 6378.13
STEPS = 12


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    rad = lambda c: F.radians(c)
    s = F.pow(F.sin(rad(lat2 - lat1) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(rad(lon2 - lon1) / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(s))) * (2 * RADIUS)


HAVERSINE_SQL = f"2 * {RADIUS}::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({{lat2}} - {{lat1}}) / 2), 2) + cos(radians({{lat1}})) * cos(radians({{lat2}})) * pow(sin(radians({{lon2}} - {{lon1}}) / 2), 2))))"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return HAVERSINE_SQL.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


def let(**values: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def then(f, **values: Column) -> Column:
    """f of named values, each worked out once however often f names it."""
    return F.transform(F.array(let(**values)), f)[0]


def vincenty(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Ellipsoidal distance in km by Vincenty's inverse method in a fixed number of steps.

    Equal points are 0 km apart. Nearly opposite points, for which the method doesn't settle, have no value (null).
    """
    f, b = FLATTENING, MAJOR * (1 - FLATTENING)
    u1, u2, gap = F.atan(F.tan(F.radians(lat1)) * (1 - f)), F.atan(F.tan(F.radians(lat2)) * (1 - f)), F.radians(lon2 - lon1)
    start = let(lam=gap, was=F.lit(1e9), sig=F.lit(0.0), sins=F.lit(0.0), coss=F.lit(1.0), cos2a=F.lit(0.0), c2m=F.lit(0.0))

    def step(k: Column, s: Column) -> Column:
        def sides(t: Column) -> Column:
            sins = F.sqrt(F.pow(k["cu2"] * t["sl"], 2) + F.pow(k["cu1"] * k["su2"] - k["su1"] * k["cu2"] * t["cl"], 2))
            return then(lambda u: arc(t, u), sins=sins, coss=k["su1"] * k["su2"] + k["cu1"] * k["cu2"] * t["cl"])

        def arc(t: Column, u: Column) -> Column:
            sina = F.when(u["sins"] == 0, 0.0).otherwise(k["cu1"] * k["cu2"] * t["sl"] / F.nullif(u["sins"], F.lit(0.0)))
            return then(lambda v: then(lambda w: middle(u, v, w["cos2a"]), cos2a=1 - v["sina"] * v["sina"]), sig=F.atan2(u["sins"], u["coss"]), sina=sina)

        def middle(u: Column, v: Column, cos2a: Column) -> Column:
            c2m = F.when(cos2a == 0, 0.0).otherwise(u["coss"] - 2 * k["su1"] * k["su2"] / F.nullif(cos2a, F.lit(0.0)))
            return then(lambda x: last(u, v, cos2a, x), c2m=c2m, c=f / 16 * cos2a * (4 + f * (4 - 3 * cos2a)))

        def last(u: Column, v: Column, cos2a: Column, x: Column) -> Column:
            lam = k["gap"] + (1 - x["c"]) * f * v["sina"] * (v["sig"] + x["c"] * u["sins"] * (x["c2m"] + x["c"] * u["coss"] * (2 * x["c2m"] * x["c2m"] - 1)))
            return let(lam=lam, was=s["lam"], sig=v["sig"], sins=u["sins"], coss=u["coss"], cos2a=cos2a, c2m=x["c2m"])

        return F.when(s["lam"] == s["was"], s).otherwise(then(sides, sl=F.sin(s["lam"]), cl=F.cos(s["lam"])))  # a settled angle gives itself

    def close(s: Column) -> Column:
        aa, bb = series(s["cos2a"], MAJOR)
        more = lambda v: v["bb"] * s["sins"] * (s["c2m"] + v["bb"] / 4 * (s["coss"] * (2 * s["c2m"] * s["c2m"] - 1) - v["bb"] / 6 * s["c2m"] * (4 * s["sins"] * s["sins"] - 3) * (4 * s["c2m"] * s["c2m"] - 3)))
        return F.when(F.abs(s["lam"] - s["was"]) < 1e-9, then(lambda v: b * v["aa"] * (s["sig"] - more(v)), aa=aa, bb=bb))

    def settled(k: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, _: step(k, s), close)

    same = (lat1 == lat2) & (lon1 == lon2)
    return F.when(same, 0.0).otherwise(then(settled, su1=F.sin(u1), cu1=F.cos(u1), su2=F.sin(u2), cu2=F.cos(u2), gap=gap))


def series(cos2_alpha: Column, major: float) -> tuple[Column, Column]:
    """Vincenty's A and B for a geodesic of the given azimuth at the equator."""
    minor = major * (1 - FLATTENING)
    u2 = cos2_alpha * ((major**2 - minor**2) / minor**2)
    return 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))


def shoot(lon: Column, lat: Column, azimuth: Column, km: Column) -> Column:
    """struct(lon, lat, back): where a geodesic of km ends, and the azimuth back, in degrees. Null at the poles.

    Vincenty's direct method in a fixed number of steps; longitudes come out in [-180, 180).
    """
    f, minor = FLATTENING, SHOOT_MAJOR * (1 - FLATTENING)
    reduced, bearing = F.atan(F.tan(F.radians(lat)) * (1 - f)), F.radians(azimuth)
    sin_alpha = F.cos(reduced) * F.sin(bearing)
    cos2_alpha = 1 - sin_alpha * sin_alpha
    big, small = series(cos2_alpha, SHOOT_MAJOR)
    known = dict(base=km / (minor * big), first=F.atan2(F.tan(reduced), F.cos(bearing)), small=small, sa=sin_alpha, c2=cos2_alpha, su=F.sin(reduced), cu=F.cos(reduced), sb=F.sin(bearing), cb=F.cos(bearing), lon=F.radians(lon))
    start = let(arc=km / (minor * big), **known)

    def step(s: Column) -> Column:
        mid, k = F.cos(2 * s["first"] + s["arc"]), s["small"]
        inner = F.cos(s["arc"]) * (2 * mid * mid - 1) - k / 6 * mid * (4 * F.pow(F.sin(s["arc"]), 2) - 3) * (4 * mid * mid - 3)
        return let(arc=s["base"] + k * F.sin(s["arc"]) * (mid + k / 4 * inner), **{n: s[n] for n in known})

    def close(s: Column) -> Column:
        sin, cos, mid = F.sin(s["arc"]), F.cos(s["arc"]), F.cos(2 * s["first"] + s["arc"])
        up = s["su"] * cos + s["cu"] * sin * s["cb"]
        aside = s["su"] * sin - s["cu"] * cos * s["cb"]
        turned = F.atan2(sin * s["sb"], s["cu"] * cos - s["su"] * sin * s["cb"])
        c = f / 16 * s["c2"] * (4 + f * (4 - 3 * s["c2"]))
        gone = turned - (1 - c) * f * s["sa"] * (s["arc"] + c * sin * (mid + c * cos * (2 * mid * mid - 1)))
        east, back = F.degrees(s["lon"] + gone), F.degrees(F.atan2(s["sa"], -aside)) + 180
        return let(lon=east - F.floor((east + 180) / 360) * 360, lat=F.degrees(F.atan2(up, (1 - f) * F.sqrt(s["sa"] * s["sa"] + aside * aside))), back=back - F.floor(back / 360) * 360)

    return F.when(F.abs(lat) < 90 - 1e-9, F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, _: step(s), close))


def geodesic_circle(lon: Column, lat: Column, km: Column, points: int = 360) -> Column:
    """A closed ring of points at one distance, one for each azimuth."""
    ring = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda a: shoot(lon, lat, a * (360.0 / points), km))
    ring = F.transform(ring, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return F.concat(ring, F.slice(ring, 1, 1))


def circle(x: Column, y: Column, radius: float = 0.1, points: int = 32) -> Column:
    """A plane ring of points around (x, y)."""
    turn = lambda k: k * (2 * math.pi / points)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.struct((x + F.cos(turn(k)) * radius).alias("x"), (y + F.sin(turn(k)) * radius).alias("y")))


def square(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a ring (array of struct(x, y)), by crossings of a ray to the right."""
    n = F.size(ring)
    ahead = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, ahead, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    cross = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != F.coalesce(cross(e), F.lit(False)))


def inside_fixed(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """The same for a ring known beforehand: plain arithmetic, inside generated code."""
    out = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            out = out != (((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (F.lit(x2) - F.lit(x1)) * (y - F.lit(y1)) / (F.lit(y2) - F.lit(y1)) + F.lit(x1)))
    return out


def rings(text: Column) -> Column:
    """All rings, holes too, of a polygon or multipolygon written as nested tuples of (x, y)."""
    nested = F.translate(text, "() ", "[]")
    poly, multi = F.from_json(nested, "array<array<array<double>>>"), F.from_json(nested, "array<array<array<array<double>>>>")
    point = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    deep = nested.rlike(r"^\[\[\[\[")
    return F.transform(F.when(deep, F.flatten(multi)).otherwise(poly), point)


def to_cell(lon: Column, lat: Column, xll: float, yll: float, cell: float, rows: int) -> tuple[Column, Column]:
    """(row, col) of a raster whose row 0 is the northern edge; halves round to even."""
    col = F.rint(F.abs(lon - xll) / cell)
    return (F.lit(rows) - F.rint(F.abs(lat - yll) / cell)).cast("int"), col.cast("int")


def of_cell(row: Column, col: Column, xll: float, yll: float, cell: float, rows: int) -> tuple[Column, Column]:
    """(lon, lat) of a raster's cell."""
    return col * F.lit(cell) + xll, (F.lit(rows) - row) * F.lit(cell) + yll


def required(x: Column, a: float, b: float, least: int) -> Column:
    """How many messages make an event where x people live: ceil(a ln(b x)), or least where nobody does."""
    return F.when(x > 0, F.ceil(F.round(F.lit(a) * F.log(F.lit(b) * x), 9)).cast("int")).otherwise(F.lit(least))


def curve(x1: float, x2: float, y1: float, y2: float) -> tuple[float, float]:
    """(a, b) of the logarithmic curve through (x1, y1) and (x2, y2)."""
    if x1 <= 0 or x2 <= 0 or x1 == x2:
        raise ValueError("the curve needs two different populations over 0")
    return (y1 - y2) / math.log(x1 / x2), math.exp((y2 * math.log(x1) - y1 * math.log(x2)) / (y1 - y2))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
