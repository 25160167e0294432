"""Operators on small tables with known answers."""

import math
import random
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starling.operators import analytics as an
from starling.operators import events as ed
from starling.operators import evidence as ev
from starling.operators import labelprop as lp
from starling.operators import raster as ra
from starling.operators import spatial as sp
from starling.operators.graph import components
from starling.sources import readers, sinks

T0 = datetime(2024, 1, 1)


def fold(messages, **params):
    """messages: (name, minute, latitude) on longitude 0."""
    return ed.serial(iter([(ord(n), m * 60.0, (lat, 0.0), r) for n, m, lat, r in messages]), ed.Params(**params))


def members(clusters):
    return ["".join(sorted(chr(m[0]) for m in c.messages)) for c in clusters]


CASE = [("A", 0, 51.0, 3), ("B", 10, 51.0, 3), ("C", 20, 51.0, 3), ("D", 40, 51.0, 3), ("E", 399, 55.0, 3), ("F", 401, 55.0, 3), ("G", 405, 51.0, 3)]


def test_attach_and_expire():
    f = fold(CASE)
    assert (members(f.old), members(f.active)) == (["ABCD"], [])
    assert sorted(chr(m[0]) for m in f.parked) == ["E", "F", "G"]
    assert f.old[0].latest == 2400


def test_revival():
    f = fold([m for m in CASE if m[0] != "F"])
    assert (members(f.old), members(f.active)) == ([], ["ABCDG"])


def test_create_then_merge():
    f = fold([("A", 0, 51.0, 3), ("B", 1, 51.0, 3), ("C", 2, 51.0, 3), ("D", 5, 51.11, 3), ("E", 6, 51.115, 3), ("F", 7, 51.075, 3)])
    assert members(f.active) == ["ABCDEF"]
    assert [c[0] for c in f.active[0].centres] == [51.0, 51.075]


def test_strict_time():
    assert fold([("A", 0, 51.0, 2), ("B", 30, 51.0, 2)]).active == []
    assert members(fold([("A", 0, 51.0, 2), ("B", 29.99, 51.0, 2)]).active) == ["AB"]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_shards_agree_with_one_fold(spark, seed):
    r = random.Random(seed)
    spots = [(50 + r.random() * 3, r.random() * 3) for _ in range(12)]
    rows, t = [], 0.0
    for k in range(150):
        t += r.choice([20, 300, 900, 4000])
        y, x = r.choice(spots)
        rows.append((k, T0 + timedelta(seconds=t), y + r.random() * 0.08, x + r.random() * 0.08, r.choice([2, 3])))
    got = ed.detect(spark.createDataFrame(rows, "id bigint, ts timestamp, lat double, lon double, required int")).collect()
    one = ed.serial(iter([(k, ts.timestamp(), (y, x), n) for k, ts, y, x, n in rows]), ed.Params())
    mine = sorted((g.status, tuple(sorted(m.id for m in g.messages)), len(g.centres)) for g in got)
    want = [("active", tuple(sorted(m[0] for m in c.messages)), len(c.centres)) for c in one.active] + [("old", tuple(sorted(m[0] for m in c.messages)), len(c.centres)) for c in one.old]
    parked = [g for g in mine if g[0] == "unclustered"]
    assert [g for g in mine if g[0] != "unclustered"] == sorted(want)
    last = max(ts for _, ts, *_ in rows).timestamp()
    assert {g[1][0] for g in parked} >= {m[0] for m in one.parked if last - m[1] <= 1800}


def test_detect_leaves_out_nulls_and_empty(spark):
    schema = "id bigint, ts timestamp, lat double, lon double, required int"
    assert ed.detect(spark.createDataFrame([], schema)).count() == 0
    assert ed.detect(spark.createDataFrame([(1, T0, None, 1.0, 2), (2, T0, 1.0, 1.0, None)], schema)).count() == 0


def test_near_pairs_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(k, T0 + timedelta(seconds=r.random() * 7200), 51 + r.random(), -1 + r.random()) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, lat double, lon double")
    got = {(p.a_id, p.b_id) for p in sp.near_pairs(df, df, 12.0, 60.0, 1200).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if ed.km(a[2:], b[2:]) < 12 and abs((a[1] - b[1]).total_seconds()) < 1200}
    assert got == want


def test_medoids(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 1.0), (1, 0.0, 3.0), (2, 5.0, 5.0), (3, None, 1.0)], "g int, lat double, lon double")
    got = {r.g: (r.lat, r.lon, r.km) for r in sp.medoids(rows, "g").collect()}
    assert got[1][:2] == (0.0, 1.0) and got[2] == (5.0, 5.0, 0.0) and 3 not in got


def test_label_propagation(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint")
    seed = spark.createDataFrame([(1, 51.0, 0.0, 0.0)], "user bigint, lat double, lon double, km double")
    at = lambda n: {r.user: (r.lat, r.iteration) for r in lp.propagate(edges, seed, n).collect()}
    assert 3 not in at(1) and at(2)[3] == (51.0, 2) and at(5)[3] == (51.0, 2)
    assert {(r.user, r.depth) for r in lp.network(edges, 1, 3).collect()} == {(1, 0), (2, 1), (3, 2)}
    both = lp.mutual(spark.createDataFrame([(1, 2, 3), (2, 1, 4), (1, 3, 9), (3, 1, 2)], "src bigint, dst bigint, cnt bigint"), 3)
    assert {(r.src, r.dst) for r in both.collect()} == {(1, 2), (2, 1)}


def square(x, y, w):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]


def test_stack(spark):
    schema = "key int, indicator string, ring array<struct<x:double,y:double>>, weight double"
    rows = [(1, "tag", square(0.1, 40.1, 3.8), 10.0), (1, "tz", square(2.1, 40.1, 9.8), 0.56), (1, "tag", square(0.1, 40.1, 3.8), 0.755), (2, "gn", square(-50.0, -20.0, 5.0), 1.0)]
    evidence = spark.createDataFrame(rows, schema)
    stack = {(r.key, r.gx, r.gy): round(r.weight, 3) for r in ra.stacked(ra.covered(evidence, 0.5)).collect()}
    assert stack[(1, 90, 24)] == 10.0 and stack[(1, 91, 24)] == 10.56 and stack[(1, 94, 24)] == 0.56
    tops = {(r.gx, r.gy) for r in ra.top_cells(ra.stacked(ra.covered(evidence, 0.5))).where("key = 1").collect()}
    assert (90, 24) in tops and (94, 24) not in tops
    fine = ra.infer(evidence)
    assert fine.where("key = 1").agg(F.max("best")).first()[0] == 10.56 and fine.where("key = 2").count() > 0
    assert ra.squares(fine).columns[-1] == "ring"


def brute_cells(ring, scale, box=None):
    """Cells whose centre is inside the ring or that hold a corner; with a box, those that touch it."""
    column, row = lambda x: math.floor((x + 180) * scale), lambda y: math.floor((90 - y) * scale)
    out = {(column(x), row(y)) for x, y in ring}
    (xa, xb), (ya, yb) = ((min(v), max(v)) for v in zip(*ring))
    for gx in range(column(xa), column(xb) + 1):
        for gy in range(row(yb), row(ya) + 1):
            x, y, odd = (gx + 0.5) / scale - 180, 90 - (gy + 0.5) / scale, False
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                odd ^= (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
            out |= {(gx, gy)} if odd else set()
    if box:
        x0, y0, x1, y1 = box
        out = {(x, y) for x, y in out if column(x0) <= x <= column(x1) and row(y1) <= y <= row(y0)}
    return out


def brute_tops(rows, scale, box=None):
    best, stack = {}, {}
    for name, ring, weight in rows:
        for cell in brute_cells(ring, scale, box):
            best[name, cell] = max(best.get((name, cell), 0), weight)
    for (_, cell), weight in best.items():
        stack[cell] = stack.get(cell, 0) + weight
    top = max(stack.values())
    return {cell for cell, weight in stack.items() if weight >= 0.75 * top - 1e-9}, top


def test_inference_equals_brute_force(spark):
    """Circles, squares, several polygons of one indicator, equal evidence of two keys, keys with one indicator."""
    draw, rows = random.Random(5), []
    for key in range(8):
        for name, weight in (("coordinate", 2.72), ("field", 1.51), ("website", 1.07), ("zone", 0.56), ("zone", 0.56)):
            if key and draw.random() < 0.35:
                continue
            x, y, size = draw.uniform(-4, 4), draw.uniform(48, 54), draw.uniform(0.3, 3.0)
            circle = [(x + 0.1013 * math.cos(k / 18 * math.pi), y + 0.1013 * math.sin(k / 18 * math.pi)) for k in range(36)]
            rows.append((key, name, circle if name == "coordinate" else square(x, y, size), weight))
    rows += [(99, *r[1:]) for r in rows if r[0] == 0]
    got = {}
    for r in ra.infer(spark.createDataFrame(rows, "key int, indicator string, ring array<struct<x:double,y:double>>, weight double")).collect():
        got.setdefault(r.key, (r.scale, round(r.best, 6), set()))[2].add((r.gx, r.gy))
    for key in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == key]
        xs, ys = zip(*brute_tops(own, 0.5)[0])
        box = (min(xs) * 2 - 182, 86 - max(ys) * 2, max(xs) * 2 - 176, 92 - min(ys) * 2)
        scale = math.floor(math.ceil(64800 / ((box[2] - box[0]) * (box[3] - box[1]))) ** 0.4)
        cells, top = brute_tops(own, scale, box)
        assert got[key] == (scale, round(top, 6), cells), key


def test_location_field_falls_back(spark):
    gaz = spark.createDataFrame([("Leeds", 1, "Leeds", "city, village", 4.0, -1.5, 53.8), ("Leeds", 2, "Leeds", "city", 2.0, 0.0, 50.0), ("Kent", 1, "Kent", "state, region", 1.0, 1.0, 51.0), ("UKX", 1, "UKX", "country", 1.0, 0.0, 52.0)], "query string, rank int, name string, fcl_name string, score double, lng double, lat double")
    areas = spark.createDataFrame([(1, "KENT", "kent", None, None, None, 0.0, 51.0, 1.0, 52.0)], "area_id int, n1 string, n2 string, n3 string, n4 string, n5 string, x0 double, y0 double, x1 double, y1 double")
    countries = spark.createDataFrame([("ukx", "uk", -5.0, 50.0, 2.0, 59.0)], "name string, tld string, x0 double, y0 double, x1 double, y1 double")
    rows = spark.createDataFrame([(1, "Leeds"), (2, "nowhere / Kent"), (3, "UKX-there"), (4, ""), (5, None), (6, "unknown")], "key int, location string")
    got = sorted((r.key, round(r.weight, 4)) for r in ev.location_field(rows, gaz, areas, countries).collect())
    assert got == [(1, 0.755), (1, 1.51), (2, 2.01), (3, 1.96)]
    both = spark.createDataFrame([(7, "Kent"), (8, "Kent")], "key int, location string")
    assert ev.location_field(both, gaz, areas, countries).count() == 2


def test_series(spark):
    hours = [T0, T0, T0 + timedelta(hours=2)] + [T0 + timedelta(hours=2, minutes=k) for k in range(3)] + [T0 + timedelta(hours=3)]
    series = an.hourly(spark.createDataFrame([(h,) for h in hours], "ts timestamp"))
    assert [(r.hour.hour, r.cnt) for r in an.gap_filled(series).orderBy("hour").collect()] == [(0, 2), (1, 0), (2, 4)]
    gaps = an.gaps(spark.createDataFrame([(T0,), (T0 + timedelta(hours=23, minutes=59),), (T0 + timedelta(hours=26),), (None,)], "ts timestamp"), "ts", 3600).collect()
    assert len(gaps) == 2
    assert an.gap_filled(an.hourly(spark.createDataFrame([], "ts timestamp"))).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(links).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and got[101] == 100
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_a_long_chain(spark):
    ids = list(range(1000))
    random.Random(0).shuffle(ids)
    links = spark.createDataFrame([*zip(ids[:-1], ids[1:], strict=True), (2000, 2001)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(1000), 0), 2000: 2000, 2001: 2000}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "tld.csv").write_text("ad, Andorra,\nfr, France,\n")
    assert [tuple(r) for r in readers.top_level_domains(spark, str(tmp_path / "tld.csv")).orderBy("code").collect()] == [("ad", "Andorra"), ("fr", "France")]
    (tmp_path / "pop.asc").write_text("ncols 3\nnrows 2\nxllcorner -1\nyllcorner 50\ncellsize 0.5\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    grid = sp.ascii_grid(spark, str(tmp_path / "pop.asc"))
    assert {(r.row, r.col): r.value for r in grid.collect()} == {(0, 0): 1, (0, 1): 2, (0, 2): 3, (1, 0): 4, (1, 1): -9999, (1, 2): 6}
    assert grid.first().cellsize == 0.5
    (tmp_path / "shapes.json").write_text('{"n1": "A", "poly": "[[(1, 2), (3, 4), (5, 6)]]"}\n')
    assert len(readers.polygons(spark, str(tmp_path / "shapes.json"), ["n1"]).first().poly[0]) == 3
    people = readers.user_profiles(spark.createDataFrame([(1, 9, [5, 5, 6], 1.0, 2.0), (1, 9, [5, 5, 6], 1.0, 2.0), (2, 9, [5], None, None)], "id int, user int, mentioned array<int>, lat double, lon double")).first()
    assert people.mentions == {"5": 3, "6": 1} and len(people.locations) == 1
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = sinks.updated(rows, spark.createDataFrame([(2, "c", 7)], "id int, v string, w int"), "id")
    assert {tuple(r) for r in new.select("id", "v", "w").collect()} == {(1, "a", None), (2, "c", 7)}
    sinks.json_lines(spark.range(10), str(tmp_path / "lines"), 3)
    assert len(list((tmp_path / "lines").glob("*.json"))) >= 4
    sinks.counts_csv(rows, str(tmp_path / "counts"))
    assert readers.listed(spark, str(tmp_path / "counts"), "k").count() == 2


def test_required_counts(spark):
    import pytest

    rows = spark.createDataFrame([(1, 50.0, 0.0), (2, 50.4, 0.5), (3, 80.0, 0.0)], "id int, lat double, lon double")
    assert [r.required for r in ed.with_required(rows, popfunc=lambda lon, lat: F.when(lon > 0, 7).otherwise(3)).orderBy("id").collect()] == [3, 7, 3]
    raster = spark.createDataFrame([(0, 0, 200.0), (0, 1, 900.0), (1, 0, 1.0), (1, 1, -9999.0)], "row int, col int, value double")
    grid = {"rows": 1, "cols": 2, "xll": 0.0, "yll": 50.0, "cell": 0.5}
    got = {r.id: r.required for r in ed.with_required(rows, raster=raster, grid=grid, least=2, middle=5).collect()}
    assert got == {1: 2, 2: 6, 3: None}
    with pytest.raises(TypeError):
        ed.with_required(rows)


def test_settings(tmp_path):
    import pytest

    from starling.sources.config import load

    (tmp_path / "a.ini").write_text("[multiindicator]\nTAG = 5\n[slp]\nmax_depth = 2\n[events]\ncluster_radius = 7.5\n")
    s = load(str(tmp_path / "a.ini"))
    assert (s.weights["TAG"], s.weights["TZ"], s.propagation.max_depth, s.detection.cluster_radius, s.detection.mincount) == (5.0, 0.56, 2, 7.5, 10)
    (tmp_path / "b.ini").write_text("[slp]\nnope = 2\n")
    with pytest.raises(ValueError):
        load(str(tmp_path / "b.ini"))


def test_contours_are_those_of_the_union():
    import numpy as np

    of = lambda cells, scale=1: ra.contours(*(np.array(v) for v in zip(*cells)), scale)
    area = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2
    assert np.allclose(of([(180, 89)]), [[(-0.01, -0.01), (1.01, -0.01), (1.01, 1.01), (-0.01, 1.01)]])
    (row,) = of([(180, 89), (181, 89), (182, 89)])
    assert len(row) == 4 and abs(area(row) - 3.02 * 1.02) < 1e-9
    (corner,) = of([(180, 89), (181, 88)])  # squares a little wide overlap at the corner
    assert len(corner) == 8 and abs(area(corner) - (2 * 1.02**2 - 0.02**2)) < 1e-9
    ringed = of([(x, y) for x in range(180, 183) for y in range(80, 83) if (x, y) != (181, 81)])
    assert sorted(round(area(r), 6) for r in ringed) == [round(-(0.98**2), 6), round(3.02**2, 6)]
    assert len(of([(180, 80), (184, 80)], 20)) == 2


def test_results_hold_merged_contours(spark):
    schema = "key int, indicator string, ring array<struct<x:double,y:double>>, weight double"
    rows = [(1, "tz", square(2.1, 40.1, 3.8), 0.56), (2, "ws", square(2.1, 40.1, 3.8), 1.0), (2, "ws", square(30.0, 40.1, 3.8), 1.0), (3, "tz", square(2.1, 40.1, 3.8), 0.56)]
    got = {r.key: r for r in ra.results(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (len(r.poly), r.inds, r.polys) for k, r in got.items()} == {1: (1, 1, 1), 2: (2, 1, 2), 3: (1, 1, 1)}
    assert got[1].poly == got[3].poly and abs(got[1].weight - 0.42) < 1e-9


def test_near_counts_equal_brute_force(spark):
    r = random.Random(6)
    rows = [(k, T0 + timedelta(seconds=r.random() * 7200), 51 + r.random() * 0.4, -1 + r.random() * 0.4) for k in range(300)]
    rows += [(300 + k, T0 + timedelta(seconds=r.randrange(1200)), 51 + k % 7 * 0.03, -1.0) for k in range(1500)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, lat double, lon double")
    got = {p.id: p.near for p in sp.near_counts(df, "id", 12.0, 60.0, 1_200_000_000, 1).collect()}
    near = {(a, b) for a in {x[2:] for x in rows} for b in {x[2:] for x in rows} if ed.km(a, b) < 12}
    assert got == {a[0]: sum(0 <= (a[1] - b[1]).total_seconds() < 1200 and (a[2:], b[2:]) in near for b in rows) for a in rows}


def test_near_pairs_do_not_broadcast_their_copies(spark):
    df = spark.createDataFrame([(1, T0, 51.0, 0.0)], "id int, ts timestamp, lat double, lon double")
    plan = sp.near_pairs(df, df, 12.0, 60.0, 1200)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_tallied_folds_are_the_same_but_for_members(spark):
    r, t, rows = random.Random(11), 0, []
    for k in range(400):
        t += r.choice([20, 300, 900, 4000])
        rows.append((k, T0 + timedelta(seconds=t), 51 + r.randrange(8) * 0.03, r.choice([0.0, 3.0]), r.choice([2, 3])))
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, lat double, lon double, required int")
    of = lambda rows, size: sorted((g.status, g.cluster_id, size(g.messages), len(g.centres), g.start, g.finish) for g in rows)
    assert of(ed.detect(df, tallied=True).collect(), int) == of(ed.detect(df).collect(), len)
    one = ed.serial(iter([(k, ts.timestamp(), (y, x), n) for k, ts, y, x, n in rows]), ed.Params())
    assert sorted(n for s, _, n, *_ in of(ed.detect(df, tallied=True).collect(), int) if s != "unclustered") == sorted(len(c.messages) for c in [*one.active, *one.old])
