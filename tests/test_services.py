"""Retries, providers, shapefiles, caches, progress and detection as one operator."""

import json
import struct
from datetime import datetime, timedelta
from itertools import islice

import pytest
from pyspark.sql import functions as F

from starling.operators.events import EventDetection, Params, serial
from starling.operators.labelprop import infer
from starling.sources import config, providers, retry, shapefile, sinks
from starling.streaming.collect import start_all
from starling.streaming.progress import watched


def test_delays():
    assert list(islice(retry.patient(), 10)) == [0.5, 1, 2, 4, 8, 16, 32, 64, 64, 64]
    assert list(retry.doubling()) == [1, 2, 4, 8, 16] and list(retry.counted()) == [0, 1, 2, 3, 4]


def test_supervised_follows_the_policy_of_the_exception():
    said, waits = iter([OSError, KeyError, OSError, None]), []

    def action():
        if e := next(said):
            raise e()
        return "done"

    assert retry.supervised(action, {OSError: retry.patient, KeyError: retry.fixed(120.0)}, waits.append) == "done" and waits == [0.5, 120.0, 1.0]
    with pytest.raises(ValueError):
        retry.supervised(lambda: int("x"), {OSError: retry.patient}, waits.append)
    waits.clear()
    with pytest.raises(OSError):
        retry.supervised(lambda: open("/nowhere/at/all"), {OSError: retry.counted}, waits.append)
    assert waits == [0, 1, 2, 3, 4]


def test_providers_answer_each_question_once(spark):
    asked = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "query string")
    offline = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("c", 1, "z")], "query string, rank int, name string")
    assert sorted(map(tuple, providers.Table(offline).answers(asked).collect())) == [("a", 1, "x"), ("a", 2, "y")]
    assert providers.Table(offline, 1).answers(asked).count() == 1
    live = providers.Service(lambda q: json.dumps([{"name": q + "1"}, {"name": q + "2"}]) if q == "a" else None, "name string", partitions=2)
    assert sorted(map(tuple, live.answers(asked).collect())) == [("a", 1, "a1"), ("a", 2, "a2")]


def test_shapefiles(spark, tmp_path):
    square, hole = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)], [(0.5, 0.5), (1.0, 0.5), (0.5, 1.0), (0.5, 0.5)]
    records = [[square, hole], None, [hole]]
    body = b""
    for k, rings in enumerate(records):
        if rings is None:
            own = struct.pack("<i", 0)
        else:
            flat = [v for r in rings for p in r for v in p]
            begin, n = [], 0
            for r in rings:
                begin.append(n)
                n += len(r)
            own = struct.pack("<i4d2i", 5, 0, 0, 2, 2, len(rings), n) + struct.pack(f"<{len(begin)}i", *begin) + struct.pack(f"<{len(flat)}d", *flat)
        body += struct.pack(">2i", k + 1, len(own) // 2) + own
    (tmp_path / "a.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body)
    fields = [("NAME", 8), ("CODE", 3)]
    head = struct.pack("<4BIHH20x", 3, 115, 1, 1, 3, 32 + 32 * len(fields) + 1, 12) + b"".join(struct.pack("<11sc4xBB14x", n.encode(), b"C", w, 0) for n, w in fields) + b"\r"
    (tmp_path / "a.dbf").write_bytes(head + b"".join(b" " + n.ljust(8).encode() + c.ljust(3).encode() for n, c in (("one", "x"), ("zwei", "y"), ("", "z"))))
    got = shapefile.polygons(spark, str(tmp_path), ["NAME", "CODE", "more"]).collect()
    assert [(r.NAME, r.CODE, r.more) for r in got] == [("one", "x", None), ("zwei", "y", None), ("", "z", None)]
    assert [None if r.poly is None else [[tuple(p) for p in ring] for ring in r.poly] for r in got] == records


def test_searches_have_queries_of_their_own_and_batches_are_stored_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"text": t, "timestamp_ms": "1000"}) for t in ("red sky", "blue sky", "red blue", "none")))
    stream = spark.readStream.schema("text string, timestamp_ms string").json(str(tmp_path / "in"))
    said, seen = [], []
    listener = watched(spark, said.append, 2)
    found = start_all(stream, {"r": "red", "b": "blue"}, str(tmp_path / "out"), str(tmp_path / "cp"), [lambda name, batch, k: seen.append((name, batch.count()))])
    for q in found.values():
        q.processAllAvailable()
        q.stop()
    spark.streams.removeListener(listener)
    assert sorted(seen) == [("b", 2), ("r", 2)]
    assert all(spark.read.parquet(str(tmp_path / f"out/{k}")).count() == 2 for k in "rb")


def test_settings_by_any_path(spark, tmp_path):
    (tmp_path / "s.ini").write_text("[slp]\nmax_depth = 5\n[events]\ncluster_radius = 2.5\n")
    for settings in (config.load(str(tmp_path / "s.ini")), config.load(f"file://{tmp_path}/s.ini", spark)):
        assert settings.propagation.max_depth == 5 and settings.detection.cluster_radius == 2.5


def test_unique_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (None, 1, "n"), (2, 9, None)], "k int, at int, x string")
    assert sorted(map(tuple, sinks.unique(rows, "k", "at").collect()), key=str) == sorted([(1, 3, "a"), (None, 1, "n"), (2, 9, None)], key=str)


def test_detection_equals_one_fold(spark):
    t0 = datetime(2024, 1, 1)
    places = [(50 + (k * 7 % 5) * 0.5 + k % 3 * 0.004, -3 + (k * 11 % 4) * 0.7) for k in range(400)]
    rows = [(k, t0 + timedelta(minutes=k * 3 % 977), {"coordinates": [p[0], p[1]]} if k % 9 else None) for k, p in enumerate(places)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, geo struct<coordinates:array<double>>")
    params = Params(radius=2.0)
    got = EventDetection(popfunc=lambda lon, lat: F.when(lat > 51, 3).otherwise(4), params=params).run(df).collect()
    ordered = sorted(((t, k, places[k]) for k, t, g in rows if g), key=lambda x: x[:2])
    fold = serial(((k, t.timestamp(), p, 3 if p[0] > 51 else 4) for t, k, p in ordered), params)
    want = sorted([*(("active", sorted(m[0] for m in c.messages)) for c in fold.active), *(("old", sorted(m[0] for m in c.messages)) for c in fold.old), *(("unclustered", [m[0]]) for m in fold.parked)])
    assert sorted((r.status, sorted(m.id for m in r.messages)) for r in got) == want
    with pytest.raises(TypeError):
        EventDetection()
    with pytest.raises(TypeError):
        EventDetection(popfunc=lambda lon, lat: F.lit(1), popmap=df)


def test_inference_of_one_user(spark):
    mentions = spark.createDataFrame([(a, b, 4) for a, b in ((1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3), (8, 9), (9, 8))], "src bigint, dst bigint, cnt bigint")
    tags = spark.createDataFrame([(4, 50.0, 1.0), (1, 10.0, 20.0), (9, 1.0, 1.0)], "user bigint, lat double, lon double")
    assert [(r.user, r.lat, r.iteration) for r in infer(mentions, tags, 1).collect()] == [(1, 10.0, 0)]
    assert [(r.user, r.lat, r.iteration) for r in infer(mentions, tags, 1, test=True).collect()] == [(1, 50.0, 3)]
    assert infer(mentions, tags, 1, test=True, rounds=2).collect() == [] and infer(mentions, tags, 7).collect() == []
