"""The streaming operators on replayed files."""

import json
import os
from datetime import datetime, timedelta

from starling.operators.events import Params, serial
from starling.streaming.collect import start
from starling.streaming.counters import report
from starling.streaming.events import stream_clusters

T0 = datetime(2024, 1, 1)


def test_collection_keeps_and_calls_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"text": "Hello there", "timestamp_ms": "1000"}, {"text": "nothing", "timestamp_ms": "2000"}, {"timestamp_ms": "3000"}]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("text string, timestamp_ms string").json(str(tmp_path / "in"))
    seen = []
    q = start(stream, "greetings", "hello", str(tmp_path / "out"), str(tmp_path / "cp"), [None, lambda name, batch, _: seen.append((name, batch.count()))])
    q.processAllAvailable()
    q.stop()
    assert seen == [("greetings", 1)]
    assert spark.read.parquet(str(tmp_path / "out")).first().timestamp_obj == datetime(1970, 1, 1, 0, 0, 1)


def test_counters_report_finished_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "ts timestamp, name string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for k, minutes in enumerate([(1, 2, 11), (40,), (90,)]):
        path = tmp_path / f"in/{k}.json"
        path.write_text("\n".join(json.dumps({"ts": (T0 + timedelta(minutes=m)).isoformat(), "name": "a"}) for m in minutes))
        os.utime(path, (1e9 + k, 1e9 + k))
    got = []
    q = report(stream, "ts", "name", "10 minutes", "5 minutes", str(tmp_path / "cp"), [lambda b, _: got.extend((r.start.minute, r.cnt) for r in b.collect())])
    q.processAllAvailable()
    q.stop()
    assert {(0, 2), (10, 1)} <= set(got)


def test_stream_agrees_with_one_fold(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(k, 60.0 * k, (51.0 + k % 3 * 0.01, 0.0), 3) for k in range(12)]
    for f in range(3):
        part = rows[4 * f : 4 * f + 4]
        path = tmp_path / f"in/{f}.json"
        path.write_text("\n".join(json.dumps({"region": "x", "id": i, "ts": (T0 + timedelta(seconds=t)).isoformat(), "lat": p[0], "lon": p[1], "required": n}) for i, t, p, n in part))
        os.utime(path, (1e9 + f, 1e9 + f))  # files are read oldest first
    stream = spark.readStream.schema("region string, id bigint, ts timestamp, lat double, lon double, required int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    batches = []
    q = stream_clusters(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: batches.append(b.collect())).start()
    q.processAllAvailable()
    q.stop()
    want = serial(iter(rows), Params())
    got = [sorted(m.id for m in r.messages) for r in batches[-1] if r.status == "active"]
    assert got == [sorted(m[0] for m in c.messages) for c in want.active]
