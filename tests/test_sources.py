"""The REST source, stream and sink against a small service, and files of several blocks."""

import json
import threading
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from gridloom.sources import converters, rest

T0 = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture
def service():
    kept, calls = {"m1": {T0 + timedelta(seconds=k): float(k) for k in range(100)}, "m2": {T0: 7.0}}, []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            calls.append(q)
            a, b = datetime.fromisoformat(q["start"]), datetime.fromisoformat(q["end"])
            self.answer(json.dumps([{"ts": t.isoformat(), "value": v} for t, v in sorted(kept.get(q["id"], {}).items()) if a <= t < b]).encode())

        def do_POST(self):
            u = urlparse(self.path)
            key = parse_qs(u.query)["id"][0]
            for r in json.loads(self.rfile.read(int(self.headers["Content-Length"]))):
                kept.setdefault(key, {})[datetime.fromisoformat(r["ts"])] = r["value"]
            self.answer(b"")

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", kept, calls
    server.shutdown()


def test_slices():
    got = rest.slices("k", T0, T0 + timedelta(seconds=25), 1, 10)
    assert [(s.start[17:19], s.end[17:19]) for s in got] == [("00", "10"), ("10", "20"), ("20", "25")] and rest.slices("k", T0, T0, 1, 10) == []


def test_rest_read_write_stream(spark, service, tmp_path):
    url, kept, calls = service
    rest.register(spark)
    options = {"url": url, "keys": "m1,m2,none", "start": "2024-01-01T00:00:00", "end": "2024-01-01T00:01:40", "rows": "30"}
    df = spark.read.format("readings_rest").options(**options).load()
    assert df.rdd.getNumPartitions() == 12
    got = {(r.key, r.s): r.value for r in df.select("key", F.unix_seconds("ts").alias("s"), "value").collect()}
    base = int(T0.timestamp())
    assert got == {("m1", base + k): float(k) for k in range(100)} | {("m2", base): 7.0}
    df.where("key = 'm1'").withColumn("key", F.lit("copy")).write.format("readings_rest").option("url", url).option("rows", "9").mode("append").save()
    assert kept["copy"] == kept["m1"]
    stream = spark.readStream.format("readings_rest").options(**options).load()
    q = stream.writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
    q.awaitTermination(60)
    assert spark.table("polled").count() == 101


def test_block_csv(spark, tmp_path):
    (tmp_path / "building2").mkdir()
    text = "1.0,5.0\ntimestamp,A,B\n10.0,1.5,2.5\n11.0,NULL,3.5,9\n\0\0 12.0,4.0\n13.0,NUtimestamp,B,C\n13.0,8.0,9.0\nbroken\n13.0,7.0,9.0\n"
    (tmp_path / "building2" / "dataset_2014-01-01.csv").write_text(text)
    got = sorted((r.building, r.meter, r.s, r.value) for r in converters.block_csv(spark, str(tmp_path), "G", {"A": 1, "B": 2}).select("building", "meter", F.unix_seconds("ts").alias("s"), "value").collect())
    assert got == [(2, 1, 10, 1.5), (2, 1, 12, 4.0), (2, 2, 10, 2.5), (2, 2, 11, 3.5), (2, 2, 13, 7.0)]
