"""Paged services over a local server: pages in parallel, failed pages again, streams from their checkpoint."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from haulspark.sources import paged


class Service:
    """A layer of n rows and a series of the same rows; ``fail`` counts the answers of 503 still due for an offset."""

    def __init__(self, n):
        self.n, self.fail, self.asked, self.short, self.error = n, {}, [], None, False
        me = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def do_GET(self):
                u, q = urlparse(self.path), {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                start = int(q.get("resultOffset", q.get("offset", 0)))
                n = min(int(q.get("resultRecordCount", q.get("length", 0))), me.short or 10**9)
                me.asked.append((u.path, start, q.get("api_key")))
                if me.fail.get(start, 0) > 0 and "returnCountOnly" not in q and q.get("length") != "1":
                    me.fail[start] -= 1
                    return self.answer({}, 503)
                rows = [{"id": i} for i in range(start, min(me.n, start + n))]
                if me.error:
                    return self.answer({"error": {"code": 400}})
                if u.path.endswith("/0"):
                    return self.answer({"maxRecordCount": 7, "objectIdField": "FID"})
                if "returnCountOnly" in q:
                    return self.answer({"count": me.n})
                return self.answer({"features": rows} if "/layer" in u.path else {"response": {"total": str(me.n), "data": rows}})

            def answer(self, doc, status=200):
                body = json.dumps(doc).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def service():
    s = Service(45)
    yield s
    s.server.shutdown()


def load(spark, service, kind="layer", **options):
    paged.register(spark)
    return spark.read.format(f"paged_{kind}").option("url", f"{service.url}/{kind}").option("waitSeconds", "0.01").options(**options).load()


def test_each_page_is_a_partition(spark, service):
    df = load(spark, service)
    assert df.rdd.getNumPartitions() == 7  # 45 rows, seven at once
    got = sorted((r["pos"], r["page"], json.loads(r["feature"])["id"]) for r in df.collect())
    assert got == [(i, i // 7, i) for i in range(45)]
    service.n = 0
    assert load(spark, service).count() == 0


def test_a_failed_page_is_fetched_again_and_no_other(spark, service):
    service.fail = {14: 2}
    assert load(spark, service).count() == 45
    starts = [a for p, a, _ in service.asked if p.endswith("/query")]
    assert starts.count(14) == 3 and all(starts.count(k) == 1 for k in (7, 21, 28, 35, 42))
    service.fail, service.error = {14: 99}, False
    with pytest.raises(Exception, match="no answer after 2 tries"):
        load(spark, service, tries="2").count()
    service.fail, service.error = {}, True
    with pytest.raises(Exception, match="the service says"):
        load(spark, service).count()


def test_short_answers_and_keys(spark, service):
    service.short = 4
    df = load(spark, service, "series", pageRows="20", keyEnv="HOME")  # a variable that all tasks have
    assert sorted(r["pos"] for r in df.collect()) == list(range(45)) and df.rdd.getNumPartitions() == 3
    assert {k for p, _, k in service.asked if p == "/series"} == {os.environ["HOME"]}


def test_a_stream_goes_on_from_its_checkpoint(spark, service, tmp_path):
    paged.register(spark)
    got = []

    def run():
        stream = spark.readStream.format("paged_series").option("url", f"{service.url}/series").option("pageRows", "10").option("waitSeconds", "0.01").load()
        q = stream.writeStream.foreachBatch(lambda b, i: got.append(sorted(r["pos"] for r in b.collect()))).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    service.n = 63
    run()
    run()
    assert [p for g in got for p in g] == list(range(63)) and got[0] == list(range(45))
