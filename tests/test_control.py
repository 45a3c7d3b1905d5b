import json
from datetime import datetime, timedelta

import pytest

from haulspark import control


def test_bbox():
    assert control.parse_bbox("-100,30,-98,32") == (-100, 30, -98, 32)
    for text, code in (("1,2,3", "invalid_bbox"), ("a,b,c,d", "invalid_bbox"), ("-200,0,0,1", "invalid_bbox"), ("0,-91,1,1", "invalid_bbox"), ("1,1,0,0", "invalid_bbox"), ("0,0,5,1", "bbox_too_large"), ("nan,0,1,1", "invalid_bbox")):
        with pytest.raises(control.BadRequest) as e:
            control.parse_bbox(text)
        assert e.value.code == code


def test_registry():
    good = {"id": "a", "name": "A", "url": "u", "kind": "bulk_http", "load_pattern": "snapshot_swap", "schedule_minutes": 5, "slo_hours": 1}
    assert control.check_registry([("f", good)], set(), set())[0]["id"] == "a"
    for change in ({"kind": "x"}, {"schedule_minutes": True}, {"slo_hours": 0}, {"name": " "}, {"parser": "p"}, {"target": "t"}, {"auth": {"env": ""}}, {"gates": {"required_fields": []}}):
        with pytest.raises(ValueError):
            control.check_registry([("f", good | change)], set(), set())
    with pytest.raises(ValueError):
        control.check_registry([("f", good), ("g", good)], set(), set())
    with pytest.raises(ValueError):
        control.check_registry([], set(), set())


def test_downloads():
    def layer(url, params):
        if url.endswith("/0"):
            return json.dumps({"maxRecordCount": 2}).encode()
        k = params["resultOffset"]
        return json.dumps({"features": list(range(5))[k : k + 2]}).encode()

    assert control.fetch_layer(layer, "http://h/s")["features"] == [0, 1, 2, 3, 4]
    with pytest.raises(ConnectionError):
        control.fetch_layer(lambda u, p: b'{"error": {"code": 1}}', "http://h/s")
    keyed = lambda u, p: json.dumps({"request": {"params": {"api_key": p["api_key"]}}, "response": {"total": 3, "data": [p["offset"]]}}).encode()
    doc = control.fetch_keyed(keyed, "u", "s3cret")
    assert doc["response"]["data"] == [0, 1, 2] and "s3cret" not in json.dumps(doc)
    answers, slept = iter([(503, b""), (200, b"x"), (304, b""), (403, b""), (429, b""), (429, b"")]), []
    p = control.Polite(lambda u, q: next(answers), 1.0, lambda: 0.0, slept.append)
    assert p.get("http://h/a") == b"x" and p.get("http://h/a") is None and len(slept) == 2
    for _ in range(2):
        with pytest.raises(ConnectionError):
            p.get("http://h/a")


def test_files(tmp_path):
    a = control.write_raw(str(tmp_path), "s", b"data", "json", {"url": "u"})
    assert a == control.write_raw(str(tmp_path), "s", b"data", "json", {"url": "v"}) and json.load(open(f"{a}.json"))["url"] == "u"
    control.check_spool(a, {"complete": True, "bytes": 4})
    with pytest.raises(ValueError):
        control.check_spool(a, {"complete": True, "bytes": 5})


def test_queue_and_gate():
    q, t = control.Queue(), datetime(2024, 1, 1)
    assert q.enqueue("d", t, derived=True) and q.enqueue("a", t) and not q.enqueue("a", t)
    job = q.claim(t)
    assert job["source_id"] == "a" and q.claim(t)["source_id"] == "d" and q.claim(t) is None
    q.defer(job, t, 10)
    assert q.claim(t) is None and q.claim(t + timedelta(minutes=10)) is job
    assert q.reap(t + timedelta(hours=3)) == 2
    assert control.admit({"ram": (2.0, 1.0, True), "load": (0.5, 1.0, False)})[0] and not control.admit({"ram": (0.5, 1.0, True)})[0]


def test_claims_and_reports(spark):
    c = control.Claims()
    c.exact("n", 3, 3)
    c.at_least("m", 5, 4)
    c.close("k", 1.0, 1.05, 0.1)
    c.invariant("i", True)
    assert len(c.passed) == 3 and len(c.failed) == 1
    df = spark.createDataFrame([(1, None), (2, "<b>")], "i int, s string")
    assert "unknown" in control.report(df, "T") and "&lt;b&gt;" in control.report(df, "T", "html") and json.loads(control.report(df, "T", "json"))["rows"][0]["s"] is None
    assert control.smoke({"a": lambda: df, "b": lambda: df.limit(0), "c": lambda: df.select("nope")}) == {"a": "OK", "b": "EMPTY", "c": "FAIL AnalysisException"}
