"""The driver's side: registries, paged downloads, raw files, the work queue, resources, claims, reports.

Little data, no cluster: plain Python, with everything that waits or fetches passed in.
"""

from __future__ import annotations

import hashlib
import html
import json
import os
import shutil
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
KINDS = {"bulk_http", "arcgis", "live_json", "api_keyed", "derived"}
PATTERNS = {"snapshot_swap", "event_lifecycle", "upsert"}
MAX_BBOX_DEG = 4.0
MAX_PAGES = 20


class BadRequest(ValueError):
    """An input that a caller can mend; ``code`` says which way."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """'west,south,east,north' in degrees, at most 4 by 4."""
    try:
        w, s, e, n = map(float, text.split(","))
    except ValueError:
        raise BadRequest("invalid_bbox", "four numbers, separated by commas") from None
    for value, most, what in ((w, 180, "longitude"), (e, 180, "longitude"), (s, 90, "latitude"), (n, 90, "latitude")):
        if not abs(value) <= most:
            raise BadRequest("invalid_bbox", f"{what} beyond {most}")
    if w > e or s > n:
        raise BadRequest("invalid_bbox", "the first corner is not south-west of the second")
    if max(e - w, n - s) > MAX_BBOX_DEG:
        raise BadRequest("bbox_too_large", f"more than {MAX_BBOX_DEG:g} degrees on a side")
    return w, s, e, n


def check_registry(entries: Iterable[tuple[str, Mapping]], parsers: set[str], targets: set[str]) -> list[dict]:
    """Validated sources from (file name, mapping) pairs; raises at the first fault, naming the file."""
    out, seen = [], set()

    def need(ok: bool, where: str, what: str) -> None:
        if not ok:
            raise ValueError(f"{where}: {what}")

    for where, e in entries:
        for f in ("id", "name", "url", "kind", "load_pattern"):
            need(isinstance(e.get(f), str) and bool(e[f].strip()), where, f"{f} is missing")
        need(e["id"] not in seen, where, f"id {e['id']!r} comes twice")
        seen.add(e["id"])
        need(e["kind"] in KINDS, where, f"unknown kind {e['kind']!r}")
        need(e["load_pattern"] in PATTERNS, where, f"unknown load pattern {e['load_pattern']!r}")
        for f in ("schedule_minutes", "slo_hours"):
            need(type(e.get(f)) is int and e[f] > 0, where, f"{f} is no positive whole number")
        required = (e.get("gates") or {}).get("required_fields")
        need(required is None or isinstance(required, list) and bool(required) and all(isinstance(x, str) and x.strip() for x in required), where, "required_fields is no list of names")
        need(e.get("auth") is None or bool(str((e["auth"] or {}).get("env") or "").strip()), where, "auth names no variable")
        need(e.get("parser") is None or e["parser"] in parsers, where, f"unknown parser {e.get('parser')!r}")
        need(e.get("target") is None or e["target"] in targets and e["load_pattern"] == "snapshot_swap", where, "target isn't one that a snapshot may replace")
        out.append(dict(e))
    if not out:
        raise ValueError("the registry is empty")
    return out


# ---- downloads ---------------------------------------------------------------------------------------------


class Polite:
    """Calls spaced per host, retried once; a refusal or a second overload is final; 304 says unchanged."""

    def __init__(self, fetch: Callable[[str, dict], tuple[int, bytes]], gap_s: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.fetch, self.gap_s, self.clock, self.sleep, self.last = fetch, gap_s, clock, sleep, {}

    def get(self, url: str, params: dict | None = None) -> bytes | None:
        host = url.split("/")[2] if "//" in url else url
        for again in (True, False):
            wait = self.last.get(host, float("-inf")) + self.gap_s - self.clock()
            if wait > 0:
                self.sleep(wait)
            status, body = self.fetch(url, params or {})
            self.last[host] = self.clock()
            if status == 304:
                return None
            if status < 400:
                return body
            if not again or status not in (408, 429, 500, 502, 503, 504):
                raise ConnectionError(f"{host} answered {status}")
        raise AssertionError


def fetch_layer(get: Callable[[str, dict], bytes], url: str) -> dict:
    """All pages of a feature layer as one collection; an error in the body is an error."""

    def ask(path: str, **params) -> dict:
        doc = json.loads(get(url.rstrip("/") + path, params))
        if isinstance(doc, dict) and "error" in doc:
            raise ConnectionError(f"layer error {doc['error']}")
        return doc

    meta = ask("/0", f="json")
    size, out = int(meta.get("maxRecordCount") or 1000), []
    while True:
        page = ask("/0/query", where="1=1", outFields="*", f="geojson", orderByFields=meta.get("objectIdField") or "OBJECTID", resultOffset=len(out), resultRecordCount=size).get("features") or []
        out += page
        if len(page) < size:
            return {"type": "FeatureCollection", "features": out}


def fetch_keyed(get: Callable[[str, dict], bytes], url: str, key: str) -> dict:
    """Pages of a keyed series as one document, the key nowhere in it."""
    doc = json.loads(get(url, {"api_key": key, "offset": 0}))
    response = doc.setdefault("response", {})
    rows = list(response.get("data") or [])
    for page in range(1, MAX_PAGES + 1):
        if len(rows) >= int(response.get("total") or len(rows)):
            break
        if page == MAX_PAGES:
            raise ConnectionError(f"{len(rows)} of {response['total']} rows after {MAX_PAGES} pages")
        more = (json.loads(get(url, {"api_key": key, "offset": len(rows)})).get("response") or {}).get("data") or []
        if not more:
            break
        rows += more
    response["data"] = rows
    return json.loads(json.dumps(doc).replace(json.dumps(key)[1:-1], "REDACTED")) if key else doc


def write_raw(folder: str, source_id: str, content: bytes, extension: str, meta: dict) -> str:
    """A file named by its content with its facts beside it; the same content is written once."""
    name = hashlib.sha256(content).hexdigest()
    path = os.path.join(folder, source_id, f"{name}.{extension}")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    for p, data in ((path, content), (f"{path}.json", json.dumps(meta | {"sha256": name, "bytes": len(content)}, sort_keys=True).encode())):
        if not os.path.exists(p):
            with open(f"{p}.part", "wb") as f:
                f.write(data)
            os.replace(f"{p}.part", p)
    return path


def check_spool(path: str, manifest: Mapping, factor: float = 5.0) -> None:
    """A spooled file must be whole and the disk must have room to load it."""
    size = os.path.getsize(path)
    if not manifest.get("complete") or manifest.get("bytes") != size:
        raise ValueError(f"{path}: {size} bytes, the manifest says {manifest.get('bytes')}, complete: {bool(manifest.get('complete'))}")
    free = shutil.disk_usage(os.path.dirname(os.path.abspath(path))).free
    if free < factor * size:
        raise OSError(f"{free} bytes are free, {factor * size:.0f} are needed")


def fetch_if_changed(spark: SparkSession, target: str, remote_md5: str, chunks: Callable[[], Iterable[bytes]], dry_run: bool = False) -> tuple[bool, str]:
    """Replaces a large file only when its published md5 differs from the one kept beside it.

    The new file is written aside, in the store that ``target`` is in, and takes its place only once its md5 is right;
    the md5 beside it is written last.  A mismatch leaves the old file and raises.
    """
    jvm = spark.sparkContext._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    side, part = Path(f"{target}.md5"), Path(f"{target}.part")
    local = None
    if fs.exists(side) and fs.exists(Path(target)):
        stream = fs.open(side)
        try:
            local = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()[0]
        finally:
            stream.close()
    if local == remote_md5:
        return False, f"unchanged ({remote_md5[:12]})"
    if dry_run:
        return True, f"{str(local)[:12]} is not {remote_md5[:12]}"
    got, out = hashlib.md5(usedforsecurity=False), fs.create(part, True)
    try:
        for chunk in chunks():
            got.update(chunk)
            out.write(bytearray(chunk))
    finally:
        out.close()
    if got.hexdigest() != remote_md5:
        fs.delete(part, False)
        raise ValueError(f"md5 is {got.hexdigest()}, not {remote_md5}; the old file stays")
    if fs.exists(Path(target)):
        fs.delete(Path(target), False)
    fs.rename(part, Path(target))
    out = fs.create(side, True)
    try:
        out.write(bytearray(f"{remote_md5}\n".encode()))
    finally:
        out.close()
    return True, f"replaced ({remote_md5[:12]})"


# ---- queue and resources -----------------------------------------------------------------------------------


@dataclass
class Queue:
    """Jobs of one writer: one active job a source, first in first out, real feeds before derived ones."""

    jobs: list[dict] = field(default_factory=list)

    def enqueue(self, source_id: str, now: datetime, derived: bool = False) -> bool:
        if any(j["source_id"] == source_id and j["status"] in ("queued", "running") for j in self.jobs):
            return False
        self.jobs.append({"job_id": len(self.jobs) + 1, "source_id": source_id, "derived": derived, "status": "queued", "at": now, "after": now})
        return True

    def claim(self, now: datetime) -> dict | None:
        ready = [j for j in self.jobs if j["status"] == "queued" and j["after"] <= now]
        job = min(ready, key=lambda j: (j["derived"], j["at"], j["job_id"]), default=None)
        if job:
            job |= {"status": "running", "started": now}
        return job

    def finish(self, job: dict, ok: bool) -> None:
        job["status"] = "done" if ok else "failed"

    def defer(self, job: dict, now: datetime, minutes: int) -> None:
        job |= {"status": "queued", "after": now + timedelta(minutes=minutes)}

    def reap(self, now: datetime, hours: float = 2.0) -> int:
        stale = [j for j in self.jobs if j["status"] == "running" and now - j["started"] > timedelta(hours=hours)]
        for j in stale:
            j["status"] = "failed"
        return len(stale)


def admit(readings: Mapping[str, tuple[float, float, bool]]) -> tuple[bool, str]:
    """Whether work may start, and every measurement: name to (value, limit, whether less than the limit is bad)."""
    bad = [n for n, (v, limit, floor) in readings.items() if (v < limit if floor else v > limit)]
    detail = "; ".join(f"{n} {v:g} of {limit:g}" for n, (v, limit, _) in readings.items())
    return not bad, f"{'deferred: ' + ', '.join(bad) if bad else 'ok'} [{detail}]"


# ---- claims and reports ------------------------------------------------------------------------------------


@dataclass
class Claims:
    """Published numbers held against measured ones."""

    passed: list[str] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)

    def _put(self, ok: bool, label: str, detail: str) -> None:
        (self.passed if ok else self.failed).append(f"{label}: {detail}")

    def exact(self, label: str, claimed, actual) -> None:
        self._put(claimed == actual, label, f"{actual} for {claimed}")

    def at_least(self, label: str, floor: float, actual: float) -> None:
        self._put(actual >= floor, label, f"{actual} of {floor} at least")

    def close(self, label: str, claimed: float, actual: float, tolerance: float) -> None:
        self._put(abs(float(actual) - claimed) <= tolerance, label, f"{actual} for {claimed} within {tolerance}")

    def invariant(self, label: str, holds: bool) -> None:
        self._put(holds, label, "holds" if holds else "violated")


def smoke(endpoints: Mapping[str, Callable[[], DataFrame]]) -> dict[str, str]:
    """OK, EMPTY or FAIL for each query; one row decides."""
    out = {}
    for name, run in endpoints.items():
        try:
            out[name] = "EMPTY" if run().isEmpty() else "OK"
        except Exception as e:  # noqa: BLE001  any failure is what is asked for
            out[name] = f"FAIL {type(e).__name__}"
    return out


def report(df: DataFrame, title: str, form: str = "markdown", rows: int = 200) -> str:
    """A small result as Markdown, HTML or JSON; nulls read 'unknown'.  ``rows`` bounds what reaches the driver."""
    data = [r.asDict() for r in df.limit(rows).collect()]
    if form == "json":
        return json.dumps({"title": title, "rows": data}, default=str)
    cells = [["unknown" if v is None else str(v) for v in r.values()] for r in data]
    if form == "html":
        line = lambda tag, vs: "<tr>" + "".join(f"<{tag}>{html.escape(v)}</{tag}>" for v in vs) + "</tr>"
        return f"<h1>{html.escape(title)}</h1><table>{line('th', df.columns)}{''.join(line('td', c) for c in cells)}</table>"
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(c) + " |" for c in cells)])
