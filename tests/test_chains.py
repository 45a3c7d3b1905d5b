"""Chains of lines and their simplification against plain Python."""

import math
import random

import pytest

from haulspark.operators import chains, tiles

LINE = "array<struct<lon:double,lat:double>>"


def network(seed, n, routes=2):
    """Lines between places of a grid: chains, forks, circles and loops, in any direction."""
    r, out = random.Random(seed), []
    for i in range(n):
        x, y = r.randrange(7), r.randrange(7)
        a, b = (float(x), float(y)), (float(min(6, x + r.randint(0, 1))), float(min(6, y + r.randint(0, 1))))
        mid = [(a[0] + (b[0] - a[0]) * t + r.uniform(-0.02, 0.02), a[1] + (b[1] - a[1]) * t + r.uniform(-0.02, 0.02)) for t in (0.3, 0.6)][: r.randint(0, 2)]
        if a == b and not mid:
            mid = [(a[0] + 0.3, a[1] + 0.3)]
        out.append((r.randrange(routes), i, [a, *mid, b][:: r.choice([1, -1])]))
    k = 1000
    for x in (20.0, 30.0):  # two circles of several lines
        ring = [(x + math.cos(t), math.sin(t)) for t in range(6)]
        for a, b in zip(ring, ring[1:] + ring[:1]):
            out.append((0, k, [a, b][:: r.choice([1, -1])]))
            k += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, f"route int, edge_id bigint, line {LINE}").repartition(3)


def turned(line):
    return min(line, line[::-1])


def opened(line):
    """A circle from its smallest place on."""
    if line[0] != line[-1]:
        return turned(line)
    ring = line[:-1]
    ways = [w[i:] + w[:i] for w in (ring, ring[::-1]) for i in range(len(ring))]
    best = min(ways)
    return best + best[:1]


def test_chains_equal_joining_one_by_one(spark):
    rows = network(1, 80)
    df = frame(spark, rows)
    ranked = chains.chains(df, ["route"])
    got = {}
    for p in chains.chain_points(df, ranked, ["route"]).orderBy("route", "chain", "o").collect():
        got.setdefault((p["route"], p["chain"]), []).append((p["lon"], p["lat"]))
    want = [(k, opened(m)) for k in (0, 1) for m in tiles.merge_lines([line for route, _, line in rows if route == k])]
    assert sorted((k, opened(v)) for (k, _), v in got.items()) == sorted(want)
    edges = sorted((x["route"], x["edge_id"]) for x in ranked.collect())
    assert edges == sorted((k, i) for k, i, _ in rows)
    for x in ranked.collect():
        assert x["edge_id"] >= x["chain"] and (x["edge_id"] != x["chain"] or x["way"] == 0)


def wave(n):
    return [(i / 100, math.sin(i / 50) + 0.3 * math.sin(i / 7) + 0.001 * ((i * 7919) % 13)) for i in range(n)]


@pytest.mark.parametrize("local", [20_000, 200])
def test_simplifying_in_rounds_equals_simplifying_at_once(spark, local):
    line = wave(1500)
    ring = [(50 + math.cos(i / 100 * math.pi), math.sin(i / 100 * math.pi)) for i in range(200)]
    rows = [(0, i, line[i * 10 : i * 10 + 11][:: 1 if i % 3 else -1]) for i in range(149)] + [(0, 500 + i, [ring[i], ring[(i + 1) % 200]]) for i in range(200)] + [(1, 900, [(0.0, 0.0), (1.0, 1.0)])]
    df = frame(spark, rows)
    ranked = chains.chains(df, ["route"])
    pieces = chains.simplified(chains.chain_points(df, ranked, ["route"]), ["route"], 0.05, local).orderBy("route", "chain", "lo").collect()
    got = {}
    for p in pieces:
        got.setdefault((p["route"], p["chain"]), [(p["ax"], p["ay"])]).append((p["bx"], p["by"]))
    assert got[0, 0] == tiles.simplify(line[1490::-1], 0.05)  # the least edge runs forward
    assert got[0, 500] == tiles.simplify([*ring, ring[0]], 0.05) and got[1, 900] == [(0.0, 0.0), (1.0, 1.0)]


def crossings(lines):
    pieces = [(k, a, b) for k, line in enumerate(lines) for a, b in zip(line, line[1:])]
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return sum(turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0 for i, (_, a, b) in enumerate(pieces) for _, c, d in pieces[:i])


def test_simplified_lines_do_not_cross_anew(spark):
    bay = [(0.0, 0.0), (0.5, 0.02), (1.0, 0.05), (1.5, 0.02), (2.0, 0.0)]
    island = [(0.9, 0.02), (1.0, 0.04), (1.1, 0.02)]  # between the bay's shore and its chord
    rows = [(0, 1, bay), (0, 2, island), (1, 3, bay)]
    assert crossings([tiles.simplify(bay, 0.06), island]) == 0 and crossings([[bay[0], bay[-1]], [(1.0, 0.04), (1.0, -0.5)]]) == 1
    rows.append((2, 4, bay))
    rows.append((2, 5, [(1.0, 0.04), (1.0, -0.5)]))  # starts below the shore and would be crossed by its chord
    rows.append((3, 6, [(0.0, 0.0), (1.0, 1.0)]))
    rows.append((3, 7, [(0.0, 1.0), (1.0, 0.0)]))  # crosses as it is
    got = {r["route"]: [[(p["lon"], p["lat"]) for p in line] for line in r["lines"]] for r in tiles.generalize(frame(spark, rows), ["route"], 0.06).collect()}
    assert got[1] == [[bay[0], bay[-1]]] and got[2][0] != [bay[0], bay[-1]] and crossings(got[2]) == 0 and crossings(got[3]) == 1
    assert got[2][0] == [bay[0], bay[2], bay[-1]]


def test_a_long_chain_is_no_group(spark):
    """Each round of a chain of 20,000 pieces is joins and sums; only stretches of a bounded length are groups."""
    n = 20_000
    df = spark.range(n).selectExpr("0 AS route", "id AS edge_id", "array(named_struct('lon', id / 1000D, 'lat', sin(id / 2000D)), named_struct('lon', (id + 1) / 1000D, 'lat', sin((id + 1) / 2000D))) AS line")
    ranked = chains.chains(df, ["route"])
    assert ranked.where("pos = edge_id and way = 0 and chain = 0").count() == n
    pieces = chains.simplified(chains.chain_points(df, ranked, ["route"]), ["route"], 0.01, 8_000).orderBy("lo").collect()
    want = tiles.simplify([(i / 1000, math.sin(i / 2000)) for i in range(n + 1)], 0.01)
    assert len(pieces) == len(want) - 1 and pieces[0]["ax"] == 0.0 and pieces[-1]["bx"] == n / 1000
    assert all(p["bx"] == q["ax"] for p, q in zip(pieces, pieces[1:]))


def rays(n, at=0.0):
    turn = [math.pi * (i + 0.5) / n for i in range(n)]
    return [(at - math.cos(t), -math.sin(t), at + math.cos(t), math.sin(t)) for t in turn]


PIECE = "route int, chain bigint, lo bigint, hi bigint, ax double, ay double, bx double, by double, fresh boolean"


def test_lines_that_cross_often_are_not_held_against_all(spark, monkeypatch):
    """Where every new piece crosses many others, a few tell, and pieces aren't dealt to cells (too many of them here)."""
    monkeypatch.setattr(chains, "CELL", 1e-10)
    pieces = spark.createDataFrame([(0, i, 0, 2, *p, i % 2 == 0) for i, p in enumerate(rays(60))], PIECE)
    assert sorted(r["chain"] for r in chains._crossing(pieces, ["route"]).collect()) == list(range(0, 60, 2))


def test_crossings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chains, "FIRST", 3)
    r = random.Random(5)
    rows = [(k % 3, k, 0, 2, x, y, x + r.uniform(-w, w), y + r.uniform(-w, w), r.random() < 0.6) for k in range(150) for x, y, w in [(r.uniform(0, 3), r.uniform(0, 3), r.choice([0.05, 0.2, 1.0]))]]
    want = [a[1] for a in rows if a[8] and any(a[0] == b[0] and a[1] != b[1] and crossings([[a[4:6], a[6:8]], [b[4:6], b[6:8]]]) for b in rows)]
    assert 0 < len(want) < sum(a[8] for a in rows)
    for limit in (200_000, 0):
        monkeypatch.setattr(chains, "BROADCAST", limit)
        assert sorted(x["chain"] for x in chains._crossing(spark.createDataFrame(rows, PIECE), ["route"]).collect()) == want


def test_short_stretches_share_a_group(spark, capsys):
    df = frame(spark, [(0, i, [(3.0 * i, 0.0), (3.0 * i + 1, 0.01), (3.0 * i + 2, 0.0)]) for i in range(50)])
    pieces = chains.simplified(chains.chain_points(df, chains.chains(df, ["route"]), ["route"]), ["route"], 0.1)
    assert pieces.count() == 50
    pieces.explain()
    groups = [line for line in capsys.readouterr().out.splitlines() if "FlatMapCoGroups" in line]
    assert groups and not any("chain#" in line.split("]")[0] for line in groups)
