"""Shortest paths of many pairs over a graph that is cut into cells of nodes.

In a round, the states that improved go to their cells, where a best-first search runs from all of them at once; what
leaves a cell is a state of the next round.  So there are as many rounds as a path crosses cells, not as it has edges,
and a task holds one cell and a few pairs.  Cells follow a space-filling curve where nodes have places, so that they
are patches rather than strips.

A state is a distance and a number of edges, never a path.  Once distances are known, paths are traced back from the
goals, cell by cell, over the nodes that a shortest path may pass; each link into a cell is a record with the piece of
path behind it, and pointer jumping puts the pieces of a path in order.  Rounds are written to the shared folder and
read back, which gives the planner true sizes.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.operators.numbering import number
from haulspark.session import checkpoint, spread, written

#: Nodes in a cell, and pairs that are searched for together in it, which share one copy of its edges.
CELL_NODES, PAIRS = 4096, 256
STATE, GOAL, SETTLED, AVOIDED = 0, 1, 2, 3
#: Sums of one path's edges from both ends differ by rounding, by less than this share.
ROUNDING = 1e-12
BEGIN, LINK = 0, 1


class NoRoute(Exception):
    """No path for a pair; ``code`` says why."""

    def __init__(self, code: str, said: str):
        super().__init__(said)
        self.code = code


def curve(lon: Column, lat: Column) -> Column:
    """The place of a point on a Z curve over the globe: 24 bits of each coordinate, interleaved."""

    def spread(v: Column) -> Column:
        x = F.least(F.lit(2**24 - 1), F.greatest(F.lit(0), F.floor(v * F.lit(float(2**24))))).cast("bigint")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    return spread((lon + 180.0) / 360.0).bitwiseOR(F.shiftleft(spread((lat + 90.0) / 180.0), 1))


def node_places(edges: DataFrame) -> DataFrame:
    """(node, lon, lat) of the nodes of edges with u, v and line, which runs from u to v."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.element_at("line", 1).alias("p")), F.struct(F.col("v").alias("node"), F.element_at("line", -1).alias("p")))
    return edges.where(F.size("line") > 1).select(F.inline(ends)).groupBy("node").agg(F.min("p").alias("p")).select("node", "p.lon", "p.lat")


def _cells(edges: DataFrame, places: DataFrame | None) -> tuple[DataFrame, DataFrame, bool]:
    """(node, cell), (cell, u, v, w, edge_id, inside, to, blocked): both directions, the least free edge of two nodes,
    and whether there is one cell only.

    Cells are stretches of the nodes along the curve; nodes without a place, or all if ``places`` is None, by number."""
    why = F.col("why").isNotNull() if "why" in edges.columns else F.lit(False)
    edge_id = F.col("edge_id").cast("bigint") if "edge_id" in edges.columns else F.lit(None).cast("bigint")
    e = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"), F.col("length_m").cast("double").alias("w"), edge_id.alias("edge_id"), why.alias("blocked"))
    e = e.where("u is not null and v is not null and w is not null")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "edge_id", "blocked"))
    # one edge for each two nodes that is free, and each one that isn't
    each = F.when(F.col("blocked"), F.col("edge_id")).otherwise(-1)
    both = written(both.groupBy("u", "v", "blocked", each.alias("each")).agg(F.min(F.struct("w", "edge_id")).alias("m")).select("u", "v", "blocked", "m.w", "m.edge_id"))
    nodes = both.select(F.col("u").alias("node")).distinct()
    if nodes.count() <= CELL_NODES:
        zero = F.lit(0).cast("bigint")
        return nodes.withColumn("cell", zero), both.select(zero.alias("cell"), "u", "v", "w", "edge_id", F.lit(True).alias("inside"), zero.alias("to"), "blocked"), True
    if places is not None:
        at = places.groupBy(F.col("node").cast("bigint").alias("node")).agg(F.min(curve(F.col("lon"), F.col("lat"))).alias("z"))
        nodes = nodes.join(at, "node", "left").withColumn("z", F.coalesce("z", F.lit(-1)))
    else:
        nodes = nodes.withColumn("z", F.lit(0))
    nodes = written(number(nodes, ["z", "node"], "n", 0).select("node", F.floor(F.col("n") / CELL_NODES).cast("bigint").alias("cell")))
    at = lambda end, name: nodes.select(F.col("node").alias(end), F.col("cell").alias(name))
    both = both.join(at("u", "cell"), "u").join(at("v", "to"), "v")
    return nodes, written(both.select("cell", "u", "v", "w", "edge_id", (F.col("cell") == F.col("to")).alias("inside"), "to", "blocked")), False


def _near(edges: pd.DataFrame) -> dict[int, list]:
    near: dict[int, list] = {}
    for u, *rest in zip(*(edges[c].tolist() for c in ("u", "v", "w", "inside", "to", "blocked", "edge_id")), strict=True):
        near.setdefault(u, []).append(rest)
    return near


def _settle(seeds: list[tuple[float, int, int]], near: dict[int, list], limit: float, goals: dict[int, float]):
    """Best-first within a cell: the (distance, hops) of each node up to ``limit`` or the best goal, the offers to
    nodes outside as node -> (distance, hops, cell), the blocked edges met, and what each goal met would cost."""
    heap, done = list(seeds), {}
    heapq.heapify(heap)
    outside: dict[int, tuple] = {}
    avoided: set[int] = set()
    met: dict[int, tuple[float, int]] = {}
    while heap:
        d, hops, node = heapq.heappop(heap)
        if d > limit:
            break
        if node in done:
            continue
        done[node] = (d, hops)
        if node in goals:
            limit = min(limit, d + goals[node])
            met[node] = (d + goals[node], hops)
        for v, w, inside, to, blocked, edge_id in near.get(node, ()):
            if blocked:
                avoided.add(int(edge_id))
            elif d + w <= limit and v not in done:
                if inside:
                    heapq.heappush(heap, (d + w, hops + 1, v))
                elif v not in outside or (d + w, hops + 1, to) < outside[v]:
                    outside[v] = (d + w, hops + 1, to)
    return done, {v: s for v, s in outside.items() if s[0] <= limit}, avoided, met


def _goals(nodes, costs) -> dict[int, float]:
    goals: dict[int, float] = {}
    for n, c in zip(nodes, costs, strict=True):
        goals[int(n)] = min(float(c), goals.get(int(n), float("inf")))
    return goals


def _by_pair(front: pd.DataFrame, columns: list[str]) -> dict:
    """The rows of each pair as tuples of ``columns``."""
    rows: dict = {}
    for pair, *rest in zip(*(front[c].tolist() for c in ("pair_id", *columns)), strict=True):
        rows.setdefault(pair, []).append(tuple(rest))
    return rows


def _explore(front: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The search of a few pairs within one cell."""
    near, out = _near(edges), []
    for pair, rows in _by_pair(front, ["d", "hops", "node", "round", "cell", "limit", "goal_nodes", "goal_costs"]).items():
        round_, cell, limit, *goals = rows[0][3:]
        done, outside, avoided, met = _settle([r[:3] for r in rows], near, limit, _goals(*goals))
        out += [(pair, GOAL, n, -1, d, hops) for n, (d, hops) in met.items()]
        out += [(pair, STATE, v, to, d, hops) for v, (d, hops, to) in outside.items()]
        out.append((pair, SETTLED, (round_ << 40) + cell, -1, 0.0, len(done)))
        out += [(pair, AVOIDED, e, -1, 0.0, 0) for e in avoided]
    return pd.DataFrame(out, columns=["pair_id", "kind", "node", "cell", "d", "hops"])


def _back(done: dict, near: dict[int, list], offers: list[tuple[int, int, int, float]], dist: float, total: int):
    """What follows each node that is on a shortest path, and its (hops, distance) to the goal, from offers of
    (hops, node, next, distance), backwards within a cell.

    A node is on a shortest path if its distance and the rest add up to the pair's; of several nodes that may follow
    it the smallest one does."""
    slack = abs(dist) * ROUNDING
    heapq.heapify(offers)
    after: dict[int, int] = {}
    rest: dict[int, tuple[int, float]] = {}
    while offers:
        hops, node, follow, d = heapq.heappop(offers)
        label = done.get(node)
        if node in after or label is None or label[1] + hops != total or label[0] + d > dist + slack:
            continue
        after[node], rest[node] = follow, (hops, d)
        if label[1]:
            for v, w, inside, _, blocked, _ in near.get(node, ()):
                if inside and not blocked:
                    heapq.heappush(offers, (hops + 1, v, node, d + w))
    return after, rest


def _piece(node: int, after: dict[int, int]) -> tuple[list[int], int]:
    """The nodes from here to the last one in this cell, and the node behind it, or -1."""
    nodes = [node]
    while after[nodes[-1]] in after:
        nodes.append(after[nodes[-1]])
    return nodes, after[nodes[-1]]


def _trace(front: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Paths of a few pairs within one cell, backwards from the goals in it or from links that leave it.  Each edge
    from outside to a node on a shortest path is a record with the piece of path from there."""
    near, out = _near(edges), []
    for pair, rows in _by_pair(front, ["d", "hops", "node", "next", "kind", "dist", "total", "goal_nodes", "goal_costs"]).items():
        dist, total, *goals = rows[0][5:]
        limit = dist + abs(dist) * ROUNDING
        done, *_ = _settle([r[:3] for r in rows if r[4] == STATE], near, limit, {})
        offers = [(hops, node, follow, d) for d, hops, node, follow, kind, *_ in rows if kind == LINK]
        offers += [(0, n, -1, c) for n, c in _goals(*goals).items() if n in done]
        after, rest = _back(done, near, offers, dist, total)
        for node, (hops, d) in rest.items():
            if not done[node][1]:
                nodes, to = _piece(node, after)
                out.append((pair, BEGIN, -1, node, 0.0, 0, -1, nodes, nodes[-1], to))
            else:
                for v, w, inside, cell, blocked, _ in near.get(node, ()):
                    if not inside and not blocked and hops < total and d + w <= limit:
                        nodes, to = _piece(node, after)
                        out.append((pair, LINK, v, node, d + w, hops + 1, cell, nodes, nodes[-1], to))
    return pd.DataFrame(out, columns=["pair_id", "kind", "node", "next", "d", "hops", "cell", "piece", "out_from", "out_to"])


def _at_once(front: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Search and paths of a few pairs where the graph is one cell."""
    near, out = _near(edges), []
    for row in front.to_dict("records"):
        goals = _goals(row["goal_nodes"], row["goal_costs"])
        seeds = [(float(c), 0, int(n)) for n, c in zip(row["start_nodes"], row["start_costs"], strict=True) if n in near]
        if not seeds:
            continue
        done, _, avoided, met = _settle(seeds, near, float("inf"), goals)
        dist, total = min(met.values(), default=(None, None))
        path = None
        if met and row["with_path"]:
            after, rest = _back(done, near, [(0, n, -1, c) for n, c in goals.items() if n in done], dist, total)
            path = _piece(min(n for n in rest if not done[n][1]), after)[0]
        out.append((row["pair_id"], dist, total, path, len(done), sorted(avoided)))
    return pd.DataFrame(out, columns=["pair_id", "distance", "hops", "path", "explored", "avoided"]).astype({"hops": "Int32"})


def _in_cells(front: DataFrame, links: DataFrame, search, schema: str) -> DataFrame:
    """``search`` for the pairs of ``front`` in each cell, PAIRS together.

    The pairs of a cell are dealt to as many buckets as they need, so edges are copied once for each PAIRS pairs of a
    cell, however many pairs and cells there are.  Rows are few bytes and much work, so adaptive execution mustn't put
    buckets together."""
    counts = front.groupBy("cell").agg(F.count_distinct("pair_id").alias("n"))
    asked = counts.select("cell", F.ceil(F.col("n") / PAIRS).cast("bigint").alias("buckets"))
    pairs = front.join(asked, "cell").withColumn("bucket", F.pmod(F.xxhash64("pair_id"), F.col("buckets"))).drop("buckets")
    ways = links.join(asked, "cell").withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1))).drop("buckets")
    key = ["cell", "bucket"]
    return spread(pairs, *key).groupBy(*key).cogroup(spread(ways, *key).groupBy(*key)).applyInPandas(search, schema)


def _paths(best: DataFrame, pairs: DataFrame, found: DataFrame, nodes: DataFrame, links: DataFrame, kind: str) -> DataFrame:
    """(pair_id, path) of the pairs in ``found`` (pair_id, dist, total)."""
    known = pairs.join(found, "pair_id")
    states = best.where(F.col("kind") == STATE).select("pair_id", "kind", "node", F.lit(-1).cast("bigint").alias("next"), "cell", "s.d", "s.hops")
    # First the cells of the goals, then those that records lead into.
    goals = known.select("pair_id", F.explode("goal_nodes").alias("node")).join(nodes, "node").select("pair_id", "cell").distinct()
    schema = f"pair_id {kind}, kind int, node bigint, next bigint, d double, hops int, cell bigint, piece array<bigint>, out_from bigint, out_to bigint"
    keys, records, to_do, round_ = ["pair_id", "kind", "node", "next"], None, goals, 0
    while True:
        rows = states.join(to_do, ["pair_id", "cell"], "left_semi")
        if records is not None:
            seeds = records.where(F.col("kind") == LINK).join(to_do, ["pair_id", "cell"], "left_semi")
            rows = rows.unionByName(seeds.select(*states.columns))
        front = written(rows.join(known, "pair_id"))
        step = _in_cells(front, links, _trace, schema)
        step = step.withColumn("born", F.lit(round_)).withColumn("first", F.lit(round_))
        if records is not None:
            step = records.unionByName(step)
        # A cell that is traced again may have other pieces: the last ones count, the first decide what is new.
        last = F.max_by(F.struct("d", "hops", "cell", "piece", "out_from", "out_to"), "born").alias("r")
        records = written(step.groupBy(*keys).agg(last, F.max("born").alias("born"), F.min("first").alias("first")).select(*keys, "r.*", "born", "first"))
        to_do = records.where((F.col("kind") == LINK) & (F.col("first") == round_)).select("pair_id", "cell").distinct()
        round_ += 1
        if to_do.isEmpty():
            break
    begin = records.where(F.col("kind") == BEGIN).groupBy("pair_id").agg(F.min(F.struct("next", "piece", "out_from", "out_to")).alias("r")).select("pair_id", "r.*")
    reached = begin.select("pair_id", F.lit(0).alias("pos"), "piece", "out_from", "out_to")
    if round_ > 1:
        reached = _chained(written(reached), records.where(F.col("kind") == LINK))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "piece")))
    return reached.groupBy("pair_id").agg(ordered.alias("p")).select("pair_id", F.flatten(F.col("p.piece")).alias("path"))


def _chained(begin: DataFrame, records: DataFrame) -> DataFrame:
    """The records that follow each beginning, by pointer jumping: each round doubles the reach of a jump, so a chain
    of n records takes about log n rounds."""
    here = [F.col("node").alias("out_from"), F.col("next").alias("out_to")]
    jumps = written(records.select("pair_id", *here, F.col("out_from").alias("to_from"), F.col("out_to").alias("to_to"), F.lit(1).alias("steps")))
    pieces = records.select("pair_id", *here, "piece")
    at = written(begin.where("out_to >= 0").select("pair_id", F.lit(1).alias("pos"), "out_from", "out_to"))
    while True:
        on = written(at.join(jumps, ["pair_id", "out_from", "out_to"]).where("to_to >= 0").select("pair_id", (F.col("pos") + F.col("steps")).alias("pos"), F.col("to_from").alias("out_from"), F.col("to_to").alias("out_to")))
        if on.isEmpty():
            break
        at = written(at.unionByName(on))
        second = jumps.select("pair_id", F.col("out_from").alias("to_from"), F.col("out_to").alias("to_to"), F.col("to_from").alias("a"), F.col("to_to").alias("b"), F.col("steps").alias("more"))
        jumps = written(jumps.join(second, ["pair_id", "to_from", "to_to"]).select("pair_id", "out_from", "out_to", F.col("a").alias("to_from"), F.col("b").alias("to_to"), (F.col("steps") + F.col("more")).alias("steps")))
    behind = at.join(pieces, ["pair_id", "out_from", "out_to"]).select("pair_id", "pos", "piece")
    return begin.select("pair_id", "pos", "piece").unionByName(behind)


def search(edges: DataFrame, starts: DataFrame, goals: DataFrame, places: DataFrame | None = None, with_paths: bool = True) -> DataFrame:
    """(pair_id, distance, hops, path, explored, avoided) of every pair that a search began for.

    ``edges`` has u, v and length_m, not negative, and runs both ways; with ``edge_id`` and ``why`` too, edges whose
    ``why`` is not null are not used, and ``avoided`` lists those met.  ``starts`` and ``goals`` have pair_id, node and
    cost; a path's distance includes both costs.  ``explored`` counts the nodes settled, once for each time a cell was
    searched.  ``distance`` is null where there is no path.  Of equal distances the path of fewer nodes wins, then the
    smaller one.  Nodes that no edge has and null ends begin nothing.  ``places`` (node, lon, lat) shapes the cells;
    it changes how fast a search is, not what it finds.  Without ``with_paths`` path is null.
    """
    nodes, links, one = _cells(edges, places)
    kind = dict(starts.dtypes)["pair_id"]
    ends = goals.where("node is not null").groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct(F.col("node").cast("bigint").alias("node"), F.col("cost").cast("double").alias("cost")))).alias("g"))
    pairs = written(ends.select("pair_id", F.col("g.node").alias("goal_nodes"), F.col("g.cost").alias("goal_costs")))
    if one:
        buckets = max(1, -(-pairs.count() // PAIRS))
        pairs = pairs.withColumn("bucket", F.pmod(F.xxhash64("pair_id"), F.lit(buckets)))
        begin = starts.where("node is not null").groupBy("pair_id").agg(F.collect_list(F.struct(F.col("node").cast("bigint").alias("node"), F.col("cost").cast("double").alias("cost"))).alias("s"))
        front = begin.select("pair_id", F.col("s.node").alias("start_nodes"), F.col("s.cost").alias("start_costs"), F.lit(with_paths).alias("with_path")).join(pairs, "pair_id")
        ways = links.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
        return front.groupBy("bucket").cogroup(ways.groupBy("bucket")).applyInPandas(_at_once, f"pair_id {kind}, distance double, hops int, path array<bigint>, explored bigint, avoided array<bigint>")
    first = starts.select("pair_id", F.col("node").cast("bigint").alias("node"), F.col("cost").cast("double").alias("d")).join(nodes, "node").join(pairs.select("pair_id"), "pair_id", "left_semi")
    first = first.select("pair_id", F.lit(STATE).alias("kind"), "node", "cell", "d", F.lit(0).alias("hops"))
    state, keys, round_ = F.struct("d", "hops"), ["pair_id", "kind", "node", "cell"], 0
    best = written(first.groupBy(*keys).agg(F.min(F.struct(state.alias("s"), F.lit(0).alias("born"))).alias("m")).select(*keys, "m.*"))
    schema = f"pair_id {kind}, kind int, node bigint, cell bigint, d double, hops int"
    while True:
        front = best.where((F.col("kind") == STATE) & (F.col("born") == round_))
        if front.isEmpty():
            break
        limit = best.where(F.col("kind") == GOAL).groupBy("pair_id").agg(F.min("s.d").alias("limit"))
        front = front.select("pair_id", "node", "cell", "s.*").join(pairs, "pair_id").join(limit, "pair_id", "left")
        front = front.withColumn("limit", F.coalesce("limit", F.lit(float("inf")))).where("d <= limit").withColumn("round", F.lit(round_))
        front = written(front)
        round_ += 1
        step = _in_cells(front, links, _explore, schema)
        step = step.select(*keys, state.alias("s"), F.lit(round_).alias("born"))
        best = written(best.unionByName(step).groupBy(*keys).agg(F.min(F.struct("s", "born")).alias("m")).select(*keys, "m.*"))
    hit = best.where(F.col("kind") == GOAL).groupBy("pair_id").agg(F.min("s").alias("s")).select("pair_id", F.col("s.d").alias("distance"), "s.hops")
    met = best.where(F.col("kind") > GOAL).groupBy("pair_id").agg(F.sum(F.when(F.col("kind") == SETTLED, F.col("s.hops"))).alias("explored"), F.sort_array(F.collect_set(F.when(F.col("kind") == AVOIDED, F.col("node")))).alias("avoided"))
    if with_paths:
        paths = _paths(best, pairs, hit.select("pair_id", F.col("distance").alias("dist"), F.col("hops").alias("total")), nodes, links, kind)
        hit = hit.join(paths, "pair_id", "left")
    else:
        hit = hit.withColumn("path", F.lit(None).cast("array<bigint>"))
    return met.join(hit, "pair_id", "left").select("pair_id", "distance", "hops", "path", "explored", "avoided")


def shortest_paths(edges: DataFrame, pairs: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(pair_id, distance, hops, path) for each (pair_id, origin, goal) that has a path; edges run both ways."""
    end = lambda c: pairs.select("pair_id", F.col(c).alias("node"), F.lit(0.0).alias("cost"))
    return search(edges, end("origin"), end("goal"), places).where("distance is not null").select("pair_id", "distance", "hops", "path")


def distances(edges: DataFrame, pairs: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(pair_id, distance, hops) of ``shortest_paths`` without tracing paths."""
    end = lambda c: pairs.select("pair_id", F.col(c).alias("node"), F.lit(0.0).alias("cost"))
    return search(edges, end("origin"), end("goal"), places, with_paths=False).where("distance is not null").select("pair_id", "distance", "hops")


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, edge_ids) of paths of nodes: the shortest edge between each two nodes, of equal ones the least id."""
    e = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "length_m", "edge_id").groupBy("a", "b").agg(F.min(F.struct("length_m", "edge_id")).alias("m"))
    p = paths.where(F.size("path") > 1).select("pair_id", "path", F.posexplode(F.slice("path", 2, F.size("path") - 1)).alias("pos", "to"))
    p = p.select("pair_id", "pos", F.col("to"), F.element_at("path", F.col("pos") + 1).alias("from"))
    p = p.select("pair_id", "pos", F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).join(e, ["a", "b"])
    return p.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("pos", "m.edge_id"))).alias("x")).select("pair_id", F.col("x.edge_id").alias("edge_ids"))


def routes(edges: DataFrame, trips: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(pair_id, status, distance, path, edge_ids, explored, edges_excluded, exclusion_examples) of every trip.

    A trip has pair_id, o_edge, o_frac, g_edge, g_frac: places on edges as shares of their length from ``u``.  A path
    may leave and reach its edges at either end, at the cost of the part driven; on one edge it's the part between.
    ``edges`` has edge_id, u, v, length_m and ``why`` (null where the vehicle may drive).  ``status`` is ok,
    not_on_network (an end without an edge), no_compliant_path (edges that the vehicle may not use were met) or
    no_path; the examples are up to five reasons.
    """
    end = lambda c: edges.select(F.col("edge_id").alias(f"{c}_edge"), F.col("u").alias(f"{c}_u"), F.col("v").alias(f"{c}_v"), F.col("length_m").alias(f"{c}_len"), F.col("why").alias(f"{c}_why"))
    t = checkpoint(trips.join(end("o"), "o_edge", "left").join(end("g"), "g_edge", "left"))
    on = t.where("o_len is not null and g_len is not null and o_frac is not null and g_frac is not null")
    same = on.where("o_edge = g_edge")
    apart = on.where("o_edge <> g_edge")
    seeds = lambda c: apart.select("pair_id", F.explode(F.array(F.struct(F.col(f"{c}_u").alias("node"), (F.col(f"{c}_frac") * F.col(f"{c}_len")).alias("cost")), F.struct(F.col(f"{c}_v").alias("node"), ((1.0 - F.col(f"{c}_frac")) * F.col(f"{c}_len")).alias("cost")))).alias("s")).select("pair_id", "s.*")
    if places is None and "line" in edges.columns:
        places = node_places(edges)
    found = checkpoint(search(edges, seeds("o"), seeds("g"), places))
    reasons = found.select("pair_id", F.explode("avoided").alias("edge_id")).join(edges.select("edge_id", "why"), "edge_id").groupBy("pair_id").agg(F.slice(F.sort_array(F.collect_set("why")), 1, 5).alias("exclusion_examples"))
    ids = path_edges(found, edges.where("why is null"))
    none = F.array().cast("array<bigint>")
    far = found.join(ids, "pair_id", "left").join(reasons, "pair_id", "left").select(
        "pair_id", F.when(F.col("distance").isNotNull(), "ok").when(F.size("avoided") > 0, "no_compliant_path").otherwise("no_path").alias("status"), "distance", "path",
        F.when(F.col("distance").isNotNull(), F.coalesce("edge_ids", none)).alias("edge_ids"), "explored", F.size("avoided").alias("edges_excluded"), "exclusion_examples",
    )
    free = F.col("o_why").isNull()
    near = same.select(
        "pair_id", F.when(free, "ok").otherwise("no_compliant_path").alias("status"), F.when(free, F.abs(F.col("o_frac") - F.col("g_frac")) * F.col("o_len")).alias("distance"), F.when(free, none).alias("path"),
        F.when(free, F.array(F.col("o_edge").cast("bigint"))).alias("edge_ids"), F.lit(0).cast("bigint").alias("explored"), F.when(free, 0).otherwise(1).alias("edges_excluded"), F.when(~free, F.array("o_why")).alias("exclusion_examples"),
    )
    return trips.select("pair_id").join(near.unionByName(far), "pair_id", "left").withColumn("status", F.coalesce("status", F.lit("not_on_network")))


def require(routed: DataFrame, pair_id) -> dict:
    """The one route of a pair, from ``routes``; raises NoRoute with its status as the code where there is none."""
    row = routed.where(F.col("pair_id") == pair_id).first()
    if row is None:
        raise NoRoute("not_on_network", f"pair {pair_id} is unknown")
    if row["status"] != "ok":
        why = f": {', '.join(row['exclusion_examples'])}" if row["exclusion_examples"] else ""
        raise NoRoute(row["status"], f"pair {pair_id} has no route{why}")
    return row.asDict()


def route_points(trips: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """``routes`` for trips between points, from candidates of both ends.

    ``trips`` has pair_id, origin_id and goal_id; ``candidates`` is of ``graph.snap_candidates`` with point_id; the two
    ends are of one component with the least access in sum.  Adds access_m.
    """
    side = lambda c, p: trips.select("pair_id", F.col(f"{c}_id").alias("point_id")).join(candidates, "point_id").select("pair_id", "component", F.col("edge_id").alias(f"{p}_edge"), F.col("frac").alias(f"{p}_frac"), F.col("access_m").alias(f"{p}_access"))
    both = side("origin", "o").join(side("goal", "g"), ["pair_id", "component"])  # one candidate of each component an end
    order = Window.partitionBy("pair_id").orderBy(F.col("o_access") + F.col("g_access"), "o_edge", "g_edge")
    best = checkpoint(both.withColumn("_n", F.row_number().over(order)).where("_n = 1").withColumn("access_m", F.col("o_access") + F.col("g_access")).drop("_n", "o_access", "g_access"))
    every = trips.select("pair_id").join(best, "pair_id", "left")
    return routes(edges, every.select("pair_id", "o_edge", "o_frac", "g_edge", "g_frac")).join(best.select("pair_id", "access_m"), "pair_id", "left")
