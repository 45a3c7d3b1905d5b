"""Lines joined end to end and simplified, where no chain has to fit into a task.

Where exactly two ends of lines meet, the lines are one chain.  Each line can be passed both ways; what comes next is a
pointer, and pointer jumping ranks all lines of all chains in about log n rounds.  A chain is then simplified by
Douglas and Peucker: stretches of more than LOCAL points find their farthest point by aggregation and are split there,
all stretches in one round; shorter ones are finished in groups.  New pieces that would cross another line are split
again, so that a simplified corridor meets itself where it did before and nowhere else.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.session import spread, written

#: Points of a stretch that a task simplifies by itself.
LOCAL = 20_000
#: Places of a line's points within a chain: its rank, then 24 bits.
BITS = 24
#: Degrees of a cell in which pieces are held against each other.
CELL = 0.05
#: Pieces of each corridor that new pieces are held against first, and rows of a side that is broadcast at most.
FIRST, BROADCAST = 256, 200_000


def _darts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, edge, way, after, after_way): each line passed from its start (way 0) and from its end (1), and the line
    that follows, null where not exactly two ends meet."""
    end = lambda side, at: F.struct(F.lit(side).alias("side"), at["lon"].alias("lon"), at["lat"].alias("lat"))
    ends = lines.select(*keys, F.col("edge_id").alias("edge"), F.inline(F.array(end(0, F.element_at("line", 1)), end(1, F.element_at("line", -1)))))
    point = [*keys, "lon", "lat"]
    two = ends.groupBy(*point).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("edge", "side")).alias("a"), F.max(F.struct("edge", "side")).alias("b")).where("n = 2 and a.edge <> b.edge")
    link = lambda one, other: F.struct(F.col(f"{one}.edge").alias("edge"), (1 - F.col(f"{one}.side")).alias("way"), F.col(f"{other}.edge").alias("after"), F.col(f"{other}.side").alias("after_way"))
    links = two.select(*keys, F.inline(F.array(link("a", "b"), link("b", "a"))))  # who leaves by side s passes on way 1 - s
    every = lines.select(*keys, F.col("edge_id").alias("edge"), F.explode(F.array(F.lit(0), F.lit(1))).alias("way"))
    return every.join(links, [*keys, "edge", "way"], "left")


def _ranked(darts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, edge, way, last, last_way, steps, least, open): the end of each dart's list, how far it is, and the least
    edge from there on; ``open`` is false where the list is a circle, whose least edge ``least`` is."""
    at = written(darts.select(
        *keys, "edge", "way", F.coalesce("after", "edge").alias("last"), F.coalesce("after_way", "way").alias("last_way"), F.when(F.col("after").isNull(), 0).otherwise(1).cast("bigint").alias("steps"),
        F.least("edge", F.coalesce("after", "edge")).alias("least"), F.col("after").isNull().alias("open"),
    ))
    rounds = max(1, at.count()).bit_length() + 1
    for _ in range(rounds):
        if at.where(~F.col("open")).isEmpty():
            break
        on = at.select(*keys, F.col("edge").alias("last"), F.col("way").alias("last_way"), F.col("last").alias("_l"), F.col("last_way").alias("_w"), F.col("steps").alias("_s"), F.col("least").alias("_m"), F.col("open").alias("_o"))
        moved = at.where(~F.col("open")).join(on, [*keys, "last", "last_way"])
        moved = moved.select(*keys, "edge", "way", F.col("_l").alias("last"), F.col("_w").alias("last_way"), (F.col("steps") + F.col("_s")).alias("steps"), F.least("least", "_m").alias("least"), F.col("_o").alias("open"))
        at = written(at.where("open").unionByName(moved))
    return at


def chains(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chain, pos, edge_id, way) of every line (edge_id, line) of two points or more within the same keys.

    ``chain`` is the chain's least edge_id, which runs forward (way 0) in it; pos counts from 0.  A circle starts with
    its least edge.  Edge ids are unique within the keys.
    """
    darts = written(_darts(lines.where(F.size("line") > 1), keys))
    at = _ranked(darts, keys)
    circles = at.where(~F.col("open"))
    if not circles.isEmpty():
        # The circle that passes its least edge forward is cut before it; ranked again, it is a list.
        starts = circles.where("edge = least and way = 0").select(*keys, F.col("edge").alias("after"), F.col("way").alias("after_way"), F.lit(True).alias("_cut"))
        open_ = darts.join(circles.select(*keys, "edge", "way"), [*keys, "edge", "way"], "left_semi").join(starts, [*keys, "after", "after_way"], "left")
        open_ = open_.select(*keys, "edge", "way", F.when(F.col("_cut").isNull(), F.col("after")).alias("after"), F.when(F.col("_cut").isNull(), F.col("after_way")).alias("after_way"))
        again = _ranked(open_, keys).where("open")  # the other way round is still a circle
        at = at.where("open").unionByName(again)
    group = [*keys, "last", "last_way"]
    kept = at.groupBy(*group).agg(F.min(F.struct("edge", "way")).alias("m"), F.max("steps").alias("n")).where("m.way = 0").select(*group, F.col("m.edge").alias("chain"), "n")
    return at.join(kept, group).select(*keys, "chain", (F.col("n") - F.col("steps")).alias("pos"), F.col("edge").alias("edge_id"), "way")


def chain_points(lines: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chain, o, lon, lat): the points of chains; ``o`` orders them, and where lines meet there is one point."""
    line = F.when(F.col("way") == 0, F.col("line")).otherwise(F.reverse("line"))
    p = lines.select(*keys, "edge_id", "line").join(ranked, [*keys, "edge_id"]).select(*keys, "chain", "pos", F.posexplode(line).alias("k", "p"))
    return p.where("k > 0 or pos = 0").select(*keys, "chain", (F.shiftleft(F.col("pos"), BITS) + F.col("k")).alias("o"), "p.lon", "p.lat")


def _away(x: Column, y: Column) -> Column:
    """How far a point is from the line through a stretch's ends, or from its end if both are one place."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = F.sqrt(dx * dx + dy * dy)
    return F.when(size > 0, F.abs(dx * (F.col("ay") - y) - (F.col("ax") - x) * dy) / size).otherwise(F.sqrt(F.pow(x - F.col("ax"), 2) + F.pow(y - F.col("ay"), 2)))


def _stretches(points: DataFrame, group: list[str]) -> DataFrame:
    """Each chain as one stretch: (group, lo, hi, ax, ay, bx, by, n, first)."""
    first, last = F.min(F.struct("o", "lon", "lat")).alias("a"), F.max(F.struct("o", "lon", "lat")).alias("b")
    s = points.groupBy(*group).agg(first, last, F.count(F.lit(1)).alias("n"))
    return s.select(*group, F.col("a.o").alias("lo"), F.col("b.o").alias("hi"), F.col("a.lon").alias("ax"), F.col("a.lat").alias("ay"), F.col("b.lon").alias("bx"), F.col("b.lat").alias("by"), "n", F.lit(True).alias("first"))


def _split(inner: DataFrame, stretches: DataFrame, group: list[str], tolerance: float | None) -> tuple[DataFrame, DataFrame]:
    """Stretches cut at the point farthest from their ends, if that is beyond the tolerance (None: always), and the
    inner points that are left in the new stretches; a circle is always cut."""
    on = [*group, "lo"]
    d = inner.join(stretches.select(*on, "hi", "ax", "ay", "bx", "by", "first"), on)
    far = d.groupBy(*on).agg(F.max(F.struct(_away(F.col("lon"), F.col("lat")).alias("d"), (-F.col("o")).alias("less"), "lon", "lat")).alias("f"), F.count(F.lit(1)).alias("c"))
    s = stretches.join(far, on)
    circle = F.col("first") & (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")) & (F.col("c") > 1)
    cut = s if tolerance is None else s.where((F.col("f.d") > tolerance) | circle)
    cut = written(cut.select(*on, "hi", "ax", "ay", "bx", "by", (-F.col("f.less")).alias("mid"), F.col("f.lon").alias("mx"), F.col("f.lat").alias("my")))
    half = lambda lo, hi, a, b: F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.col(f"{a}x").alias("ax"), F.col(f"{a}y").alias("ay"), F.col(f"{b}x").alias("bx"), F.col(f"{b}y").alias("by"))
    halves = cut.select(*group, F.inline(F.array(half("lo", "mid", "a", "m"), half("mid", "hi", "m", "b"))))
    moved = inner.join(cut.select(*on, "mid"), on).where("o <> mid")
    moved = written(moved.select(*group, F.when(F.col("o") > F.col("mid"), F.col("mid")).otherwise(F.col("lo")).alias("lo"), "o", "lon", "lat"))
    counts = moved.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return written(halves.join(counts, on, "left").withColumn("n", F.coalesce("n", F.lit(0)) + 2).withColumn("first", F.lit(False))), moved


def simplified(points: DataFrame, keys: list[str], tolerance: float, local: int = LOCAL) -> DataFrame:
    """(keys, chain, lo, hi, ax, ay, bx, by): the pieces that are left of each chain (of ``chain_points``), by Douglas
    and Peucker; of points equally far the first one stays.  A circle keeps its farthest point."""
    from haulspark.operators.tiles import simplify

    group = [*keys, "chain"]
    points = written(points)
    stretches = written(_stretches(points, group))
    inner = written(points.join(stretches.select(*group, "lo", "hi"), group).where("o > lo and o < hi").select(*group, "lo", "o", "lon", "lat"))
    done = None
    while True:
        large = stretches.where(F.col("n") > local)
        small = stretches.where(F.col("n") <= local)
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            break
        rest = inner
        inner_large = inner.join(large.select(*group, "lo"), [*group, "lo"], "left_semi")
        new, moved = _split(inner_large, large, group, tolerance)
        # what was not cut is flat; what was goes on
        flat = large.join(new.select(*group, "lo").distinct(), [*group, "lo"], "left_anti").withColumn("n", F.lit(2).cast("bigint"))
        done = written(done.unionByName(flat))
        inner = written(rest.join(large.select(*group, "lo"), [*group, "lo"], "left_anti").unionByName(moved))
        stretches = new
    kinds = dict(points.dtypes)
    names = [*group, "lo", "hi", "ax", "ay", "bx", "by"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in group) + ", lo bigint, hi bigint, ax double, ay double, bx double, by double"

    def finish(stretches: pa.Table, inner: pa.Table) -> pa.Table:
        own: dict[str, list] = {}
        for key, *point in zip(*(inner.column(c).to_pylist() for c in ("_key", "o", "lon", "lat")), strict=True):
            own.setdefault(key, []).append(tuple(point))
        out = []
        for s in stretches.to_pylist():
            points = [(s["lo"], s["ax"], s["ay"]), *sorted(own.get(s["_key"], ())), (s["hi"], s["bx"], s["by"])]
            kept = simplify([p[1:] for p in points], tolerance, circle=bool(s["first"]), places=True)
            for a, b in zip(kept, kept[1:], strict=False):
                ends = zip(names[len(group) :], (points[a][0], points[b][0], *points[a][1:], *points[b][1:]), strict=True)
                out.append({**{c: s[c] for c in group}, **dict(ends)})
        return pa.Table.from_pylist(out, schema=pa.schema([stretches.schema.field(c) for c in names]))

    short = done.where("n <= 2").select(*names)
    longer = done.where("n > 2")
    # Most stretches are short, so a task takes many of them together: some ``local`` points.
    buckets = max(1, -(-(longer.agg(F.sum("n")).first()[0] or 0) // local))
    dealt = lambda d: spread(d.withColumn("_key", F.to_json(F.struct(*group, "lo"))).withColumn("_b", F.pmod(F.xxhash64(*group, "lo"), F.lit(buckets))), "_b").groupBy("_b")
    return short.unionByName(dealt(longer).cogroup(dealt(inner)).applyInArrow(finish, schema))


def _dealt(pieces: DataFrame) -> DataFrame:
    """The pieces in each cell (cx, cy) that they pass."""
    side = lambda a, b: F.sequence(F.floor(F.least(a, b) / CELL), F.floor(F.greatest(a, b) / CELL))
    dealt = pieces.withColumn("cx", F.explode(side("ax", "bx")))
    slope = (F.col("by") - F.col("ay")) / F.when(F.col("bx") != F.col("ax"), F.col("bx") - F.col("ax"))
    y = lambda x: F.coalesce(F.col("ay") + slope * (F.least(F.greatest(x, F.least("ax", "bx")), F.greatest("ax", "bx")) - F.col("ax")), F.col("ay"))
    y0, y1 = y(F.col("cx") * CELL), F.when(F.col("bx") != F.col("ax"), y((F.col("cx") + 1) * CELL)).otherwise(F.col("by"))
    return dealt.withColumn("cy", F.explode(F.sequence(F.floor(F.least(y0, y1) / CELL - 1e-9), F.floor(F.greatest(y0, y1) / CELL + 1e-9))))


def _counted(df: DataFrame) -> DataFrame:
    """Broadcast, if it is of few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df.hint("merge")


def _met(new: DataFrame, others: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """The new pieces (keys, chain, lo) that one of the others crosses; ``on`` are columns that both must have alike."""
    turn = lambda p, q, r: (F.col(f"{q}x") - F.col(f"{p}x")) * (F.col(f"{r}y") - F.col(f"{p}y")) - (F.col(f"{q}y") - F.col(f"{p}y")) * (F.col(f"{r}x") - F.col(f"{p}x"))
    cross = (turn("a", "b", "o_a") * turn("a", "b", "o_b") < 0) & (turn("o_a", "o_b", "a") * turn("o_a", "o_b", "b") < 0)
    met = new.join(others, on).where((F.col("chain") != F.col("o_chain")) | (F.col("lo") != F.col("o_lo"))).where(cross)
    return written(met.select(*keys, "chain", "lo").distinct())


def _crossing(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """The new pieces (keys, chain, lo) of which an inner place lies on another piece of the same keys.

    One crossing is enough, so where lines cross each other often, FIRST pieces of each corridor tell of nearly all new
    pieces; only those that none of these crosses are held against all pieces, by cells."""
    one = [*keys, "chain", "lo"]
    new = written(pieces.where("fresh").select(*one, "ax", "ay", "bx", "by"))
    other = lambda d, *more: d.select(*keys, *more, *[F.col(c).alias(f"o_{c}") for c in ("chain", "lo", "ax", "ay", "bx", "by")])
    many = pieces.join(F.broadcast(new.select(*keys).distinct()), keys, "left_semi") if keys and new.select(*keys).distinct().count() <= BROADCAST else pieces
    sizes = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sample = many.join(sizes, keys) if keys else many.crossJoin(sizes)
    sample = written(other(sample.where(F.pmod(F.xxhash64("chain", "lo"), F.lit(2**32)) / float(2**32) * F.col("_n") < FIRST)))
    bad = _met(spread(new, "chain", "lo"), _counted(sample), keys, keys)
    rest = written(_dealt(new.join(bad, one, "left_anti")))
    if rest.isEmpty():
        return bad
    return bad.unionByName(_met(_counted(rest), other(_dealt(spread(pieces, "chain", "lo")), "cx", "cy"), keys, [*keys, "cx", "cy"]))


def kept_apart(points: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """The pieces, where each new one that crosses another one of the same keys is cut again at its farthest point
    until none crosses that has points left to give.  Lines that cross each other as they are stay so."""
    group, names = [*keys, "chain"], [*keys, "chain", "lo", "hi", "ax", "ay", "bx", "by"]
    pieces = written(pieces)
    points = written(points)
    inner = written(_inner(points, pieces, group))
    while True:
        left = inner.select(*group, "lo").distinct().withColumn("fresh", F.lit(True))
        marked = pieces.join(left, [*group, "lo"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
        bad = written(_crossing(marked, keys))
        if bad.isEmpty():
            return pieces
        chosen = pieces.join(bad, [*group, "lo"], "left_semi").withColumn("first", F.lit(False)).withColumn("n", F.lit(0))
        new, moved = _split(inner.join(bad, [*group, "lo"], "left_semi"), chosen, group, None)
        pieces = written(pieces.join(bad, [*group, "lo"], "left_anti").unionByName(new.select(*names)))
        inner = written(inner.join(bad, [*group, "lo"], "left_anti").unionByName(moved))


def _inner(points: DataFrame, pieces: DataFrame, group: list[str]) -> DataFrame:
    """Which piece each point lies inside of: (group, lo, o, lon, lat).

    Pieces and points are put in one order in buckets of ranks, so that no chain is a group of its own."""
    bucket = lambda c: F.shiftright(c, BITS + 10)
    p = points.withColumn("b", bucket(F.col("o")))
    s = pieces.where("hi > lo + 1").select(*group, "lo", "hi", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))).alias("b"))
    return p.join(s, [*group, "b"]).where("o > lo and o < hi").select(*group, "lo", "o", "lon", "lat")


def corridor_lines(segments: DataFrame, keys: list[str], tolerance_deg: float) -> DataFrame:
    """(keys, chain, line): the chains of each corridor, simplified without new crossings."""
    lines = written(segments.select(*keys, "edge_id", "line").where(F.size("line") > 1))
    points = chain_points(lines, written(chains(lines, keys)), keys)
    points = written(points)
    pieces = kept_apart(points, simplified(points, keys, tolerance_deg), keys)
    group = [*keys, "chain"]
    at = F.sort_array(F.collect_list(F.struct("lo", "ax", "ay", "bx", "by"))).alias("p")
    spot = lambda s, a: F.struct(s[f"{a}x"].alias("lon"), s[f"{a}y"].alias("lat"))
    line = F.concat(F.transform("p", lambda s: spot(s, "a")), F.array(spot(F.element_at("p", -1), "b")))
    return pieces.groupBy(*group).agg(at).select(*group, line.alias("line"))
