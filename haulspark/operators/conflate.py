"""The same business in two sources: blocking, scoring, one-to-one matching, merging, collisions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.functions import score
from haulspark.functions.geo import geohash
from haulspark.functions.score import pair_band, pair_score
from haulspark.functions.text import digits, norm_name, set_similarity, short_key, squeeze, trigrams
from haulspark.operators.numbering import number
from haulspark.operators.spatial import dwithin
from haulspark.session import checkpoint


def staged(source: DataFrame, closed: str | None = None) -> DataFrame:
    """A source's rows that can be matched, with ``rid``: those with a category, a name and a place that isn't null
    island, and not closed (``closed`` names the column of the closing date).  rid follows source_record_id and name."""
    place = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    rows = source.where(F.col("category").isNotNull() & F.col("name").isNotNull() & place & (F.col(closed).isNull() if closed else F.lit(True)))
    return number(rows, ["source_record_id", "name"], "rid")


def candidate_pairs(a: DataFrame, b: DataFrame, radius_m: float = 150.0, min_sim: float = 0.3) -> DataFrame:
    """(o, f, name_sim, dist_m, score, band) of pairs within the radius whose names are similar enough.

    Both sides have rid, name, lon, lat and brand, and may have phone and address.
    """

    def ready(df: DataFrame) -> DataFrame:
        for c in ("brand", "phone", "address"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        return df.select("rid", "lon", "lat", trigrams(norm_name(F.col("name"))).alias("grams"), squeeze(F.col("brand")).alias("brand"), digits(F.col("phone")).alias("phone"), squeeze(F.col("address")).alias("address"))

    p = dwithin(ready(a), ready(b), radius_m)
    same = lambda c: (F.col(f"l.{c}") != "") & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    phone = (F.length("l.phone") >= 10) & (F.right(F.col("l.phone"), F.lit(10)) == F.right(F.col("r.phone"), F.lit(10)))
    p = p.withColumn("name_sim", set_similarity(F.col("l.grams"), F.col("r.grams"))).where(F.col("name_sim") > min_sim)
    bonus = F.when(same("brand") | phone | same("address"), 1.0).otherwise(0.0)
    p = p.select(F.col("l.rid").alias("o"), F.col("r.rid").alias("f"), "name_sim", "dist_m", pair_score(F.col("name_sim"), F.col("dist_m"), bonus, radius_m).alias("score"))
    return p.withColumn("band", pair_band(F.col("score")))


def match_one_to_one(pairs: DataFrame) -> DataFrame:
    """(o, f, score): the matching that taking pairs one by one, best score first, would give; ties to smaller ids.

    In each round the pairs that are best for both their ends are taken together; the order is total, so that is what
    the one-by-one way takes too.  Sides grow with the input while their shuffled bytes look small, so none is broadcast.
    """
    rest, out = checkpoint(pairs.select("o", "f", "score")), None
    key = lambda other: F.struct((-F.col("score")).alias("s"), F.col("o"), F.col("f"))
    while not rest.isEmpty():
        best_o = rest.groupBy("o").agg(F.min(key("f")).alias("bo"))
        best_f = rest.groupBy("f").agg(F.min(key("o")).alias("bf"))
        taken = checkpoint(rest.join(best_o.hint("merge"), "o").join(best_f.hint("merge"), "f").where((F.col("bo.o") == F.col("o")) & (F.col("bo.f") == F.col("f")) & (F.col("bf.o") == F.col("o")) & (F.col("bf.f") == F.col("f"))).select("o", "f", "score"))
        out = taken if out is None else out.unionByName(taken)
        rest = checkpoint(rest.join(taken.select("o").hint("merge"), "o", "left_anti").join(taken.select("f").hint("merge"), "f", "left_anti"))
    return out if out is not None else pairs.select("o", "f", "score").limit(0)


def gray_ids(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """(src, rid) of rows to flag gray: both ends of gray pairs, and of pairs good enough to merge that lost the matching."""
    lost = pairs.where("band = 'merge'").select("o", "f").join(matches.select("o", "f").hint("merge"), ["o", "f"], "left_anti")
    g = pairs.where("band = 'gray'").select("o", "f").unionByName(lost)
    return g.select(F.lit("a").alias("src"), F.col("o").alias("rid")).union(g.select(F.lit("b"), "f")).distinct()


#: Taken from the canonical row as they are; other columns that both sources have fill each other's nulls.
IDENTITY = ("name", "category", "lon", "lat")
#: The confidence of a source without one; a row at least as sure as that is canonical.
ASSUMED_CONFIDENCE = 0.5


def _one(x: Column, y: Column, canonical: Column, columns: list[str]) -> list[Column]:
    """Columns of a row and its counterpart, both structs, as one row; ``canonical``: the first row's values come first."""

    def pick(c: str) -> Column:
        if c == "observed_at":
            return F.greatest(x[c], y[c])
        if c in IDENTITY:
            return F.when(canonical, x[c]).otherwise(y[c])
        return F.when(canonical, F.coalesce(x[c], y[c])).otherwise(F.coalesce(y[c], x[c]))

    return [pick(c).alias(c) for c in columns]


def merge(a: DataFrame, b: DataFrame, matches: DataFrame, pairs: DataFrame | None = None, canonical_conf: float = ASSUMED_CONFIDENCE) -> DataFrame:
    """(o, f, shared columns, conf, src, present_in, gray): merged pairs and the rows of both that have no match.

    ``a`` has rid and conf, ``b`` rid.  ``src`` is merged, a or b; ``present_in`` lists the sources; ``observed_at``
    is the later one.  With ``pairs`` of candidate_pairs, ``gray`` marks rows that had an ambiguous counterpart,
    merged or not.
    """
    shared = [c for c in a.columns if c in b.columns and c not in ("rid", "conf")]
    gray = gray_ids(pairs, matches) if pairs is not None else None

    def marked(df: DataFrame, src: str) -> DataFrame:
        if gray is None:
            return df.withColumn("gray", F.lit(False))
        g = gray.where(F.col("src") == src).select("rid", F.lit(True).alias("gray"))
        return df.join(g.hint("merge"), "rid", "left").withColumn("gray", F.coalesce("gray", F.lit(False)))

    a, b = marked(a, "a"), marked(b, "b")
    m = matches.select("o", "f").join(a.select(F.col("rid").alias("o"), F.struct("*").alias("a")).hint("merge"), "o").join(b.select(F.col("rid").alias("f"), F.struct("*").alias("b")).hint("merge"), "f")
    first = F.coalesce(F.col("a.conf"), F.lit(0.0)) >= canonical_conf
    sources = lambda *x: F.array(*[F.lit(s) for s in x]).alias("present_in")
    both = m.select("o", "f", *_one(F.col("a"), F.col("b"), first, shared), F.col("a.conf").alias("conf"), F.lit("merged").alias("src"), sources("a", "b"), (F.col("a.gray") | F.col("b.gray")).alias("gray"))
    only_a = a.join(matches.select(F.col("o").alias("rid")).hint("merge"), "rid", "left_anti").select(F.col("rid").alias("o"), F.lit(None).cast("bigint").alias("f"), *shared, "conf", F.lit("a").alias("src"), sources("a"), "gray")
    only_b = b.join(matches.select(F.col("f").alias("rid")).hint("merge"), "rid", "left_anti").select(F.lit(None).cast("bigint").alias("o"), F.col("rid").alias("f"), *shared, F.lit(None).cast(a.schema["conf"].dataType).alias("conf"), F.lit("b").alias("src"), sources("b"), "gray")
    return both.unionByName(only_a).unionByName(only_b)


def resolve_collisions(rows: DataFrame, canonical_conf: float = ASSUMED_CONFIDENCE) -> DataFrame:
    """One row per squeezed name and geohash cell, with ``key``, ``cell_flag`` and ``dropped``.

    Two single rows of the two sources are one business: they become a merged row with the values of both, flagged
    cell_name_merge.  Of other groups the row of most sources stays, then the latest, then the smaller ids, flagged
    cell_name_collision; ``dropped`` counts the rest.
    """
    key = F.concat_ws("|", squeeze(F.col("name")), geohash(F.col("lat"), F.col("lon"), 7))
    own = rows.columns
    late = [F.col("observed_at").isNull().alias("undated"), _descending(rows).alias("age")] if "observed_at" in own else []
    order = F.struct((-F.size("present_in")).alias("n"), *late, F.coalesce("o", F.lit(2**62)).alias("o"), F.coalesce("f", F.lit(2**62)).alias("f"))
    r = rows.select(key.alias("key"), order.alias("order"), F.struct(*own).alias("row"), "src")
    side = lambda s: F.min_by(F.when(F.col("src") == s, F.col("row")), F.when(F.col("src") == s, F.col("order"))).alias(s)
    g = r.groupBy("key").agg(F.min_by("row", "order").alias("best"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("src") == "a").alias("na"), F.count_if(F.col("src") == "b").alias("nb"), side("a"), side("b"))
    pair = (F.col("n") == 2) & (F.col("na") == 1) & (F.col("nb") == 1)
    first = F.coalesce(F.col("a.conf"), F.lit(0.0)) >= canonical_conf
    fixed = {"o": F.col("a.o"), "f": F.col("b.f"), "conf": F.col("a.conf"), "src": F.lit("merged"), "present_in": F.array(F.lit("a"), F.lit("b")), "gray": F.col("a.gray") | F.col("b.gray")}
    shared = [c for c in own if c not in fixed]
    joined = dict(zip(shared, _one(F.col("a"), F.col("b"), first, shared), strict=True)) | fixed
    return g.select("key", *[F.when(pair, joined[c]).otherwise(F.col(f"best.{c}")).alias(c) for c in own], F.when(pair, "cell_name_merge").when(F.col("n") > 1, "cell_name_collision").alias("cell_flag"), F.when(pair, 0).otherwise(F.col("n") - 1).alias("dropped"))


def _descending(rows: DataFrame) -> Column:
    """A number that falls as observed_at rises."""
    kind, c = dict(rows.dtypes)["observed_at"], F.col("observed_at")
    if kind == "date":
        return -F.unix_date(c)
    return -F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else -c


def publish(rows: DataFrame, now: Column, weights: Mapping[str, int], half_life_days: float = 180.0, inferred: Column | None = None) -> DataFrame:
    """Published businesses: ``business_id`` of name and place, confidence with its parts, and flags.

    ``rows`` is of resolve_collisions with observed_at; ``weights`` says what counts for completeness; ``inferred`` is
    the fuel inference, ``text.inferred_brand``, kept as ``def``.  More than one source corroborates; flags are
    dedup_gray_zone and the cell's.
    """
    place = [F.format_string("%.5f", F.col(c)) for c in ("lat", "lon")]
    s = score.confidence(F.lit(score.TRUST["open_aggregate"]), score.decay(F.col("observed_at"), now, half_life_days), score.completeness(weights), score.agreement(F.lit(0), F.size("present_in") > 1), F.lit(False), F.lit(0))
    flags = F.array_compact(F.array(F.when(F.col("gray"), "dedup_gray_zone"), F.col("cell_flag")))
    out = rows.withColumn("business_id", short_key("biz_", squeeze(F.col("name")), *place)).withColumn("_s", s).withColumn("def", inferred if inferred is not None else F.lit(None).cast("string"))
    return out.select("business_id", *[c for c in rows.columns if c not in ("key", "cell_flag", "dropped", "gray")], "def", "_s.*", flags.alias("flags"))


def workload(a: DataFrame, b: DataFrame, pairs: DataFrame, limit: int = 5_000_000) -> DataFrame:
    """One row that says what a conflation has to hold: rows of both sides, pairs by band, distinct gray ids, and the
    verdict run_as_is, spill_first from ``limit`` merge pairs and gray ids on, or empty_source."""
    gray = F.col("band") == "gray"
    p = pairs.agg(
        F.count(F.lit(1)).alias("blocked_pairs"), F.count_if(F.col("band") == "merge").alias("merge_band_pairs"), F.count_if(gray).alias("gray_band_pairs"), F.count_if(F.col("band") == "distinct").alias("distinct_band_pairs"),
        F.countDistinct(F.when(gray, F.col("o"))).alias("gray_ids_a"), F.countDistinct(F.when(gray, F.col("f"))).alias("gray_ids_b"),
    )
    n = a.agg(F.count(F.lit(1)).alias("rows_a")).join(F.broadcast(b.agg(F.count(F.lit(1)).alias("rows_b"))))  # a row each
    units = F.col("merge_band_pairs") + F.col("gray_ids_a") + F.col("gray_ids_b")
    verdict = F.when((F.col("rows_a") == 0) | (F.col("rows_b") == 0), "empty_source").when(units < limit, "run_as_is").otherwise("spill_first")
    return n.join(F.broadcast(p)).withColumn("units", units).withColumn("verdict", verdict)
