"""Line deduplication by site-relative frequency.

For each host, the share of its pages that contain a line is set against a boilerplate ratio; lines above it go.
Lines are counted by hash with map-side sums, so a line that every page has is one row per task; a page learns its
lines to drop by a join on its own content, so no host is ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.llm.common import numbered, place


#: White space that is trimmed from the ends of lines.
BLANK = " \t\r\x0b\x0c\xa0\u2028\u3000"


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def _mark(line: Column) -> Column:
    """96 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.crc32(line.cast("binary")).alias("b"))


def dedup_lines(pages: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """All columns of ``pages`` with the text cleaned, plus n_lines and n_dropped.

    A line is what stands between line feeds, without white space at its ends; a page counts once for a line it
    repeats.  A line is dropped from the pages of a host where more than ``max_ratio`` of the host's pages have it
    and at least ``min_pages`` do; empty lines stay.  A null host is a host; a null text counts as empty and becomes
    empty; repeated rows are pages of their own; no rows give no rows.
    """
    names = pages.columns
    own = lambda n: next(x for x in (n, *(f"{n}_{i}" for i in range(len(names) + 1))) if x.lower() not in {y.lower() for y in names})
    key, bad, lines, cuts = "_key", "_bad", "_lines", "_cuts"
    text_at, host_at = f"c{place(pages, text_col)}", f"c{place(pages, host_col)}"
    pages = numbered(pages)
    text = F.coalesce(F.col(text_at), F.lit(""))
    host = F.col(host_at).cast("string")
    page_key = F.md5(F.concat(F.coalesce(F.concat(F.lit("h"), host), F.lit("n")), F.lit("\n"), text))

    d = pages.select(host.alias("host"), text.alias("text"))
    marks = F.transform(F.array_distinct(F.filter(F.transform(F.split("text", "\n"), _bare), lambda x: x != "")), _mark)
    totals = d.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = d.select("host", F.explode(marks).alias("m")).groupBy("host", "m").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("n") >= min_pages)
    boiler = counts.join(totals, counts.host.eqNullSafe(totals.host)).where(F.col("n") > F.lit(float(max_ratio)) * F.col("pages")).select(counts.host.alias("bh"), "m")

    at = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(_bare(x).alias("x"), i.alias("i"))), lambda s: s["x"] != "")
    each = pages.select(host.alias("host"), page_key.alias("k"), text.alias("text")).select("host", "k", F.explode(at).alias("s"))
    each = each.select("host", "k", _mark(F.col("s.x")).alias("m"), F.col("s.i").alias("i"))
    drop = each.join(boiler, each.host.eqNullSafe(boiler.bh) & (each.m == boiler.m)).groupBy("k").agg(F.sort_array(F.collect_set("i")).alias(bad))  # at most a page's lines
    joined = pages.withColumn(key, page_key).join(drop.withColumnRenamed("k", key), key, "left")
    # what stays are the stretches between the places of dropped lines; most pages lose nothing and are not taken apart
    joined = joined.withColumn(lines, F.when(F.col(bad).isNotNull(), F.split(text, "\n")))
    joined = joined.withColumn(cuts, F.concat(F.array(F.lit(-1)), bad, F.array(F.size(lines))))
    stretches = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.slice(lines, F.element_at(cuts, i) + 2, F.element_at(cuts, i + 1) - F.element_at(cuts, i) - 1))
    joined = joined.withColumn(lines, F.when(F.col(bad).isNotNull(), F.flatten(stretches)))
    rest = [F.when(F.col(lines).isNull(), text).otherwise(F.array_join(lines, "\n")).alias(c) if c == text_at else F.col(c) for c in pages.columns]
    n = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    out = joined.select(*rest, n.alias("_n"), F.when(F.col(lines).isNull(), 0).otherwise(n - F.size(lines)).cast("bigint").alias("_d"))
    return out.toDF(*names, own("n_lines"), own("n_dropped"))


#: DuckDB's form of the query over ``documents``.
SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
u AS (SELECT source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12) || chr(160) || chr(8232) || chr(12288))), lambda x: x <> ''))) AS line FROM d),
c AS (SELECT source, line, count(*) AS n FROM u GROUP BY source, line HAVING count(*) >= 5),
b AS (SELECT c.source, list(line) AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n > 0.1::DOUBLE * pages GROUP BY c.source),
k AS (SELECT doc_id, string_split(text, chr(10)) AS ls, list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(bad, trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12) || chr(160) || chr(8232) || chr(12288))), false)) AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k
"""
