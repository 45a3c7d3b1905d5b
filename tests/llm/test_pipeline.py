import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402
import pytest  # noqa: E402

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept, packed = docs.columns, docs, None
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, kept, SF).checkpoint()
        if k < 3:
            assert kept.columns == columns
            sizes.append(kept.count())
        else:
            packed = kept
    assert sizes[0] > sizes[1] == sizes[2] >= sizes[3] > 0
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").select("doc_id")
    after = corpus_pipeline.toxicity(spark, docs, SF)
    assert docs.join(labels, "doc_id", "left_semi").join(after.select("doc_id"), "doc_id", "left_anti").count() == 0  # clean documents stay
    run = corpus_pipeline.run(spark, SF).toPandas().sort_values(["doc_id", "start"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(run[["doc_id", "start", "ids_crc32"]][run.start == 0], packed.toPandas().sort_values(["doc_id", "start"]).reset_index(drop=True)[["doc_id", "start", "ids_crc32"]][lambda d: d.start == 0], check_like=True)


def test_run_equals_brute_force(spark):
    """Rejected documents are those that are scored toxic; the other stages in plain Python; every piece's ids."""
    import sys

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    sys.path.insert(0, os.path.dirname(__file__))
    from test_documents import brute
    from test_tokens import check_packing

    from haulspark.llm.toxicity import toxic_scores

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r["doc_id"] for r in toxic_scores(docs, labels).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect() if r["doc_id"] not in toxic]
    blank = " \t\r\x0b\x0c\xa0\u2028\u3000"
    pages, seen = {}, {}
    for _, t, h in rows:
        pages[h] = pages.get(h, 0) + 1
        for x in {x.strip(blank) for x in t.split("\n")} - {""}:
            seen[h, x] = seen.get((h, x), 0) + 1
    rows = [(i, "\n".join(x for x in t.split("\n") if not (seen.get((h, x.strip(blank)), 0) >= 5 and seen[h, x.strip(blank)] > 0.1 * pages[h])), h) for i, t, h in rows]
    _, classes = brute(rows)
    first = {}
    for (i, _, _), c in zip(rows, classes, strict=True):
        first[c] = min(i, first.get(c, i))
    rows = [r for r, c in zip(rows, classes, strict=True) if r[0] == first[c]]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == {i for i, _, _ in rows}
    number = {i: n for n, (i, _, _) in enumerate(rows)}
    from pyspark.sql import Row

    check_packing([Row(**(r.asDict() | {"doc_id": number[r["doc_id"]]})) for r in got], [x for _, x, _ in rows], lambda x: t.encode(x, add_special_tokens=False).ids, 2048)
    assert np.all([r["sequence_id"] >= 0 for r in got])


def test_line_dedup_query_equals_sql(spark):
    from haulspark.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF).toPandas()
        want = con.execute(sql).df()
        cols = sorted(got.columns)
        key = ["doc_id"] if "doc_id" in cols else ["query_id", "rank"]
        a, b = (x[cols].sort_values(key).reset_index(drop=True) for x in (got, want))
        pd.testing.assert_frame_equal(a, b, check_dtype=False)
