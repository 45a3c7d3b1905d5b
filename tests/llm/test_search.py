import numpy as np
import pytest
from pyspark.sql import functions as F

from haulspark.llm import ann, common, topk

ODD = [(900, None), (950, [float("nan")] * 8), (1000, [0.0] * 8), (1050, [1.0, None] + [0.0] * 6), (1100, [1.0] * 3), (None, [1.0] * 8), (1150, [float("inf")] + [0.0] * 7)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id bigint, embedding array<double>, vec string, part int")


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(8).round(2).tolist()) for i in range(700)]
    rows[100] = (100, rows[7][1])
    return rows + [(700 + i, rows[50][1]) for i in range(40)]  # ties


def brute(rows, every, k, score):
    m, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    out = {}
    for i, v in rows:
        if i % every == 0:
            s = score(m, np.array(v, float))
            other = ids != i
            top = np.lexsort((ids[other], -s[other]))[:k]
            out[i] = list(zip(ids[other][top].tolist(), s[other][top].tolist(), strict=True))
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_exact_top_products(spark, vectors, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 128)
    monkeypatch.setattr(topk, "QUERIES", 16)
    monkeypatch.setattr(topk, "CHUNK", 32)
    got = result(topk.top_products(table(spark, vectors + [o for o in ODD if o[0] not in (1000, 1100)]), k=20, query_every=20))
    want = brute([(i, np.floor(64 * np.array(v))) for i, v in vectors], 20, 20, lambda m, q: (m @ q).astype(np.int64))
    assert got == want


def test_top_products_edges(spark):
    assert topk.top_products(table(spark, [])).count() == 0
    assert result(topk.top_products(table(spark, [(0, [1.0]), (1, [2.0]), (2, [0.0])]), k=20)) == {0: [(1, 64 * 128), (2, 0)]}
    big = result(topk.top_products(table(spark, [(0, [2.0**19] * 2), (1, [2.0**19] * 2), (2, [-(2.0**30), 5.0]), (3, [2.0**25, 1.0])]), k=3))
    assert big == {0: [(3, 2**25 * 2**31 + 2**25 * 64), (1, 2 * (2**25) ** 2), (2, -(2**25) * 2**36 + 2**25 * 320)]}
    exact = result(topk.top_products(table(spark, [(0, [2.0**24, 3.0]), (1, [2.0**25, 1.0]), (2, [2.0**25, 1.0 + 1 / 64])]), k=2))
    assert exact == {0: [(2, 2**61 + 192 * 65), (1, 2**61 + 192 * 64)]}  # beyond what doubles tell apart
    with pytest.raises(Exception, match="64 bits"):
        topk.top_products(table(spark, [(0, [2.0**40] * 2), (1, [2.0**40] * 2)]), k=2).collect()


def test_vectors_meet_those_of_their_length(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (20, [1.0]), (50, [4.0]), (100, [1.0, 1.0, 1.0]), (7, [2.0, 2.0])]
    assert result(topk.top_products(table(spark, rows), k=2)) == {0: [(7, 64 * 64 * 6), (1, 64 * 64 * 5)], 20: [(50, 64 * 64 * 4)]}
    assert {q: [i for i, _ in f] for q, f in result(ann.nearest(table(spark, rows), k=2)).items()} == {0: [7, 1], 50: [20]}


def test_short_blocks_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    r = np.random.default_rng(8)
    rows = [(i, (v * (50 if i % 10 == 1 else 0.05)).tolist()) for i, v in enumerate(r.standard_normal((1000, 6)))]
    got = result(topk.top_products(table(spark, rows), k=20, query_every=20))
    assert got == brute([(i, np.floor(64 * np.array(v))) for i, v in rows], 20, 20, lambda m, q: (m @ q).astype(np.int64))


def test_near_neighbours_take_few_candidates():
    r = np.random.default_rng(4)
    centres = r.standard_normal((400, 48))
    mat = ann.unit(np.repeat(centres, 10, 0) + 0.05 * r.standard_normal((4000, 48)))
    forest, asked = ann.Forest(mat, 128, 11), np.arange(0, 4000, 50)
    found = [f for f, _ in forest.candidates(mat, mat[asked], [np.array([q]) for q in asked], 5, 0.02)]
    assert np.mean([len(f) for f in found]) < 0.1 * len(mat)
    hits = []
    for q, f in zip(asked, found, strict=True):
        s = mat @ mat[q]
        s[q] = -2
        best = set(np.argsort(-s)[:5].tolist())
        hits.append(len(best & set(f[np.argsort(-s[f])[:5]].tolist())) / 5)
    assert np.mean(hits) >= 0.98


def test_forest_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 1000)
    r = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((3000, 32)))]
    got = result(ann.nearest(table(spark, rows), k=5, query_every=50))

    def cos(m, q):
        return (m @ q) / np.linalg.norm(m, axis=1) / np.linalg.norm(q)

    want = brute(rows, 50, 5, cos)
    assert set(got) == set(want)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert recall >= 0.9
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(float(cos(np.array([rows[i][1]]), np.array(rows[q][1]))[0]), abs=1e-12)


def test_forest_edges(spark, vectors):
    assert ann.nearest(table(spark, [])).count() == 0
    got = result(ann.nearest(table(spark, vectors + ODD), k=5))
    assert [i for i, _ in got[50]] == [700, 701, 702, 703, 704]  # copies: ties to the smaller ids
    assert not {900, 950, 1000, 1050, 1100, 1150} & set(got)
    four = [(i, [1.0, 0.5, 0.2]) for i in range(5)] + [(9, [-1.0, 0.5, 0.2])]
    assert [i for i, _ in result(ann.nearest(table(spark, four), k=5))[0]] == [1, 2, 3, 4, 9]  # as many as there are
    assert [i for i, _ in result(ann.nearest(table(spark, [(0, [1e300, 1.0]), (1, [1e-300, 0.0]), (2, [0.0, 3.0])]), k=5))[0]] == [1, 2]


def test_copied_queries_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Queries of a few kB are copied to all blocks, which is where the planner takes them for small."""
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 4)
    r = np.random.default_rng(6)
    table(spark, [(i, r.standard_normal(8).tolist()) for i in range(1000)]).write.parquet(str(tmp_path / "v"))
    found = ann.nearest(spark.read.parquet(str(tmp_path / "v")), k=5)
    assert len(found.collect()) == 20 * 5
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_each_block_is_a_task(spark):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(50)], common.VECTOR)
    pairs = common.each_with_each(common.packed(v.repartition(9)), common.packed(v.repartition(3)), 9)
    at = pairs.select("part", "q_part", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["part"], r["q_part"]) for r in at) == [(p, q) for p in range(9) for q in range(3)]
    assert sorted({(r["task"], r["part"]) for r in at}) == [(p, p) for p in range(9)]
