import numpy as np

from offerloom.llm.neighbours import nearest
from offerloom.llm.queries import QUERIES


def brute(ids, x, asked, k):
    out = {}
    for q in asked:
        scores = x @ x[ids.tolist().index(q)]
        found = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != q)[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_all_rows_found_when_leaves_hold_them(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).round(1)
    x[40:60] = x[3]  # ties
    rows = [(i, x[i].tolist(), "e") for i in range(300)]
    rows += [(900, None, ""), (901, [0.0] * 8, ""), (902, [float("nan")] + [1.0] * 7, ""), (903, [float("inf")] * 8, ""), (904, [None] + [1.0] * 7, ""), (905, [1.0], ""), (None, [1.0] * 8, ""), rows[5]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(3)
    got = collected(nearest(table, table.filter("vec_id % 20 = 0")))
    want = brute(np.arange(300), x, range(0, 300, 20), 20)
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert np.allclose([s for _, _, s in found], [s for _, s in want[q]])
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found, found[1:]))


def test_few_rows_and_empty_tables(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 0.0]), (2, [-1.0, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest(table, table.filter("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 2.0), (0, 2, 2, 0.0)]
    assert nearest(table.limit(0), table).collect() == [] and nearest(table, table.limit(0)).collect() == []


def test_recall_on_the_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    got = collected(QUERIES["op8_nearest_neighbours"](spark, "/root/testdata/sf0.1"))
    want = brute(ids, x, [i for i in ids.tolist() if i % 20 == 0], 20)
    hits = [len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want]
    assert np.mean(hits) / 20 >= 0.9
