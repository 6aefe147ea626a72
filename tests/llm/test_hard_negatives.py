import random

import numpy as np
import pytest

from offerloom.llm import hard_negatives
from offerloom.llm.hard_negatives import mine
from offerloom.llm.queries import QUERIES, SQL


def brute(rows, anchors, positives=5, negatives=5, low=80):
    """rows: id -> (label, vector)."""
    out = []
    for a in anchors:
        label, vector = rows[a]
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(vector, v)))), i, l == label) for i, (l, v) in rows.items() if i != a and len(v) == len(vector))
        for ps, p, same in [s for s in scored if s[2]][:positives]:
            found = [(n, -ns) for ns, n, same in scored if not same and low * -ps <= 100 * -ns <= 100 * -ps][:negatives]
            out += [(a, p, k, n, -ps, ns) for k, (n, ns) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, cell", [(0, 20_000), (1, 20_000), (2, 7), (3, 3)])
def test_against_brute_force(spark, monkeypatch, seed, cell):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", cell)
    rng = random.Random(seed)
    largest = [3, 40, 3, 10**6][seed]
    rows = {i: (rng.randint(0, 3), [rng.randint(-largest, largest) for _ in range(4)]) for i in range(120)}
    rows |= {i: (rng.randint(0, 3), rows[5][1]) for i in range(200, 240)}  # copies of one vector: ties
    rows |= {i: (1, [0, 0, 0, 0]) for i in range(300, 305)} | {400: (1, [1, 2]), 401: (2, [1, 2]), 402: (1, [2, 3]), 403: (9, []), 404: (9, []), 405: (8, [])}
    given = [(i, l, v, "x", 1) for i, (l, v) in rows.items()]
    given += [(None, 1, [1] * 4, "", 1), (500, None, [1] * 4, "", 1), (501, 1, None, "", 1), (502, 1, [1, None, 1, 1], "", 1), given[7], (given[8][0], 9, [9] * 4, "", 1)]
    table = spark.createDataFrame(given, "vec_id long, label int, vector array<long>, score string, q int").repartition(5)
    asked = [i for i in rows if i % 6 == 0 or i > 399]
    anchors = spark.createDataFrame([(i,) for i in [*asked, *asked, 500, 502, 9999, None]], "vec_id long")
    got = mine(table, anchors).collect()
    assert sorted(map(tuple, got)) == brute(rows, asked)
    assert mine(table.limit(0), anchors).collect() == [] and mine(table, anchors.limit(0)).collect() == []


def test_scores_that_leave_64_bits(spark):
    big = 2**62
    rows = {0: (1, [big, big]), 1: (1, [big, 5]), 2: (2, [big, big]), 3: (2, [3, 1]), 4: (1, [-big, -big]), 5: (1, [1, 0]), 6: (2, [1, 0])}
    table = spark.createDataFrame([(i, l, v) for i, (l, v) in rows.items()], "vec_id long, label int, vector array<long>")
    assert sorted(map(tuple, mine(table, table).collect())) == brute(rows, rows)


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for scale in (10, 2**25, 2**40, 2**61):
        a, b = rng.integers(-scale, scale, (5, 6)), rng.integers(-scale, scale, (7, 6))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in b] for u in a]
        assert hard_negatives.products(a, b).tolist() == want


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query_against_sql(spark, folder):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet'")
    want = db.execute(SQL["op13_hard_negatives"]).fetchall()
    assert sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, folder).collect())) == sorted(want) and want


def test_odd_components_take_no_part(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.5, -0.001 * i], i % 2) for i in range(0, 300, 10)] + [(1, [nan, 1.0], 0), (2, [inf, 1.0], 0), (3, [None, 1.0], 1), (4, None, 1), (5, [0.5, 0.1], None), (None, [0.5, 0.1], 1), (14, [0.5, 0.5], 9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()
    clean = {i: ((l + 1) % 10 if i % 7 == 0 else l, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, l in rows[:30] + rows[-1:]}
    assert sorted(map(tuple, got)) == brute(clean, [i for i in clean if i % 100 == 0])
