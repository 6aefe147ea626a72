import random
import re

import pytest

from offerloom.llm.substring_dedup import substring_dedup


def brute(rows, window=20):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), ws in zip(rows, tokens):
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            place = (-1 if doc is None else doc, i)
            first[key] = min(place, first.get(key, place))
    out = []
    for (doc, _), ws in zip(rows, tokens):
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < (-1 if doc is None else doc, i):
                gone.update(range(i, i + window))
        out.append((doc, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=str)


def found(docs):
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substring_dedup(docs).collect()), key=str)


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3 if seed == 3 else 300)]
    passages = [rng.choices(vocabulary, k=rng.choice([19, 20, 21, 25, 60, 90])) for _ in range(8)]
    rows = []
    for i in range(120):
        ws = []
        for _ in range(rng.choice([0, 1, 3, 6])):
            ws += rng.choices(vocabulary, k=rng.choice([0, 5, 30])) + (rng.choice(passages) if rng.random() < 0.6 else [])
        rows.append((rng.randrange(100) if i > 100 else i, rng.choice([" ", "\n", "\t "]).join(ws)))
    rows += rows[:5] + [(200, "a " * 100), (201, "b a " * 60), (202, None), (203, " \n"), (None, rows[3][1]), (204, "É é " * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_brute_force(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, seed int").repartition(3)
    assert found(docs) == brute(rows)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
