import random
import re
from types import SimpleNamespace

import pyarrow as pa

from offerloom.llm import decontaminate
from offerloom.llm.decontaminate import leaks, tile


def brute_tiles(a, b, shortest=5):
    """Greedy string tiling as published: find all longest unmarked matches, mark them, again."""
    used_a, used_b, total = [False] * len(a), [False] * len(b), 0
    while True:
        best, found = shortest, []
        for j in range(len(b)):
            for i in range(len(a)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        if not found:
            return total
        for i, j in found:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = [True] * best
                used_b[j : j + best] = [True] * best
                total += best


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, coverage=0.8):
    out = []
    for doc, text in docs:
        for item, passage in items:
            a, b = split(text), split(passage)
            if len(b) >= 5:
                n = brute_tiles(a, b)
                if n >= coverage * len(b):
                    out.append((doc, item, n, len(b)))
    return sorted(out, key=str)


def test_same_as_published_tiling(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(150)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 8, 20, 30])))) for i in range(12)] + [(50, None), (51, ""), (None, "q r s t u v"), (52, "x x x x x x x x")]
    docs = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice([0, 2, 40]))
        if i % 2:
            p = items[rng.randrange(12)][1].split()
            cut = rng.randrange(len(p) + 1)
            words += rng.choice([p, p[cut:] + ["z"] + p[:cut], p[: int(len(p) * 0.7)], [w.upper() + "," for w in p]]) + rng.choices(vocabulary, k=5)
        docs.append((i, rng.choice([" ", "\n", ", "]).join(words)))
    docs += [(70, None), (71, ""), (72, "x " * 30), (None, "Q, R; s (t) U v!"), docs[1], docs[1]]
    got = leaks(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([(r.doc_id, r.item_id, r.matched_words, r.item_words) for r in got.collect()], key=str) == brute(docs, items)


def test_reordered_halves_count_in_full():
    assert sorted(tile([(6, 0, 10), (10, 6, 0)], 5)) == [(6, 0, 10), (10, 6, 0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert leaks(none, items).collect() == [] and leaks(some, items).collect() == []
    assert leaks(none, some.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_texts_are_folded_a_megabyte_at_once(monkeypatch):
    shared = SimpleNamespace(value=decontaminate._seed_table([(7, "a b c d e f")], 5))
    met, fold = [], decontaminate.fold

    def recorded(column):
        met.append(sum(len(t or "") for t in column.to_pylist()))
        return fold(column)

    monkeypatch.setattr(decontaminate, "fold", recorded)
    run, _ = decontaminate._tested(shared, 5, 0.8)
    texts = [None if i == 3 else "x " * 50_000 + ("A, b C d é e" if i == 4 else "A, b C d; e F" if i % 10 == 0 else "") for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    assert [i for part in run([batch]) for i in part.column(0).to_pylist()] == [0, 10, 20, 30, 40, 50]
    assert max(met) <= 1_200_000 and sum(met) == sum(len(t or "") for t in texts)


def test_slices_fold_like_whole_columns():
    texts = ["Ab,c", None, "", "ÉÀ×ÿ ß!", "x" * 9, "日本 Z."]
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        column = pa.array([t and (t.encode() if kind == pa.binary() else t) for t in texts], kind)
        whole = decontaminate.fold(column).to_pylist()
        assert whole == [(t or "").encode() for t in ["ab c", "", "", "éà×ÿ ß ", "x" * 9, "日本 z "]]
        for first in range(6):
            for stop in range(first, 7):
                assert decontaminate.fold(column[first:stop]).to_pylist() == whole[first:stop]
