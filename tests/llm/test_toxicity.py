import itertools
import random
import zlib

import numpy as np

from offerloom.llm import toxicity
from offerloom.llm.toxicity import Landmarks, fitted, instances, letters, score, train


def brute_features(word):
    out = {}
    for i, j, k in itertools.combinations(range(len(word)), 3):
        if k - i < toxicity.SPAN:
            key = word[i], word[j], word[k]
            out[key] = out.get(key, 0.0) + toxicity.DECAY ** (k - i - 2)
    return out


def test_kernel_is_the_gapped_subsequence_kernel():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcde", k=rng.randint(0, 12))) for _ in range(40)]
    marks = [w for w in words if len(w) > 3][:7]
    got = Landmarks([letters(w) for w in marks]).kernel([letters(w) for w in words])
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            a, b = brute_features(letters(w)), brute_features(letters(m))
            dot = sum(x * b.get(key, 0) for key, x in a.items())
            norm = (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
            assert abs(got[i, j] - (dot / norm if norm else 0)) < 1e-5


def made(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "be", "ti", "on", "er", "ou", "st", "ha", "re"]
    insults = ["villain", "scoundrel", "blockhead"]
    rows = []
    for _ in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.4
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(insults)
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_machine_weights_equal_kernel_expansion_and_gaps_are_tolerated():
    rows = made(600, 1)
    model = train([t for t, _ in rows], [y for _, y in rows])
    fresh = made(400, 2)
    f = [model.probability(max(model.words(sorted(instances(t))), default=model.floor)) for t, _ in fresh]
    assert np.mean([(p >= 0.5) == y for p, (_, y) in zip(f, fresh)]) > 0.97
    variants = ["v-i-l-l-a-i-n", "vil.lain", "villxain", "scoundrrel", "blockkhead", "SCOUNDREL"]
    assert (model.probability(model.words(variants)) >= 0.5).all()
    assert "villain" in instances("you v i l l a i n !")
    words = ["anbeti", "villain", "onerou", "x" * 30, "", "123"]
    for w, got in zip(words, model.words(words)):
        key = letters(w)[: toxicity.LONGEST]
        features = brute_features(key)
        norm = sum(x * x for x in features.values()) ** 0.5
        total = sum(x * model.weights[(a << 10) | (b << 5) | c] for (a, b, c), x in features.items())
        assert abs(got - (model.floor + max(0.0, total) / (norm or 1))) < 1e-6


def test_held_out_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learn = labels.filter("pmod(crc32(cast(doc_id as string)), 5) <> 0")
    model = fitted(docs, learn)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "!!! 12"), (None, "an idiot"), (-4, "x" * 3000), (-1, None)], "doc_id long, text string")
    got = score(docs.select("doc_id", "text").union(odd), model).collect()
    assert len(got) == docs.count() + 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (-1, -2, -3))
    truth = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    held = [r for r in got if r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, "text of words"), (1, "text of words")], "doc_id long, text string")
    model = fitted(none, labels)
    assert score(none, model).collect() == []
    assert [r.predicted for r in score(some, fitted(some, labels)).collect()] == [0, 0]


def test_only_near_copies_of_one_label_are_left_out():
    rng = random.Random(6)
    everyday = [bytes([1 + i // 26, 1 + i % 26, 3]) for i in range(120)]
    apart = [set(rng.choices(everyday[:8], k=6)) | set(rng.sample(everyday[8:], 20)) for _ in range(300)]
    labels = [i % 2 for i in range(300)]
    share = max(len(a & b) / len(a | b) for a, b in itertools.combinations(apart, 2))
    assert share < toxicity.COPY
    assert toxicity.without_copies(apart, labels) == list(range(300))
    near = [bag | {bytes([30, 30, 1 + i % 26])} for i, bag in enumerate(apart)]
    kept = toxicity.without_copies(apart + near, labels + labels)
    assert kept[:300] == list(range(300)) and len(kept) < 330
    assert len(toxicity.without_copies([apart[0]] * 50, [0, 1] * 25)) == 2
    assert toxicity.without_copies([set(), set(), apart[0]], [0, 0, 0]) == [0, 2]


def test_words_late_in_a_long_sampled_text_are_learned(spark):
    digits = str.maketrans("0123456789", "bcdfghjklm")
    quiet = " ".join(f"{a}{b}ening" for a in "bcdfghjklm" for b in "aeiou") + " "
    own = [" ".join(f"w{i}x{chr(97 + k)}" for k in range(26)) for i in range(60)]
    texts = [(i, f"{quiet * 40} {'villain' if i % 2 else 'friend'} {own[i].translate(digits)}") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")
    model = fitted(docs, labels)
    assert model.probability(model.words(["villain"])[0]) >= 0.5 > model.probability(model.words(["friend"])[0])


def test_repeated_labels_do_not_fill_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(50)]
    key = min(range(0, 50, 2))
    labels = spark.createDataFrame(rows + [(key, 0)] * 9000, "doc_id long, toxic int")
    got = toxicity.sample(docs, labels).collect()
    assert sorted((r.doc_id, r.toxic) for r in got) == sorted(rows)


def test_text_is_scored_one_megabyte_at_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from offerloom.llm import toxicity

    met = []
    model = toxicity.Model(np.zeros(1 << 15), -1.0)
    monkeypatch.setattr(model, "words", lambda words: met.append(len(words)) or np.zeros(len(words)))
    texts = [" ".join(f"{i}x{k}" for k in range(10_000)) for i in range(40)]
    assert len(toxicity._texts_scored(model, {}, pa.array(texts))) == 40
    assert sum(met) == 400_000 and max(met) <= 200_000
