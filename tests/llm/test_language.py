import math
import random

import numpy as np

from offerloom.llm import language
from offerloom.llm.language import Model, fold, identify, suffix_automaton


def test_automaton_reads_exactly_the_substrings():
    text = "abracadabra abba"
    step = suffix_automaton(text)

    def reads(s):
        state = 0
        for c in s:
            state = step[state].get(c)
            if state is None:
                return False
        return True

    held = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    rng = random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choices("abcdr ", k=rng.randint(0, 6)))
        assert reads(s) == (s in held)


def brute_pieces(text, reference):
    total = 0
    for at in range(0, len(text), language.BLOCK):
        block, i = text[at : at + language.BLOCK], 0
        while i < len(block):
            n = 1
            while i + n < len(block) and block[i : i + n + 1] in reference and block[i] in reference:
                n += 1
            total += 1
            i += n
    return total


def test_cost_equals_longest_match_parsing(spark):
    refs = {"x": "the cat sat on the mat and the rat ran", "y": "le chat est sur la table et le rat court", "z": "zzz"}
    texts = ["The cat ran; THE RAT!", "le rat", "zz top é", "qqq", "a", "the " * 400 + "chat", "Le chat est où ?"]
    model = Model(refs)
    table = model.code_points()
    for text in texts:
        codes = next(language._coded([text], table))
        folded = fold(text)
        assert len(codes) == len(folded)
        parts = [codes[i : i + language.BLOCK] for i in range(0, len(codes), language.BLOCK)]
        lengths = np.array([len(p) for p in parts])
        blocks = np.zeros((language.BLOCK, len(parts)), np.uint8)
        for j, p in enumerate(parts):
            blocks[: len(p), j] = p
        got = model.pieces(blocks, lengths).sum(axis=1).tolist()
        assert got == [brute_pieces(folded, refs[name]) for name in model.languages]
    assert math.isclose(model.bits[0], math.log2(len(refs["x"])))


def test_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "12 + 3", None), (None, "the thing and the", None), (-4, "日本語", "en"), (-1, None, "en")], "doc_id long, text string, lang string")
    got = identify(docs.select("doc_id", "text", "lang").union(odd), docs.filter("doc_id % 2 = 0")).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    real = [r for r in got if r.doc_id is not None and r.doc_id >= 0 and r.doc_id % 2]
    assert sum(r.lang_pred == truth[r.doc_id] for r in real) >= 0.99 * len(real)
    assert len(got) == docs.count() + 6
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (-1, -2, -3))
    assert [r.lang_pred for r in got if r.doc_id is None] == ["en"]
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    some = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert identify(none, none).collect() == []
    assert [tuple(r) for r in identify(some, some).collect()] == [(1, "und", 0.0)]


def test_copies_neither_hide_a_language_nor_fill_its_reference(spark):
    few = [("yy", f"distinct{'abcdefghijklmnopqrst'[i]}") for i in range(20)]
    hot = spark.range(60_000).selectExpr("'yy' lang", "'copied passage' text")
    many = spark.range(60_000).selectExpr("'zz' lang", "concat('word', translate(cast(id % 2000 as string), '0123456789', 'abcdefghij')) text")
    rows = spark.createDataFrame(few, "lang string, text string").union(hot).union(many)
    found = language.references(rows)
    assert sorted(found["yy"].split()) == sorted([t for _, t in few] + ["copied", "passage"])
    assert len(found["zz"].split()) == len(set(found["zz"].split())) == language.SAMPLED
