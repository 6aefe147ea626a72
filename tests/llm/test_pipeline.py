import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from offerloom.llm import credentials, toxicity  # noqa: E402
from offerloom.llm.shared import stash  # noqa: E402
from test_credentials import brute  # noqa: E402
from test_decontaminate import brute as brute_leaks  # noqa: E402
from test_ngram_jaccard import brute as brute_groups  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def masked(text):
    out, at = [], 0
    for start, _, end in brute(text)[0]:
        if start >= at:
            out += [text[at:start], credentials.MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "secret_scan", "packing"]
    toxic, groups, leaks, secrets, packing = (f for _, f in corpus_pipeline.STAGES)

    before = docs.collect()
    kept = stash(toxic(spark, docs, FOLDER))
    model = toxicity.fitted(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 0").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == want

    before = kept.collect()
    kept = stash(groups(spark, kept, FOLDER))
    want = {d for d, _, c in brute_groups([(r.doc_id, r.text) for r in before], 5, 80) if d == c}
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)

    before = kept.collect()
    kept = stash(leaks(spark, kept, FOLDER))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    seeds = [set(zip(*[iter_words(t)[k:] for k in range(5)])) for _, t in items]
    near = [r for r in before if any(s & set(zip(*[iter_words(r.text)[k:] for k in range(5)])) for s in seeds)]
    bad = {d for d, *_ in brute_leaks([(r.doc_id, r.text) for r in near], items)}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in before} - bad

    before = {r.doc_id: r for r in kept.collect()}
    kept = stash(secrets(spark, kept, FOLDER))
    after = kept.collect()
    assert kept.columns == columns and len(after) == len(before)
    for r in after:
        assert r.text == masked(before[r.doc_id].text) and r.n_chars == len(r.text)

    packed = packing(spark, kept, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(before)
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096


def iter_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_run_is_the_chain_of_stages_and_keeps_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "token = abcdefabcdef1234 tail", "en", "s", 30), (None, "no id here", None, None, None), (3, "token = abcdefabcdef1234 tail", "en", "s", 30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.piece) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_near_duplicates_with_clashing_names(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(i, t, "a", 1, 2, 3, 4) for i, t in [(1, text), (2, text), (2, text), (3, "another text that is short"), (None, "no id")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string, kept_version int, version int, rows int, component_id int")
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.kept_id, r.version, r.rows) for r in kept.collect()) == [(0, "a", 2, 3), (1, "a", 2, 3), (3, "a", 2, 3)]
