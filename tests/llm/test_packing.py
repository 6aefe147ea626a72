import random
import string
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from offerloom.llm import packing
from offerloom.llm.packing import pack, plan
from offerloom.llm.queries import tokenizer_file
from offerloom.llm.words import word_hashes

PATH = tokenizer_file("word_bpe_49k.json")


def check_plan(histogram, capacity):
    ranges, bins = plan(histogram, capacity)
    used = defaultdict(list)
    given = defaultdict(list)
    for length, rank, count, first, each, offset in ranges:
        for k in range(count):
            used[first + k // each].append((offset + (k % each) * length, length))
            given[length].append(rank + k)
    assert {n: sorted(r) for n, r in given.items()} == {n: list(range(c)) for n, c in histogram.items() if c}
    assert sorted(used) == list(range(bins))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            i = min(fits, key=lambda i: gaps[i])
            gaps[i] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_exact_and_as_good_as_best_fit(seed):
    rng = random.Random(seed)
    capacity = 100
    shape = [lambda: rng.randint(1, 100), lambda: rng.randint(34, 100), lambda: rng.randint(1, 33), lambda: int(rng.expovariate(0.05)) % 100 + 1, lambda: rng.choice([50, 100, 7]), lambda: rng.choice([34, 35, 66, 1])][seed]
    lengths = [shape() for _ in range(500)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    assert check_plan(histogram, capacity) <= best_fit(lengths, capacity)
    assert check_plan({}, capacity) == 0 and check_plan({100: 3}, capacity) == 3 and check_plan({1: 250}, capacity) == 3


def test_pieces_equal_whole_text_encoding(spark):
    texts = ["", None, " \n", "Hello, World! it's 42", "É é ́x y z\x1cq 　 ﬀ ΣΑΣ İ", "<|endoftext|> a<|startoftext|>b", "word " * 9000, "don't\tstop\x0bnow\x85then", "퟿ \U0001f600x", "日本 語"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "no id", 2)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(3), PATH).collect()
    coder = Tokenizer.from_file(PATH)
    expected = []
    for doc, text, _ in rows:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected.append((doc, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(expected, key=str)
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(spans) <= best_fit([e[3] for e in expected], 4096)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_words_with_punctuation_and_odd_letters():
    rng = random.Random(4)
    coder, ours = Tokenizer.from_file(PATH), packing.Coder(PATH)
    pieces = ["Word", "don't", "e.g", "'s", ".", ",,", "!?", "(", "É", "İ", "ß", "ΣΑΣ", "ǅ", "ⅷ", "日本", "한", "ʰ", "12", "_", "'", "-", "́", "\x1c", "\x85", "<|endoftext|>", "K"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 4))) + rng.choice([" ", "\n", ""]) for _ in range(4000)]
    texts = ["".join(texts[i : i + rng.randint(0, 9)]) for i in range(0, 4000, 9)]
    for _ in range(2):  # learned, then remembered
        data, ends = ours.texts(pa.array([t.encode() for t in texts], pa.binary()), 1)
        ids = np.frombuffer(data, "<u4").tolist()
        low = 0
        for text, high in zip(texts, (ends // 4).tolist()):
            assert ids[low:high] == coder.encode(text, add_special_tokens=False).ids + [1], text
            low = high


def test_texts_are_tokenized_two_megabytes_at_once(monkeypatch):
    met = []

    class Recorder:
        def texts(self, texts, end_id):
            met.append(sum(len(t) for t in texts.to_pylist()))
            return np.full(len(texts), end_id, "<u4").tobytes(), 4 * (np.arange(len(texts)) + 1)

    monkeypatch.setitem(packing._coders, "recorder", Recorder())
    run, _ = packing._tokenized("recorder", 4096, 1)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(60), pa.int64()), pa.array([b"a" * 100_000] * 60, pa.binary())], names=["doc_id", "text"])
    assert sum(part.num_rows for part in run([batch])) == 60
    assert max(met) <= 2_000_000 and sum(met) == 6_000_000


def test_latin_words_and_punctuation_after_them():
    """What the pattern takes is what letter rules say, for any bytes, in linear time."""
    rng, marks = random.Random(6), string.punctuation.encode()
    pieces = [chr(c).encode() for c in range(33, 0x260)] + [b"\xc3", b"\x80", b"\xff", "日".encode(), b"a", b"e", b"."] * 40
    for _ in range(20_000):
        word = b"".join(rng.choices(pieces, k=rng.randint(1, 5)))
        core = word.rstrip(marks)
        letters = core.decode("utf-8", "replace")
        latin = letters.isalpha() and max(letters) < "\u0250" and letters.lower().isalpha()
        match = packing.LATIN.fullmatch(word)
        assert (match.groups() if match else None) == ((core, word[len(core) :]) if latin else None)
    assert packing.LATIN.fullmatch("aé".encode() * 200_000 + b"1") is None


def test_words_met_are_kept_in_bounds_without_python_objects(monkeypatch):
    """Words that went, or share a hash, are coded again; what is kept costs tens of bytes a word."""
    rng, coder = random.Random(9), Tokenizer.from_file(PATH)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 4))) + rng.choice(["", ",", "日"]) for _ in range(300)) for _ in range(12)]
    monkeypatch.setattr(packing, "CACHE_WORDS", 200)
    plain = packing.word_hashes
    for hashes in (plain, lambda words: plain(words) % np.uint64(50)):
        monkeypatch.setattr(packing, "word_hashes", hashes)
        ours = packing.Coder(PATH)
        for text in texts + texts:
            data, ends = ours.texts(pa.array([b"", text.encode()], pa.binary()), 1)
            assert np.frombuffer(data, "<u4").tolist() == [1, *coder.encode(text, add_special_tokens=False).ids, 1]
            assert ends.tolist() == [4, len(data)]
            assert len(ours.words) == len(ours.known) == len(ours.met) == len(ours.hashes) == len(ours.places) <= 200
            assert (np.diff(ours.hashes.astype(object)) > 0).all()
    monkeypatch.undo()
    ours = packing.Coder(PATH)
    ours.texts(pa.array([" ".join(f"{a}{b}{c}" for a in "abcdefghij" for b in string.ascii_lowercase for c in string.ascii_lowercase).encode()], pa.binary()), 1)
    held = sum(x.nbytes for x in (ours.words, ours.known, ours.met, ours.hashes, ours.places))
    assert 6760 <= len(ours.words) <= 6761 and held < 64 * 6760  # nothing is a word too


def test_words_met_are_not_copied_for_each_group_of_texts(monkeypatch):
    coder = packing.Coder(PATH)
    met = pa.array([f"{i}x{i}" for i in range(50_000)])
    coder.learn(met, pa.array([b"\1\0\0\0" * 50] * len(met), pa.large_binary()), word_hashes(met))
    texts = pa.array([b"7x7 8x8, 9x9 some words", b"", b"7x7"])
    coder.texts(texts, 1)  # from here on all words are met
    joined, join = [], pa.concat_arrays

    def recorded(arrays):
        joined.append(join(arrays))
        return joined[-1]

    monkeypatch.setattr(pa, "concat_arrays", recorded)
    data, ends = coder.texts(texts, 1)
    assert sum(len(x) for x in joined) < 100
    assert bytes(data[ends[1] :]) == b"\1\0\0\0" * 51 and ends[1] - ends[0] == 4
