import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from offerloom.llm import byte_bpe
from offerloom.llm.queries import QUERIES, tokenizer_file

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def both(request):
    path = tokenizer_file(request.param)
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks_of(path), special_tokens={})
    return byte_bpe.Bpe(byte_bpe.ranks_of(path)), theirs


def test_words_equal_merging_by_rank(both):
    ours, theirs = both
    rng = random.Random(5)
    tokens = list(ours.ranks)
    for i in range(6000):
        letters = ["ab", "aeinst", "abcdefghijklmnopqrstuvwxyzéñ日本"][i % 3]
        word = "".join(rng.choices(letters, k=rng.randint(1, 40))).encode()
        word = word if i % 2 else b"".join(rng.choices(tokens, k=rng.randint(1, 6)))
        assert ours.encode(word) == theirs._encode_single_piece(word)
    assert ours.encode(b"") == []
    for word in (b"a" * 30_000, b" " * 30_000, rng.randbytes(20_000)):
        assert ours.encode(word) == theirs._encode_single_piece(word)


def merged(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(40))
def test_small_vocabularies_with_ties(seed):
    rng = random.Random(seed)
    ranks = {b"a": 0, b"b": 1, b"c": 2}
    while len(ranks) < 14:
        a = rng.choice(sorted(ranks))
        b = a if rng.random() < 0.3 else rng.choice(sorted(ranks))
        if a + b not in ranks and len(merged(a + b, ranks)) == 2:
            ranks[a + b] = len(ranks)
    ours = byte_bpe.Bpe(ranks)
    for _ in range(300):
        word = bytes(rng.choices(b"abc", k=rng.randint(1, 14)))
        assert ours.encode(word) == merged(word, ranks)


def test_vocabulary_whose_tokens_do_not_arise():
    with pytest.raises(ValueError, match="token 4"):
        byte_bpe.Bpe({b"a": 0, b"b": 1, b"ab": 2, b"ba": 3, b"baba": 4})


def test_texts_and_odd_rows(spark):
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks_of(path), special_tokens={})
    texts = [None, "", " ", "\n\n  x", "don't  stop\t\x1c\x85\xa0now", "<|endoftext|>", "日本語 한국어 \U0001f600é", "x" * 9000, "word 12345 " * 9000, "a\x00b\r\n"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = [(i, t, [i], "x") for i, t in enumerate(texts)] + [(3, texts[3], None, None), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, data string").repartition(3)
    coded = byte_bpe.encode(docs, path, PATTERN)
    back = byte_bpe.decode(coded, path, PATTERN).collect()
    want = [(i, theirs.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows]
    assert sorted(((r.doc_id, r.ids, bytes(r.data)) for r in back), key=str) == sorted(want, key=str)
    assert byte_bpe.encode(docs.limit(0), path, PATTERN).collect() == []
    odd = byte_bpe.decode(spark.createDataFrame([(1, None), (2, [None, 70000, -5, 0])], "doc_id long, ids array<int>"), path, PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.data)) for r in odd) == [(1, b""), (2, theirs.decode_bytes([0]))]


def test_query_against_the_library(spark):
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks_of(tokenizer_file("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    folder = "/root/testdata/sf0.01"
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = theirs.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op11_byte_bpe"](spark, folder).collect())) == sorted(want)


def test_only_longest_matches_are_read(both):
    """A word costs its longest matches from where tokens begin, not all tokens that end at each byte."""
    ours, theirs = both
    read, matcher = [], ours.matcher

    class Counted:
        def iter_long(self, text, start=0):
            for found in matcher.iter_long(text, start):
                read.append(found)
                yield found

    ours.matcher = Counted()
    try:
        rng = random.Random(8)
        words = ["".join(rng.choices(["th", "on", "ing", "er", "ti", "ea", "an", "ou"], k=5)).encode() for _ in range(2000)]
        coded = [ours.encode(w) for w in words]
    finally:
        ours.matcher = matcher
    assert coded == [theirs._encode_single_piece(w) for w in words]
    assert len(read) < 4 * sum(map(len, coded))
