"""Best-fit packing of token sequences with matching of large items.

Only how many pieces have each length decides how full the sequences get, and
there are at most `capacity` lengths. So the driver plans on that histogram
(4,096 numbers, however many documents) and writes the plan as ranges: "pieces
of length l with ranks a to b go to sequences s, s + 1, ... at offset o".
Pieces learn their rank within their length from a count over bounded groups
and look their range up; no task sees all pieces of a length.

The plan: pieces above a third of the capacity pair at most twice per bin, each
with the largest partner that fits, largest first. Smaller pieces, largest
first, then fill the smallest remaining gap that holds them; what fits nowhere
opens new bins.
"""

from __future__ import annotations

import bisect
import os
import re
import string
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.shared import stash, tidy
from offerloom.llm.words import word_hashes

CACHE_WORDS = 500_000  # words that a worker keeps the ids of; the half not met for longest goes when there are more
GROUP_BYTES = 1_000_000  # text tokenized at once; a longer text is a group of its own
CODED = 4_000  # words coded at once; the tokenizer makes about a kilobyte of each
RANKED = 50_000  # about as many pieces of one length are ranked in one group


_LETTERS = [c for c in map(chr, range(0x80, 0x250)) if c.isalpha() and c.lower().isalpha()]  # Latin ones that stay letters (a mark would go with the punctuation)


def _latin() -> re.Pattern[bytes]:
    """A word of Latin letters, and punctuation after them."""
    letters = [c.encode() for c in _LETTERS]
    wide = [re.escape(lead) + b"[%s]" % b"".join(re.escape(x[1:]) for x in letters if x[:1] == lead) for lead in sorted({x[:1] for x in letters})]
    return re.compile(b"((?:[A-Za-z]++|%s)++)([%s]*)" % (b"|".join(wide), re.escape(string.punctuation.encode())))


LATIN = _latin()
_CLASS = f"[A-Za-z{''.join(_LETTERS)}]+"
PARTS = f"^(?P<core>{_CLASS})(?P<rest>[{re.escape(string.punctuation)}]*)$"  # LATIN for Arrow
_coders: dict[str, Coder] = {}  # a worker keeps them, with the words it has met, for all its tasks


def _latin_parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Letters of Latin words and the punctuation after them; other words stay whole."""
    found = pc.extract_regex(words, PARTS)
    return pc.coalesce(pc.struct_field(found, "core"), words), pc.fill_null(pc.struct_field(found, "rest"), "")


class Coder:
    """Ids of words, little-endian 32 bits each, remembered.

    For a tokenizer that has small letters only, parts letters from punctuation and marks the last
    token of a word: A-Z are lowered beforehand, punctuation after letters is coded apart, and words
    of letters are coded many in a row, each up to a token that ends a word.

    The words met are Arrow arrays, found by a hash and then compared, so that a word costs some fifty
    bytes and no Python object.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        normal, parted, mark = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.lowers = normal is not None and normal.normalize_str(string.ascii_uppercase) == string.ascii_lowercase
        self.parts = bool(self.lowers and mark and parted is not None and [p for p, _ in parted.pre_tokenize_str("ab" + string.punctuation)] == ["ab", string.punctuation])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if mark and token.endswith(mark)]] = True
        self.words, self.known = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.met, self.turn = np.zeros(0, np.int64), 0  # the turn in which each word was met last
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending hashes, and whose they are

    def coded(self, words: pa.Array) -> pa.Array:
        texts = [w.decode("utf-8", "replace") for w in words.cast(pa.binary()).to_pylist()]
        return pa.array([array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], pa.large_binary())

    def in_a_row(self, words: pa.Array) -> pa.Array:
        """Ids of words of letters."""
        coded = self.tokenizer.encode_fast if hasattr(self.tokenizer, "encode_fast") else self.tokenizer.encode
        ids = np.array(coded(" ".join(words.to_pylist()), add_special_tokens=False).ids, "<u4")
        stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(stops) != len(words):  # a letter that becomes more than a letter
            return self.coded(words)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.concatenate(([0], stops))), pa.py_buffer(ids)])

    def find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Places of words among those met, -1 for others."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        place = np.where(self.hashes[at] == hashes, self.places[at], -1)
        hit = np.flatnonzero(place >= 0)
        same = pc.equal(self.words.take(pa.array(place[hit])), words.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        place[hit[~same.astype(bool)]] = -1
        self.met[place[hit[same.astype(bool)]]] = self.turn
        return place

    def learn(self, words: pa.Array, ids: pa.Array, hashes: np.ndarray) -> None:
        """Remembers distinct new words; of words with the same hash, the first."""
        hashes, first = np.unique(hashes, return_index=True)
        at = np.searchsorted(self.hashes, hashes)
        if len(self.hashes):
            other = self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes
            hashes, first, at = hashes[other], first[other], at[other]
        if not len(first):
            return
        self.places = np.insert(self.places, at, len(self.words) + np.arange(len(first)))
        self.hashes = np.insert(self.hashes, at, hashes)
        self.words = pa.concat_arrays([self.words, words.take(pa.array(first))])
        self.known = pa.concat_arrays([self.known, ids.take(pa.array(first))])
        self.met = np.append(self.met, np.full(len(first), self.turn))
        if len(self.words) > CACHE_WORDS:
            kept = np.sort(np.argsort(-self.met, kind="stable")[: CACHE_WORDS // 2])
            moved = np.full(len(self.words), -1)
            moved[kept] = np.arange(len(kept))
            self.words, self.known, self.met = self.words.take(pa.array(kept)), self.known.take(pa.array(kept)), self.met[kept]
            places = moved[self.places]
            self.hashes, self.places = self.hashes[places >= 0], places[places >= 0]

    def pieces(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words of letters alone, of punctuation, or of any kind."""
        place = np.arange(len(words))
        latin = pc.match_substring_regex(words, f"^{_CLASS}$").to_numpy(zero_copy_only=False).astype(bool) if self.parts else np.zeros(len(words), bool)
        found = []
        for code, which, at_once in ((self.in_a_row, place[latin], 2_000), (self.coded, place[~latin], CODED)):
            some = words.take(pa.array(which))
            found += [code(some.slice(i, at_once)) for i in range(0, len(some), at_once)]
        back = np.argsort(np.concatenate((place[latin], place[~latin])), kind="stable")
        return pa.concat_arrays(found).take(pa.array(back)) if found else pa.array([], pa.large_binary())

    def new(self, words: pa.Array, hashes: np.ndarray) -> pa.Array:
        """Ids of distinct words that were not met, which are remembered."""
        if not self.parts:
            ids = self.pieces(words)
            self.learn(words, ids, hashes)
            return ids
        core, rest = _latin_parts(words)
        parts = pa.concat_arrays([core, rest]).dictionary_encode()
        index, parts = parts.indices.to_numpy(), parts.dictionary
        own = word_hashes(parts)
        place = self.find(parts, own)
        met, unmet = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        coded = self.pieces(parts.take(pa.array(unmet)))
        whole = pa.concat_arrays([self.known.take(pa.array(place[met])), coded])  # of these parts alone: what is known is large
        place[np.concatenate((met, unmet))] = np.arange(len(place))
        ids = pc.binary_join_element_wise(*(whole.take(pa.array(place[half])) for half in np.split(index, 2)), pa.scalar(b"", pa.large_binary()))
        joined = np.flatnonzero(pc.binary_length(rest).to_numpy())  # the others are parts themselves
        self.learn(
            pa.concat_arrays([parts.take(pa.array(unmet)), words.take(pa.array(joined))]),
            pa.concat_arrays([coded, ids.take(pa.array(joined))]), np.concatenate((own[unmet], hashes[joined])))
        return ids

    def texts(self, texts: pa.Array, end_id: int) -> tuple[memoryview, np.ndarray]:
        """Ids of texts (binary, no nulls) with an end id after each, and the byte after each.

        The tokenizer never joins what white space parts, so ids of a text are those of its words in a row.
        """
        texts = texts.cast(pa.string(), safe=False)
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.lowers else texts)
        counts = pc.list_value_length(split).to_numpy()
        words = split.flatten().dictionary_encode()
        index, words = words.indices.to_numpy(), words.dictionary
        self.turn += 1
        hashes = word_hashes(words)
        slot = self.find(words, hashes)
        met, unmet = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
        known = self.known.take(pa.array(slot[met]))  # before more words are met
        new = self.new(words.take(pa.array(unmet)), hashes[unmet])
        slot[np.concatenate((met, unmet))] = np.arange(len(slot))
        ids = pa.concat_arrays([known, new, pa.array([array("I", [end_id]).tobytes()], pa.large_binary())])
        row = np.arange(len(counts))
        last = np.cumsum(counts) + row  # place of each text's end among words and ends
        place = np.full(len(index) + len(counts), len(ids) - 1)
        place[np.arange(len(index)) + np.repeat(row, counts)] = slot[index]
        out = ids.take(pa.array(place))
        _, offsets, data = out.buffers()
        ends = np.frombuffer(offsets, np.int64)[out.offset : out.offset + len(out) + 1]
        return memoryview(data)[int(ends[0]) : int(ends[-1])], ends[1:][last] - ends[0]


def _tokenized(path: str, capacity: int, end_id: int):
    """(doc_id, text) -> a row for each piece."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        if path not in _coders:
            _coders[path] = Coder(path)
        for batch in batches:
            texts = batch.column(1).fill_null(b"")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy())
            first = 0
            while first < len(texts):
                before = sizes[first - 1] if first else 0
                stop = max(first + 1, int(np.searchsorted(sizes, before + GROUP_BYTES, "right")))
                data, ends = _coders[path].texts(texts.slice(first, stop - first), end_id)
                view, low = memoryview(data), 0
                out: list[tuple] = []
                for doc_id, high in zip(batch.column(0)[first:stop].to_pylist(), ends.tolist(), strict=True):
                    for piece, at in enumerate(range(low, high, 4 * capacity)):
                        part = view[at : min(high, at + 4 * capacity)]
                        out.append((doc_id, piece, (at - low) // 4, len(part) // 4, zlib.crc32(part)))
                    low = high
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                first = stop

    return tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Ranges (length, first rank, ranks, first sequence, pieces in a row of one sequence, offset), and the sequences used."""
    left = {n: c for n, c in histogram.items() if c}
    used: dict[int, int] = {}  # length -> ranks given away
    ranges, bins = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of (first sequence, sequences)
    sizes: list[int] = []  # gaps that exist, ascending

    def place(length, count, first, each, offset):
        ranges.append((length, used.get(length, 0), count, first, each, offset))
        used[length] = used.get(length, 0) + count
        left[length] -= count

    def leave(gap, first, count):
        if gap and count:
            if gap not in gaps:
                bisect.insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        length = large[-1]
        partner = bisect.bisect_right(large, capacity - length) - 1
        if partner < 0 or (large[partner] == length and left[length] == 1 and partner == 0):
            count, other = left[length], 0
        elif large[partner] == length and left[length] == 1:
            other = large[partner - 1]
            count = 1
        else:
            other = large[partner]
            count = left[length] // 2 if other == length else min(left[length], left[other])
        place(length, count, bins, 1, 0)
        if other:
            place(other, count, bins, 1, length)
        leave(capacity - length - other, bins, count)
        bins += count
        large = [n for n in large if left[n]]

    for length in sorted((n for n in left if left[n]), reverse=True):
        while left[length]:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                each = capacity // length
                opened = -(-left[length] // each)
                leave(capacity, bins, opened)
                bins += opened
                continue
            gap = sizes[at]
            first, count = gaps[gap].pop()
            each = gap // length
            full = min(count, left[length] // each)
            if full:
                place(length, full * each, first, each, capacity - gap)
                leave(gap - each * length, first, full)
            if full < count and left[length] and left[length] < each:
                rest = left[length]
                place(length, rest, first + full, rest, capacity - gap)
                leave(gap - rest * length, first + full, 1)
                full += 1
            if full < count:
                gaps[gap].append((first + full, count - full))
            if not gaps[gap]:
                del gaps[gap]
                sizes.remove(gap)
    return ranges, bins


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of docs(doc_id, text, ...) in sequences of at most `capacity` tokens.

    A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A null or empty text is the end token alone. Longer documents are cut every
    `capacity` tokens. Rows that repeat, or repeat a doc_id, or have none, are
    documents of their own. Pieces that agree in all columns may trade places.
    Other columns are not looked at. An empty table gives an empty result.
    `tokenizer` is a file that every executor has.
    """
    spark = docs.sparkSession
    run, schema = _tokenized(tokenizer, capacity, end_id)
    pieces = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema))
    histogram = dict(pieces.groupBy("length").count().collect())  # at most `capacity` rows
    ranges, _ = plan(histogram, capacity)
    # at most about a dozen ranges a length: each use of a gap at least halves it
    found = spark.createDataFrame(ranges or [(0, 0, 0, 0, 1, 0)], "length long, rank0 long, ranks long, sequence0 long, each long, offset0 long")
    salts = spark.createDataFrame([(n, -(-c // RANKED)) for n, c in histogram.items()] or [(0, 1)], "length long, groups long")

    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.expr("pmod(xxhash64(doc_id, piece, ids_crc32), groups)")).drop("groups")
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("rank0"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(starts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("rank0")).drop("rank0", "salt")
    placed = ranked.join(F.broadcast(found), "length").filter("rank >= rank0 and rank < rank0 + ranks")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("sequence0 + (rank - rank0) div each").alias("sequence_id"),
        F.expr("offset0 + ((rank - rank0) % each) * length").alias("offset"),
    )
