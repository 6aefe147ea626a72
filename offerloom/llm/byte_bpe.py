"""Byte-level BPE by longest matches and backtracking.

A word (one match of the splitting pattern) is read from left to right. An
Aho-Corasick automaton over all tokens, their bytes mapped to Latin-1, tells the
longest token at a byte. A token may follow another only if merging their
joined bytes would give back just these two. Where the longest token may not
follow, its longest prefix that is a token is tried, then the next; which of
them may depends on two tokens alone and is remembered. Where none may, the
token before is taken back. Positions that turned out to lead nowhere are marked and never
tried again, so the time is linear in the word. The only row of tokens whose
neighbours all agree is the one that merging by rank ends with.

Documents are coded in their own tasks. A worker keeps what it needs of the
vocabulary and the ids of common words for all its tasks.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_BYTES = 2_000_000  # text coded at once; a longer text is a group of its own
CACHE_WORDS = 250_000  # words met lately that a worker keeps the ids of; it keeps as many from before
CACHE_CHARS = 64  # longer words are coded each time
CACHE_PAIRS = 500_000  # token pairs a worker remembers what may follow of

_coders: dict[tuple[str, str], Coder] = {}


def ranks_of(path: str) -> dict[bytes, int]:
    """Bytes and ids of a rank file: base64 of the token, white space, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Bpe:
    """Exact merging by rank of `ranks`, whose single bytes are all tokens; ids are the ranks.

    Every token must be what merging its own bytes ends with, by tokens of lower rank, as in any
    trained vocabulary. Others raise a ValueError: there, neighbours alone do not decide.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.prefix: dict[int, int | None] = {}  # the longest shorter token that a token starts with
        self.parts: dict[int, tuple[int, int] | None] = {}  # the two tokens it is merged from, None: a byte
        self.merged: dict[tuple[int, int], int] = {}
        self.steps: dict[tuple[int, int], int | None] = {}
        self.matcher = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.prefix[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), None)
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if not self._learn(token, rank):
                raise ValueError(f"token {rank} is not merged from tokens of lower rank")
            self.matcher.add_word(token.decode("latin-1"), rank)
        self.matcher.make_automaton()

    def _learn(self, token: bytes, rank: int) -> bool:
        """Notes what a token is merged from; False: no merging ever ends with it."""
        if len(token) == 1:
            self.parts[rank] = None
            return True
        left = self.prefix[rank]
        while left is not None:
            right = self.ranks.get(token[self.length[left] :])
            if right is not None and left < rank and right < rank and left in self.parts and right in self.parts and self._agree(left, right):
                self.parts[rank] = (left, right)
                self.merged[left, right] = rank
                return True
            left = self.prefix[left]
        return False

    def _agree(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens ends with these two.

        Undoes the later merge of the two sides step by step: if the tokens that then touch have a
        merge that comes before the one just undone, it would have come first.
        """
        undone = None
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and (undone is None or joined < undone):
                return False
            # of equal merges the left one comes first, so the right side is undone before it
            first, second = (self.parts[left], self.parts[right])
            if first is not None and (second is None or left > right):
                undone, left = left, first[1]
            elif second is not None:
                undone, right = right + 1, second[0]
            else:
                return True

    def step(self, left: int, token: int) -> int | None:
        """The longest token that may follow `left`: `token` or a prefix of it."""
        if len(self.steps) >= CACHE_PAIRS:
            self.steps.clear()
        found: int | None = token
        while found is not None and not self._agree(left, found):
            found = self.prefix[found]
        self.steps[left, token] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        text = word.decode("latin-1")
        length, prefix, steps, longest_from = self.length, self.prefix, self.steps, self.matcher.iter_long
        closed: set[int] = set()  # places from which no row of tokens reaches the end
        out: list[int] = []
        at = 0
        while at < len(word):
            for end, longest in longest_from(text, at):
                token: int | None = longest
                while True:
                    if out and token is not None:
                        pair = out[-1], token
                        token = steps[pair] if pair in steps else self.step(*pair)
                    if token is None:  # nothing may stand here: another end for the token before
                        closed.add(at)
                        token = out.pop()
                        at -= length[token]
                        token = prefix[token]
                    elif at + length[token] in closed:
                        token = prefix[token]
                    else:
                        break
                out.append(token)
                at += length[token]
                if at != end + 1:  # the longest matches go on from another place
                    break
        return out


class Coder:
    """Texts to ids and back, with what a worker keeps between tasks."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = ranks_of(path)
        self.bpe = Bpe(ranks)
        self.words = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        by_id = sorted(ranks.items(), key=lambda item: item[1])
        self.ids = np.array([rank for _, rank in by_id], np.int64)
        self.bytes = np.frombuffer(b"".join(token for token, _ in by_id), np.uint8)
        self.cuts = np.concatenate(([0], np.cumsum([len(token) for token, _ in by_id])))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        words = self.words.findall(text)
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        cache, long = self.cache, []
        for word in set(words).difference(cache):
            cache[word] = self.older.get(word) or array("i", self.bpe.encode(word.encode("utf-8", "replace"))).tobytes()
            if len(word) > CACHE_CHARS:
                long.append(word)
        coded = b"".join(map(cache.__getitem__, words))
        for word in long:
            del cache[word]
        return coded

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the rows ids[bounds[i]:bounds[i + 1]], and where each row's begin and end."""
        place = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        sizes = np.where(self.ids[place] == ids, self.cuts[place + 1] - self.cuts[place], 0)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        source = np.repeat(self.cuts[place] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.bytes[source], ends[bounds]


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def groups(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes reach about `limit` together."""
    first = total = stop = 0
    for stop, size in enumerate(sizes, 1):
        total += size
        if total >= limit:
            yield first, stop
            first, total = stop, 0
    if first < stop:
        yield first, stop


def _encoded(path: str, pattern: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            ids, texts = batch.columns
            for first, stop in groups((max(1, s.as_buffer().size) if s.is_valid else 1 for s in texts), GROUP_BYTES):
                coded = [own.encode(s.as_buffer().to_pybytes().decode("utf-8", "replace")) if s.is_valid else b"" for s in texts[first:stop]]
                cuts = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded])))
                column = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([ids[first:stop], column], schema=schema)

    return run


def _decoded(path: str, pattern: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("data", pa.large_binary())])

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            lists = batch.column(1)
            cuts = lists.offsets.to_numpy()
            for first, stop in groups(np.diff(cuts) + 1, GROUP_BYTES // 4):
                part = lists.values.slice(cuts[first], cuts[stop] - cuts[first]).fill_null(-1)
                data, bounds = own.decode(part.to_numpy(zero_copy_only=False), cuts[first : stop + 1] - cuts[first])
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), stop - first, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:stop], lists[first:stop], column], schema=schema)

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Ids of docs(doc_id, text, ...): a row (doc_id, ids) for each row.

    Each match of `pattern` is merged by the ranks of the file at `path`, which every executor has;
    special tokens are plain text. A null or empty text has no ids, rows that repeat or have no
    doc_id are coded like others, bytes that are not UTF-8 count as U+FFFD. Other columns are not
    looked at. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_encoded(path, pattern), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """coded(doc_id, ids, ...) with the bytes that the ids stand for: (doc_id, ids, data).

    Null ids, and ids that the file does not have, stand for nothing; a null list is an empty one.
    """
    none = F.array().cast("array<int>")
    rows = coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("ids").cast("array<int>"), none).alias("ids"))
    return rows.mapInArrow(_decoded(path, pattern), "doc_id long, ids array<int>, data binary")
