"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text holds every substring of
it. A document is parsed greedily into the longest pieces that the automaton
holds; the better the language fits, the fewer pieces it takes. Pieces times
the logarithm of the reference's length, over the characters read, estimates
the cross entropy in bits a character; the least one wins.

Greedy parsing needs the automata's transitions alone, so they become one
integer table, and a step of the parse is one table lookup for thousands of
text blocks and all languages at once. Texts are read whole, in blocks of 512
characters that are parsed apart: a piece ends at each block's end, for every
language alike.
"""

from __future__ import annotations

import math
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REFERENCE_CHARS = 40_000  # of labelled text for each language
ALL_REFERENCE_CHARS = 800_000  # of all languages together
SAMPLED = 300  # distinct labelled texts a language at most
LETTERS = 60  # the most frequent letters have classes of their own
BLOCK = 512
TOGETHER = 4096  # blocks parsed at once
UNKNOWN = "und"


def fold(text: str) -> str:
    """Lower case; every run of other than letters is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton that reads exactly the substrings of `text`, from state 0."""
    step: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


class Model:
    """languages, the class of each code point, and the joint transition table."""

    def __init__(self, references: dict[str, str]):
        self.languages = sorted(references)
        texts = [references[name] for name in self.languages]
        common = [c for c, _ in Counter("".join(texts)).most_common(LETTERS + 1) if c != " "][:LETTERS]
        self.classes = {c: i + 1 for i, c in enumerate(sorted(common))}  # 0: space
        self.other = len(self.classes) + 1  # every rarer letter
        self.width = self.other + 1
        tables, roots, base = [], [], 0
        for text in texts:
            step = suffix_automaton("".join(chr(self.classes.get(c, 0 if c == " " else self.other)) for c in text))
            table = np.full((len(step), self.width), -1, np.int32)
            for state, row in enumerate(step):
                for c, to in row.items():
                    table[state, ord(c)] = (base + to) * self.width
            tables.append(table.ravel())
            roots.append(base * self.width)
            base += len(step)
        tables.append(np.full(self.width, -1, np.int32))  # no way on: before the first letter, and after one that the language lacks
        self.dead = base * self.width
        self.table = np.concatenate(tables)
        self.roots = np.array(roots, np.int64)
        self.bits = np.array([math.log2(max(len(t), 2)) for t in texts])

    def code_points(self) -> np.ndarray:
        """Class of every code point: letters by their lower case, all else a space."""
        table = np.zeros(sys.maxunicode + 1, np.uint8)
        for o in range(128, sys.maxunicode + 1):
            if chr(o).isalpha():
                table[o] = self.other
        for o in list(range(65, 91)) + list(range(97, 123)):
            table[o] = self.other
        for c, k in self.classes.items():
            for o in {ord(c), *(ord(x) for x in (c.upper(), c.title()) if len(x) == 1)}:
                table[o] = k
        return table

    def pieces(self, blocks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Pieces (language, block) of blocks[step, block], longest block first."""
        count = np.zeros((len(self.roots), blocks.shape[1]), np.int64)
        if not blocks.size:
            return count
        start = self.table[self.roots[:, None] + np.arange(self.width)].astype(np.int64)  # where a piece that begins with a letter is
        start[start < 0] = self.dead
        state = np.full(count.shape, self.dead, np.int64)
        for i in range(int(lengths.max())):
            live = int(np.searchsorted(-lengths, -i, "left"))  # blocks longer than i
            c = blocks[i, :live]
            to = self.table[state[:, :live] + c].astype(np.int64)
            ends = to < 0
            count[:, :live] += ends
            state[:, :live] = np.where(ends, start[:, c], to)
        return count


def _coded(texts, table):
    """Classes of each text's characters: one space between words, none at the ends."""
    for text in texts:
        if not text:
            yield np.zeros(0, np.uint8)
            continue
        codes = table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        codes = codes[keep]
        yield codes[:-1] if len(codes) and codes[-1] == 0 else codes


def _predicted(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        model = shared.value
        table = model.code_points()

        def rows(ids, coded):
            owner = np.repeat(np.arange(len(coded)), [-(-len(x) // BLOCK) for x in coded])
            parts = [x[i : i + BLOCK] for x in coded for i in range(0, len(x), BLOCK)]
            lengths = np.array([len(p) for p in parts], np.int64)
            total = np.zeros((len(model.languages), len(coded)))
            order = np.argsort(-lengths, kind="stable")
            for i in range(0, len(parts), TOGETHER):
                some = order[i : i + TOGETHER]
                blocks = np.zeros((BLOCK, len(some)), np.uint8)
                for j, k in enumerate(some.tolist()):
                    blocks[: lengths[k], j] = parts[k]
                count = model.pieces(blocks, lengths[some])
                for n in range(len(total)):
                    total[n] += np.bincount(owner[some], count[n], len(coded))
            size = np.array([len(x) for x in coded])
            cost = total * model.bits[:, None] / np.maximum(size, 1)
            names, scores = [], []
            ranked = np.sort(cost, axis=0)
            for i, n in enumerate(size.tolist()):
                if not n or not model.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    names.append(model.languages[int(np.argmin(cost[:, i]))])
                    scores.append(1.0 if len(ranked) == 1 else float(1 - ranked[0, i] / ranked[1, i]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)

        for batch in batches:
            ids, coded, size = [], [], 0
            for doc_id, codes in zip(batch.column(0).to_pylist(), _coded((t.as_py() for t in batch.column(1)), table), strict=True):
                ids.append(doc_id)
                coded.append(codes)
                size += len(codes) + 100
                if size > BLOCK * TOGETHER:
                    yield rows(ids, coded)
                    ids, coded, size = [], [], 0
            if ids:
                yield rows(ids, coded)

    return run, "doc_id long, lang_pred string, score double"


def references(labelled: DataFrame) -> dict[str, str]:
    """Up to REFERENCE_CHARS folded characters for each lang of labelled(text, lang).

    A bounded sample: of each language SAMPLED distinct texts, the ones with the
    least hashes, each cut at REFERENCE_CHARS. Copies count once. Only hashes are
    counted and ranked; texts are read again for the places found.
    """
    rows = labelled.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text", F.lit(7)).alias("key"), "text")
    keys = rows.select("lang", "key").distinct()
    counts = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(ALL_REFERENCE_CHARS // 2000)
    share = counts.select("lang", (F.lit(4.0 * SAMPLED) / F.col("count")).alias("share"))
    some = keys.join(F.broadcast(share), "lang").filter("pmod(key, 1000000) < share * 1000000")
    order = Window.partitionBy("lang").orderBy("key")
    places = some.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLED).select("lang", "key", "place")
    text = F.min(F.substring("text", 1, REFERENCE_CHARS)).alias("text")
    found = defaultdict(list)
    for row in rows.join(F.broadcast(places), ["lang", "key"]).groupBy("lang", "place").agg(text).collect():
        found[row["lang"]].append((row["place"], row["text"]))
    limit = min(REFERENCE_CHARS, ALL_REFERENCE_CHARS // max(1, len(found)))
    texts = {lang: fold(" ".join(t for _, t in sorted(rows)))[:limit] for lang, rows in found.items()}
    return {lang: t for lang, t in texts.items() if t}


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, lang_pred, score (0 to 1: how far the runner-up is).

    Learned from labelled(text, lang). lang_pred is a learned language, the
    first in order on ties, or "und" with score 0 if the text is null or has no
    letter, or nothing was learned. Texts are read whole. Repeated rows and null
    ids keep their rows; other columns are not looked at.
    """
    model = Model(references(labelled))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run, schema = _predicted(shared)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
