"""Toxicity by a subsequence string-kernel support vector machine on Nyström landmarks.

Kernel: two words share every triple of letters that stands in both, in order
and with gaps; a triple counts less the wider it is spread (at most SPAN
letters). Inserted or replaced characters therefore weaken a match instead of
breaking it. Characters other than letters are skipped inside a word, and runs
of single letters are read as one word.

Labelled texts are bags of words (multiple instances): a toxic text has at
least one toxic word, a clean one none. Words that mark toxic texts beyond
chance are the positive instances, also with single letters inserted, and the
most diverse of them the landmarks; kernel values against these, times the
inverse root of the landmarks' own kernel matrix, are the features of a linear
machine. Words of clean texts that come out too high join the negative
instances and the landmarks, and the machine is fitted again. A text scores as
its highest word, as a probability fitted on the sample.

A fitted machine is one weight for each triple, so scoring needs no landmarks:
a word costs a few dozen table lookups, whatever their number.
"""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.shared import tidy

SAMPLED = 2000  # labelled texts of each label at most
COPY = 0.7  # of the words of two texts in common: one is a near copy
LANDMARKS = 96
NEGATIVES = 5000  # words of clean texts in the first fit
NOISY = 80  # telling words that also train with letters inserted
SPAN = 7  # letters that a triple may reach over
DECAY = 0.7
LONGEST = 24  # letters; longer words are read in halfway overlapping windows
CACHE = 150_000  # distinct words a worker keeps the scores of
TEXT_CHARS = 1_000_000  # text scored at once; a longer text is scored alone
AT_ONCE = 20_000  # words

_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def letters(word: str) -> bytes:
    """Letters of a word as classes: a-z are 1 to 26, others share 27 to 31."""
    return bytes(o - 96 if 97 <= (o := ord(c)) <= 122 else 27 + o % 5 for c in word.lower() if c.isalpha())


def instances(text: str | None) -> set[str]:
    """Distinct words of a text, and its runs of four or more single letters joined."""
    tokens = (text or "").split()
    found = set(tokens)
    if sum(len(t) == 1 for t in found) > 2:
        for single, run in groupby(tokens, lambda t: len(t) == 1 and t.isalpha()):
            if single and len(joined := "".join(run)) > 3:
                found.add(joined)
    return found


def triples(words: list[bytes]):
    """(word, triple, weight) of all words, each triple of a word once, ordered by word."""
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    size = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # letters to the word's end
    keys, weights = [], []
    for a, b in _PAIRS:
        at = np.flatnonzero(left > b)
        keys.append((owner[at] << 15) | (flat[at] << 10) | (flat[at + a] << 5) | flat[at + b])
        weights.append(np.full(len(at), DECAY ** (b - 2)))
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    total = np.add.reduceat(weights, first) if len(first) else weights
    return keys[first] >> 15, keys[first] & 0x7FFF, total


class Landmarks:
    """Kernel values against fixed words, normalised so that equal words have 1."""

    def __init__(self, coded: list[bytes]):
        owner, triple, weight = triples(coded)
        norm = np.sqrt(np.bincount(owner, weight**2, len(coded)))
        present = np.unique(triple)
        self.count = len(coded)
        self.place = np.full(1 << 15, -1, np.int32)
        self.place[present] = np.arange(len(present))
        self.rows = np.zeros((len(present), len(coded)), np.float32)
        self.rows[self.place[triple], owner] = weight / np.maximum(norm[owner], 1e-12)

    def kernel(self, coded: list[bytes]) -> np.ndarray:
        out = np.zeros((len(coded), self.count), np.float32)
        owner, triple, weight = triples(coded)
        norm = np.sqrt(np.bincount(owner, weight**2, len(coded)))
        place = self.place[triple]
        hit = place >= 0
        owner, place, weight = owner[hit], place[hit], (weight[hit] / norm[owner[hit]]).astype(np.float32)
        if len(owner):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            for lo in range(0, len(first), 4096):  # bounded work space
                some = first[lo : lo + 4096]
                end = first[lo + 4096] if lo + 4096 < len(first) else len(owner)
                parts = self.rows[place[some[0] : end]] * weight[some[0] : end, None]
                out[owner[some]] = np.add.reduceat(parts, some - some[0], axis=0)
        return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])

    def loss(w):
        return (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + (penalty * w * w).sum()

    for _ in range(12):
        live = y * (x @ w) < 1
        a, c = x[live], weight[live]
        gradient = penalty * w - a.T @ (c * (y[live] - a @ w))
        step = np.linalg.solve((a * c[:, None]).T @ a + np.diag(penalty), gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def fit_sigmoid(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | f), slope positive, with smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([f, np.ones_like(f)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


class Model:
    """Scores words and texts by weights of triples; `floor` is what a word without any telling triple gets."""

    def __init__(self, weights: np.ndarray, floor: float):
        self.weights, self.floor = weights, floor
        self.slope, self.offset = 1.0, 0.0

    def coded(self, words: list[bytes]) -> np.ndarray:
        """floor + the normalised triples times their weights, at least floor; some words at once."""
        parts = [self._coded(words[lo : lo + AT_ONCE]) for lo in range(0, len(words), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _coded(self, words: list[bytes]) -> np.ndarray:
        out = np.full(len(words), self.floor)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
        owner = np.repeat(np.arange(len(words)), size)
        total = np.zeros(len(words))
        for a, b in _PAIRS:
            at = np.flatnonzero(left > b)
            value = self.weights[(flat[at] << 10) | (flat[at + a] << 5) | flat[at + b]]
            total += np.bincount(owner[at], value * DECAY ** (b - 2), len(words))
        above = np.flatnonzero(total > 0)  # the rest cannot come above floor
        if len(above):
            owned, _, weight = triples([words[i] for i in above.tolist()])
            out[above] += total[above] / np.sqrt(np.bincount(owned, weight**2, len(above)))
        return out

    def words(self, words: list[str]) -> np.ndarray:
        pieces, owner = [], []
        for i, word in enumerate(words):
            coded = letters(word)
            pieces.append(coded[:LONGEST])
            owner.append(i)
            for at in range(LONGEST // 2, len(coded) - LONGEST // 2, LONGEST // 2):
                pieces.append(coded[at : at + LONGEST])
                owner.append(i)
        out = np.full(len(words), self.floor)
        np.maximum.at(out, np.array(owner, np.int64), self.coded(pieces))
        return out

    def probability(self, f):
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(f) + self.offset, -30, 30)))


def telling_words(bags: list[set[bytes]], y: np.ndarray) -> dict[bytes, float]:
    """Words more frequent in toxic texts than chance over all words explains, by log-likelihood ratio."""
    counts: dict[bytes, list[int]] = {}
    for bag, label in zip(bags, y.tolist(), strict=True):
        for word in bag:
            counts.setdefault(word, [0, 0])[label] += 1
    share = float(y.mean())
    found = {}
    for word, (clean, bad) in counts.items():
        rate = bad / (bad + clean)
        if bad > 1 and rate > (1 + share) / 2:
            ratio = 2 * (bad * np.log(rate / share) + (clean * np.log((1 - rate) / (1 - share)) if clean else 0))
            found[word] = float(ratio)
    sure = {w: r for w, r in found.items() if r > 2 * np.log(len(counts))}
    return sure or dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:10])


def without_copies(bags: list[set[bytes]], toxic: list[int]) -> list[int]:
    """Places of bags that are not near copies of earlier kept ones: same label and at least COPY of the words in common.

    Copies carry one judgement many times, which would make all their words look
    telling. Four sketches of two least word hashes propose earlier bags; only
    the words themselves decide.
    """
    place = {w: i for i, w in enumerate(sorted(set().union(*bags)))}
    base = np.array([zlib.crc32(w) for w in place], np.uint64)
    hashes = [((base + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)) >> np.uint64(20) for seed in range(4)]
    seen: dict[tuple, list[int]] = {}
    kept = []
    for i, bag in enumerate(bags):
        own = np.fromiter((place[w] for w in bag), np.int64, len(bag))
        keys = [(toxic[i], seed, *np.sort(h[own])[:2].tolist()) for seed, h in enumerate(hashes)]
        if not any(_near(bag, bags[j]) for j in dict.fromkeys(j for key in keys for j in seen.get(key, ()))):
            kept.append(i)
            for key in keys:
                seen.setdefault(key, []).append(i)
    return kept


def _near(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity of two word sets is COPY or more; two empty ones are equal."""
    less, more = sorted((len(a), len(b)))
    if less < COPY * more:
        return False
    both = len(a & b)
    return both >= COPY * (less + more - both)


def train(texts: list[str], toxic: list[int]) -> Model:
    """Model of labelled texts; one that finds nothing toxic if either label is missing."""
    y = np.array(toxic, int)
    coded_words: dict[str, bytes] = {}
    bags = []
    for text in texts:
        words = instances(text)
        coded_words.update((w, letters(w)[:LONGEST]) for w in words.difference(coded_words))
        bags.append({coded_words[w] for w in words})
    del coded_words
    kept = without_copies(bags, toxic)
    bags, y = [bags[i] for i in kept], y[kept]
    toxic = y.tolist()
    telling = telling_words([{w for w in b if len(w) > 2} for b in bags], y) if 0 < y.sum() < len(y) else {}
    if not telling:
        model = Model(np.zeros(1 << 15), -1.0)
        model.slope, model.offset = 1.0, -2.0
        return model

    ranked = sorted(telling, key=lambda w: (-telling[w], w))[: 10 * LANDMARKS]
    between = Landmarks(ranked).kernel(ranked)
    chosen: list[int] = []
    for i in range(len(ranked)):
        if len(chosen) < LANDMARKS * 2 // 3 and (not chosen or between[i, chosen].max() < 0.9):
            chosen.append(i)
    marks = [ranked[i] for i in chosen]
    noisy = [w[:k] + bytes([c]) + w[k:] for w in ranked[:NOISY] for k in range(1, len(w)) for c in {w[k], 1 + (7 * k + len(w)) % 26}]
    positive = ranked + noisy
    times = np.array([telling[w] for w in ranked])
    weight_up = np.concatenate((times / times.sum(), np.full(len(noisy), 0.3 / max(1, len(noisy)))))

    clean = sorted({w for bag, label in zip(bags, toxic, strict=True) if not label for w in bag if len(w) > 2})
    rng = np.random.default_rng(5)
    negative = set(rng.permutation(len(clean))[:NEGATIVES].tolist())
    for turn in range(4):
        kernel = Landmarks(marks)
        own = kernel.kernel(marks).astype(np.float64)
        value, vector = np.linalg.eigh((own + own.T) / 2)
        root = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
        down = sorted(negative)
        rows = np.concatenate((kernel.kernel(positive + [clean[i] for i in down]), np.zeros((1, len(marks))))) @ root
        sign = np.concatenate((np.ones(len(positive)), -np.ones(len(down) + 1)))
        weight = np.concatenate((weight_up, np.full(len(down) + 1, 3 / (len(down) + 1))))
        w = fit_svm(rows, sign, weight * 10_000, ridge=0.1)
        weights = np.zeros(1 << 15)
        present = kernel.place >= 0
        weights[present] = kernel.rows[kernel.place[present]] @ (root @ w[:-1])
        model = Model(weights, float(w[-1]))
        if turn == 3:
            break
        f = model.coded(clean)
        worst = np.argsort(-f, kind="stable")[:1500]
        worst = worst[f[worst] > -0.7].tolist()
        negative.update(worst)
        marks += [clean[i] for i in worst if f[i] > -0.3 and clean[i] not in marks][: LANDMARKS // 9]
    coded = sorted(set().union(*bags))
    scores = dict(zip(coded, model.coded(coded).tolist(), strict=True))
    top = np.array([max(map(scores.__getitem__, bag), default=model.floor) for bag in bags])
    model.slope, model.offset = fit_sigmoid(top, y)
    return model


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, whole text) of up to SAMPLED documents of each label, the ones with the least hashes of their ids."""
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = dict(marked.groupBy("toxic").count().collect())
    share = F.create_map(*[F.lit(x) for t in (0, 1) for x in (t, min(1.0, 4.0 * SAMPLED / counts.get(t, 1)))])
    some = marked.withColumn("key", F.xxhash64("doc_id", F.lit(11))).filter(F.pmod("key", F.lit(1_000_000)) < share[F.col("toxic")] * 1_000_000)
    order = Window.partitionBy("toxic").orderBy("key", "doc_id")
    some = some.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLED).select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Model of the sampled labelled documents, trained in one task on the bounded sample; the driver gets its weights."""
    schema = pa.schema([("weights", pa.binary()), ("floor", pa.float64()), ("slope", pa.float64()), ("offset", pa.float64())])

    def run(batches):
        rows = sorted((r["doc_id"], r["toxic"], r["text"] or "") for batch in batches for r in batch.to_pylist())
        model = train([text for _, _, text in rows], [toxic for _, toxic, _ in rows])
        values = [model.weights.tobytes(), model.floor, model.slope, model.offset]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)

    rows = sample(docs, labels).coalesce(1).mapInArrow(tidy(run), "weights binary, floor double, slope double, offset double").collect()
    if not rows:
        return train([], [])
    model = Model(np.frombuffer(bytes(rows[0]["weights"])), rows[0]["floor"])
    model.slope, model.offset = rows[0]["slope"], rows[0]["offset"]
    return model


def _texts_scored(model: Model, cache: dict[str, float], column: pa.Array) -> np.ndarray:
    """Scores of a text column; words seen before come from the cache."""
    top: list[float] = []
    bags: list[set[str]] = []
    size = 0

    def settle():
        if len(cache) > CACHE:
            cache.clear()
        new = list(set().union(*bags).difference(cache))
        cache.update(zip(new, model.words(new).tolist(), strict=True))
        top.extend(max(map(cache.__getitem__, bag), default=model.floor) for bag in bags)
        bags.clear()

    for text in column:
        value = text.as_py()
        bags.append(instances(value))
        size += len(value or "")
        if size > TEXT_CHARS:
            settle()
            size = 0
    settle()
    return model.probability(np.maximum(top, model.floor)) if top else np.zeros(0)


def _scored(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            score = _texts_scored(shared.value, cache, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=schema)

    return tidy(run), "doc_id long, score double, predicted int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, score (0 to 1), predicted (1 from 0.5 on).

    Texts are read whole. A null, empty or wordless text scores as one without
    any toxic word. Repeated rows and null ids keep their rows; other columns
    are not looked at. An empty table gives an empty result.
    """
    run, schema = _scored(docs.sparkSession.sparkContext.broadcast(model))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs(text, ...), all columns, that score below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            yield batch.filter(pa.array(_texts_scored(shared.value, cache, batch.column(place)) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
