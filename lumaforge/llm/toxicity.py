"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word's vector is the mean of the vectors of its hashed character n-grams, so a misspelling that was never seen
shares most of them with the word it stands for. A window is the sum of its different words over its length, so that a repeated word is no more than one, and
a linear softmax over that mean gives its probability. A document is as toxic as its worst window, so that one insult in a long
text is not averaged away. Training knows only whole documents' labels: it starts with every window under its
document's label, then keeps, for toxic documents, the windows it finds worst, and for clean ones those that it
gets most wrong, along with random ones.

Training weighs both labels alike, and the share of toxic ones among all labelled training documents then sets the bias; labels
whose document is missing or null count for nothing.
The classifier is fitted in one task on at most ``TRAIN_ROWS`` labelled documents of each label, and of ``TRAIN_BYTES`` altogether:
those that come first by a hash of their key. Since the output
is linear in the mean, a word adds one number, which scoring looks up.

A text that is null or without words scores as an empty window: the share of toxic documents that a text without
evidence has. Repeated rows score alike; a document labelled twice is toxic if either label says so; null labels
teach nothing. Without labelled rows of both kinds every score of a worded text is next to 0 (below 1e-20). An empty table gives an
empty result. Texts are used whole, very long ones too; one that alone exceeds the bytes of its label's sample teaches nothing.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaforge.llm.tables import stored

#: Labelled documents of each label used for fitting, at most.
TRAIN_ROWS = 3_000
#: Bytes of their texts, at most; half of them for each label.
TRAIN_BYTES = 64 << 20
THRESHOLD = 0.7
BUCKETS = 1 << 16
DIM = 8
ORDERS = (3, 4, 5)
WINDOW = 8
WARM_EPOCHS, ROUNDS, ROUND_EPOCHS = 2, 5, 2
BATCH = 1024
#: Updates at least, in each round.
LEAST_STEPS = 60
RATE = 0.02
SEED = 20
#: Words whose number a worker keeps; a full table is emptied.
TABLE_SIZE = 500_000
LONGEST_KEPT = 64
#: Words or windows that fitting works on at once, outside its batches.
AT_ONCE = 20_000

_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_EDGES = ".,;:!?\"'()[]{}…«»„“”‘’"


def words_of(text: str | None) -> list[str]:
    return [w for w in _SPACES.split((text or "").lower()) if w]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For all words in a row: the word each n-gram belongs to, and the n-gram's cell. Words are not empty."""
    marked = [f"<{w.strip(_EDGES) or w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, marked), np.int64, len(words)))
    owners, cells = [], []
    rolling = np.zeros(len(codes), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        n = len(codes) - order + 1
        if n <= 0:
            break
        rolling = rolling[:n] * np.uint32(0x01000193) + codes[order - 1 :]
        if order in ORDERS:
            inside = owner[:n] == owner[order - 1 :]
            mixed = (rolling[inside] ^ np.uint32(order * 0x1F123BB5 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            owners.append(owner[:n][inside])
            cells.append((mixed >> np.uint32(15)) & np.uint32(BUCKETS - 1))
    if not owners:
        return np.empty(0, np.int32), np.empty(0, np.uint32)
    owners, cells = np.concatenate(owners), np.concatenate(cells)
    order = np.argsort(owners, kind="stable")
    return owners[order], cells[order]


def window_starts(n_words: int) -> np.ndarray:
    """Starts of the windows; a short rest joins the window before it."""
    return np.arange(max(1, (n_words + WINDOW // 2) // WINDOW)) * WINDOW


def repeats(words: list, starts: np.ndarray) -> list[int]:
    """Places of words that their window had before."""
    ends = [*starts[1:].tolist(), len(words)]
    found = []
    for a, b in zip(starts.tolist(), ends):
        if len(set(words[a:b])) < b - a:
            seen = set()
            for i in range(a, b):
                if words[i] in seen:
                    found.append(i)
                seen.add(words[i])
    return found


@dataclass
class Model:
    """``weight`` has one number per n-gram cell: its embedding times the difference of the two output rows."""

    weight: np.ndarray
    bias: float
    empty: float

    def word_numbers(self, words: list[str]) -> np.ndarray:
        owner, cell = grams(words)
        total = np.bincount(owner, self.weight[cell], len(words))
        return total / np.maximum(np.bincount(owner, minlength=len(words)), 1)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.numbers: dict[str, float] = {}

    def score(self, texts: list[str | None]) -> list[float]:
        split = [words_of(t) for t in texts]
        lookup = self.numbers
        missing = list(set().union(*split).difference(lookup)) if split else []
        extra: dict[str, float] = {}
        for start in range(0, len(missing), 20_000):
            part = missing[start : start + 20_000]
            extra.update(zip(part, self.model.word_numbers(part).tolist()))
        if len(lookup) + len(extra) > TABLE_SIZE:
            needed = set().union(*split)
            kept = {w: lookup[w] for w in needed if w in lookup}
            lookup.clear()
            lookup.update(kept)
        lookup.update(extra)
        out = []
        for words in split:
            if not words:
                out.append(self.model.empty)
                continue
            starts = window_starts(len(words))
            values = np.fromiter(map(lookup.__getitem__, words), np.float64, len(words))
            values[repeats(words, starts)] = 0
            means = np.add.reduceat(values, starts) / np.diff(np.append(starts, len(words)))
            out.append(float(1 / (1 + np.exp(-(means.max() + self.model.bias)))))
        for word in [w for w in extra if len(w) > LONGEST_KEPT]:
            del lookup[word]
        return out


class _Adam:
    def __init__(self, *params: np.ndarray):
        self.params = params
        self.state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        self.steps = 0

    def step(self, *grads: np.ndarray) -> None:
        self.steps += 1
        scale = RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for p, (m, v), g in zip(self.params, self.state, grads):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= scale * m / (np.sqrt(v) + 1e-8)


def _cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where each word's n-grams start, and the cells of all, in portions, since sorting takes several times their memory."""
    counts, cells = [np.zeros(1, np.int64)], []
    for start in range(0, len(words), AT_ONCE):
        part = words[start : start + AT_ONCE]
        owner, cell = grams(part)
        counts.append(np.bincount(owner, minlength=len(part)))
        cells.append(cell.astype(np.uint16))
    return np.cumsum(np.concatenate(counts)), np.concatenate(cells)


def _means(weight: np.ndarray, cell: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean weight of each word's cells, in portions."""
    out = np.empty(len(bounds) - 1)
    for start in range(0, len(out), AT_ONCE):
        ends = bounds[start : start + AT_ONCE + 1]
        out[start : start + AT_ONCE] = np.add.reduceat(weight[cell[ends[0] : ends[-1]]], ends[:-1] - ends[0]) / np.diff(ends)
    return out


def fit(texts: list[str], labels: np.ndarray, share: float | None = None) -> Model:
    """Train embeddings and output layer together on whole documents' labels.

    Training weighs both labels alike; ``share``, the part of toxic documents to be expected, then moves the bias.
    """
    rng = np.random.default_rng(SEED)
    index: dict[str, int] = {}
    windows, owners, lengths = [], [], []
    for k, text in enumerate(texts):
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words_of(text)), np.int32)
        if not len(ids):
            continue
        starts = window_starts(len(ids))
        rows = np.full((len(starts), WINDOW + WINDOW // 2), -1, np.int32)
        lengths.append(np.diff(np.append(starts, len(ids))))
        ids[repeats(ids.tolist(), starts)] = -1
        for row, a, n in zip(rows, starts, lengths[-1]):
            row[:n] = ids[a : a + n]
        windows.append(rows)
        owners.append(np.full(len(rows), k, np.int32))
    labels = np.asarray(labels, np.int64)
    if not windows or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), -50.0, 0.0)
    windows, owner, lengths = np.concatenate(windows), np.concatenate(owners), np.concatenate(lengths)
    del owners
    toxic = labels[owner] == 1
    bounds, gram_cell = _cells(list(index))
    del index
    E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    U = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    c = np.zeros(2, np.float32)
    adam = _Adam(E, U, c)

    def train(rows: np.ndarray, truth: np.ndarray, weights: np.ndarray, epochs: int) -> None:
        """Whole epochs, and as many more as ``LEAST_STEPS`` need when there are few windows."""
        epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(rows)))
        order = np.concatenate([rng.permutation(len(rows)) for _ in range(epochs)])
        for start in range(0, len(order), BATCH):
            pick = order[start : start + BATCH]
            w, y, a = windows[rows[pick]], truth[pick], weights[pick].astype(np.float32)
            used, inverse = np.unique(w[w >= 0], return_inverse=True)
            row_of = np.nonzero(w >= 0)[0]
            size = lengths[rows[pick]].astype(np.float32)
            count = bounds[used + 1] - bounds[used]
            slot = np.repeat(np.arange(len(used), dtype=np.int32), count)
            at = np.arange(len(slot)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[used], count)
            cell = gram_cell[at]
            vectors = np.add.reduceat(E[cell], np.cumsum(count) - count) / count[:, None].astype(np.float32)
            first = np.searchsorted(row_of, np.arange(len(w)))
            h = np.add.reduceat(vectors[inverse], first) / size[:, None]
            z = h @ U + c
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= (a / a.sum())[:, None]
            dh = (p @ U.T) / size[:, None]
            flat = (inverse[:, None] * DIM + np.arange(DIM)).ravel()
            dv = np.bincount(flat, dh[row_of].ravel(), len(used) * DIM).reshape(-1, DIM) / count[:, None]
            dE = np.empty((BUCKETS, DIM), np.float32)
            for d in range(DIM):
                dE[:, d] = np.bincount(cell, dv[slot, d], BUCKETS)
            adam.step(dE, h.T @ p, p.sum(0))

    def model() -> Model:
        return Model((E @ (U[:, 1] - U[:, 0])).astype(np.float64), float(c[1] - c[0]), 0.0)

    everything = np.arange(len(windows))
    n_of = np.bincount(owner, minlength=len(texts))[owner]
    train(everything, toxic.astype(np.int64), 1 / n_of, WARM_EPOCHS)
    for _ in range(ROUNDS):
        now = model()
        numbers = _means(now.weight, gram_cell, bounds)
        padded = np.append(numbers, 0.0)
        z = np.concatenate([padded[windows[a : a + AT_ONCE]].sum(1) for a in range(0, len(windows), AT_ONCE)])
        z = z / lengths + now.bias
        order = np.lexsort((-z, owner))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(owner, owner)[order]
        chosen = np.where(toxic, (rank == 0) | (z > 0) & (rank < 4), (rank < 6) | (rng.random(len(z)) < 6 / n_of))
        rows = everything[chosen]
        truth = toxic[rows].astype(np.int64)
        sizes = np.bincount(truth, minlength=2)
        train(rows, truth, 1 / sizes[truth], ROUND_EPOCHS)
    out = model()
    expected = min(0.5, float(labels.mean()) if share is None else share)
    out.bias += float(np.log(expected / (1 - expected)))
    out.empty = expected
    return out


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", where: Column | None = None, key: str = "doc_id",
    text: str = "text", train_rows: int = TRAIN_ROWS,
) -> Model:
    """Fit on a sample of the labelled documents, at most ``train_rows`` of each label, chosen by a hash of the key."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    if where is not None:
        known = known.withColumnRenamed("key", key).where(where).withColumnRenamed(key, "key")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    known = stored(known.join(rows.select("key"), "key", "left_semi"), "labelled")
    share = known.agg(F.avg("label")).first()[0]
    sample = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(train_rows)
        sample = part if sample is None else sample.unionByName(part)
    # The sample has at most twice ``train_rows`` rows, first without its texts.
    sized = rows.select("key", F.octet_length("text").alias("size")).join(F.broadcast(sample), "key")
    sized = stored(sized.groupBy("key", "label").agg(F.max("size").alias("size")), "sized")
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, 0)
    fit_in = sized.withColumn("bytes", F.sum("size").over(so_far)).where(F.col("bytes") <= TRAIN_BYTES // 2).select("key", "label")
    chosen = rows.join(F.broadcast(fit_in), "key").groupBy("key", "label").agg(F.min("text").alias("text"))

    def run(batches):
        got = sorted(((k, v, t) for b in batches for k, v, t in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
        pa.default_memory_pool().release_unused()
        if got:
            fitted = fit([r[2] for r in got], np.array([r[1] for r in got]), share)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted)], pa.binary())], ["model"])

    found = chosen.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else Model(np.zeros(BUCKETS), -50.0, 0.0)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = scorer.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, with their columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = np.array(scorer.score(part.column(at).to_pylist()))
                yield part.filter(pa.array(found < threshold))

    return docs.mapInArrow(run, docs.schema)
