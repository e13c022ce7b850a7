"""Language-model scores of whole documents: a gated recurrent network with a class-factored softmax, in numpy.

Tokens are words with A-Z in lower case, and one end per document. Counts of all training tokens give the
unigram base, the ``MODELED`` most frequent words, and the static part of the model. A word's probability is that of its
class times its own within the class: frequent words are dealt into classes of ``CLASS_WORDS`` by rank, with a
softmax over the network's state; every other word belongs to one of ``TAILS`` tail classes by its last two bytes, and
within it has ``(c + 1) / (N_t + V_t + 1)`` with the class's training tokens and distinct words, so that unknown words
share one place per tail class and all probabilities add up to one.

Texts are read twice: for the counts, and to write each document's tokens as numbers (two bytes each) beside its static part. Training
and scoring work on those.

Training is one pass over all training rows by truncated backpropagation: whole documents, many side by side, in
windows of ``STEPS`` tokens; the state is carried on from window to window, to the document's end, without its gradient. Where few
documents are left, several windows go before an update, so that no update has few tokens. Tasks of some ``TASK_TOKENS`` tokens train
from common weights, and the results are averaged by tokens, a bounded number at a time; there are ``SLICES`` such rounds, each with
a slice of the rows of its own, and together they take every row once. Scoring carries the state through the whole document, too.

Words outside the ``HEAD`` most frequent ones are looked up by a join, so no table that grows with the corpus is
broadcast.

Null texts are empty: their only token is the end. Repeated rows are scored alike and count as often as they occur. Very long
texts are one document like any other; a task holds the numbers of the documents it works on, ``WAITING_TOKENS`` or one more document
at most. An empty table gives an empty result.
Without training rows every word is unknown and has the only place there is, so scores are 0. Only the named columns
are read.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaforge.llm.tables import release, stored

#: Words that are looked up in memory, and those of them that the network tells apart.
HEAD = 1 << 18
MODELED = 4096
CLASS_WORDS = 64
TAILS = 16
STATE = 16
STEPS = 32
#: Documents side by side in training and in scoring, and those that wait for a place in training.
TRAIN_LANES, SCORE_LANES = 256, 1024
#: Tokens of the documents that wait for a place, or that are scored side by side, at most about.
WAITING_TOKENS = 1 << 22
#: Tokens of a step of training, at least: the windows of few documents are put together.
LEAST_TOKENS = 4096
#: Windows that are put together, at most.
MOST_WINDOWS = 64
#: Tokens that are scored at once, about.
SCORE_TOKENS = 1 << 14
#: Rows of the softmax over classes that are worked on at once.
AT_ONCE = 1024
#: Absolute weights up to which exponentials are safe in single precision, and the least probability that has a logarithm there.
SAFE_LOGIT, LEAST = 40.0, 1e-37
SLICES = 8
#: Training tokens of one task of a round, about. Each has its longest document to go through alone at its end.
TASK_TOKENS = 2_000_000
#: Weight vectors that are averaged in one task.
FAN_IN = 32
RATE = 0.01
SEED = 6
#: Distinct words a counting task holds before it hands them on, about.
HELD_WORDS = 500_000
#: Bytes of the texts that are cut into words at once, or one longer text.
PORTION_BYTES = 1 << 22
END = b""


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and end of stretches of a column that hold ``PORTION_BYTES``, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PORTION_BYTES, side="right")))
        yield start, stop
        start = stop


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, one after the other, and how many each has.

    Both functions know ASCII only and do not check UTF-8, as the definition asks.
    """
    texts = pc.fill_null(texts.cast(pa.binary()).view(pa.string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten().view(pa.binary())
    sizes = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full, min_count=0).as_py():  # what stands outside the space at a text's ends
        of = np.repeat(np.arange(len(sizes)), sizes)
        sizes = np.bincount(of[full.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        words = words.filter(full)
    return words, sizes


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


@functools.cache
def _tails() -> np.ndarray:
    """Tail class by the last two bytes of a word; then by its only one; then of the empty word."""
    ends = [bytes([a, b]) for a in range(256) for b in range(256)] + [bytes([b]) for b in range(256)] + [END]
    return np.array([tail_of(e) for e in ends], np.int32)


def tails_of(words: pa.Array) -> np.ndarray:
    """:func:`tail_of` of every word of a binary column without nulls."""
    if not len(words):
        return np.zeros(0, np.int32)
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    data = np.concatenate([np.zeros(2, np.uint8), data])  # so that there are two bytes before any end
    sizes, ends = np.diff(bounds), bounds[1:].astype(np.int64) + 2
    last = data[ends - 1].astype(np.int32)
    return _tails()[np.where(sizes > 1, data[ends - 2] * np.int32(256) + last, np.where(sizes > 0, (1 << 16) + last, (1 << 16) + 256))]


@dataclass
class Vocabulary:
    """Counts of the training tokens, as far as memory holds them."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    tail_tokens: np.ndarray
    tail_distinct: np.ndarray
    column: pa.Array = field(init=False, repr=False)

    def __post_init__(self):
        self.column = pa.array(self.words, pa.binary())
        self.end = self.words.index(END) if END in self.words else -1
        self.modeled = min(MODELED, len(self.words))
        self.classes = -(-self.modeled // CLASS_WORDS)
        # Class of each head word, and its place there; tail classes follow the others.
        k = np.arange(len(self.words))
        tails = tails_of(self.column.slice(self.modeled))
        self.class_of = np.concatenate([k[: self.modeled] // CLASS_WORDS, self.classes + tails]).astype(np.int32)
        self.log_count = np.log10(self.counts + 1.0)
        self.tail_scale = np.log10(self.tail_tokens + self.tail_distinct + 1.0)
        # Class and place by what the network sees.
        k, t = np.arange(self.modeled), np.arange(TAILS)
        self.cells = np.concatenate([np.column_stack([k // CLASS_WORDS, k % CLASS_WORDS]), np.column_stack([self.classes + t, 0 * t])]).astype(np.int32)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("words", "counts", "tokens", "distinct", "tail_tokens", "tail_distinct")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Head index (-1: not in the head) and class of each token of a document, the end included."""
        return self.look_up_all(pa.array(words, pa.binary()), np.array([len(words)]))

    def look_up_all(self, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for documents one after the other, of so many words each."""
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(words) + len(sizes), bool)
        inside[ends] = False
        at = np.full(len(inside), self.end, np.int32)
        found = pc.fill_null(pc.index_in(words, value_set=self.column), -1).to_numpy()
        at[inside] = found
        kind = self.class_of[at] if len(self.class_of) else np.zeros(len(at), np.int32)
        if self.end < 0:
            kind[ends] = self.classes + tail_of(END)
        missing = np.flatnonzero(found < 0)
        kind[np.flatnonzero(inside)[missing]] = self.classes + tails_of(words.take(pa.array(missing)))
        return at, kind

    def numbers(self, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """What the network sees of each token: a modeled word's index, or one for the tail class, in two bytes."""
        return np.where(kind < self.classes, at, self.modeled + kind - self.classes).astype(np.uint16)

    def rows(self, numbers: np.ndarray) -> np.ndarray:
        """Rows of input, class and place of a document's tokens, from their numbers; the input is the token before."""
        out = np.empty((len(numbers), 3), np.int32)
        out[0, 0], out[1:, 0] = self.modeled + TAILS, numbers[:-1]
        out[:, 1:] = self.cells[numbers]
        return out


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, tail, c`` of the tokens of texts; a word may come again once many are held."""
    held: list[pa.Table] = []

    def together() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

    def handed(counted: pa.Table):
        for batch in counted.combine_chunks().to_batches():
            word = batch.column(0)
            yield pa.RecordBatch.from_arrays([word, pa.array(tails_of(word)), batch.column(1)], ["word", "tail", "c"])

    for batch in batches:
        texts = batch.column(0)
        for start, stop in portions(texts):
            words, sizes = words_of(texts.slice(start, stop - start))
            found = words.value_counts()
            held.append(pa.table([found.field(0), found.field(1)], ["word", "c"]))
            held.append(pa.table([pa.array([END], pa.binary()), pa.array([len(sizes)], pa.int64())], ["word", "c"]))
            if sum(map(len, held)) > HELD_WORDS:
                held[:] = [together()]
                if len(held[0]) > HELD_WORDS // 2:
                    yield from handed(held.pop())
    if held:
        yield from handed(together())


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, tail, c`` of all tokens; the end is the empty word."""
    found = docs.select(F.col(text).alias("text")).mapInArrow(counted, "word binary, tail int, c long")
    return stored(found.groupBy("word", "tail").agg(F.sum("c").alias("c")), "words")


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    top = counts.orderBy(F.col("c").desc(), "word").limit(head).select("word", "c").toArrow()
    words = top.column("word").to_pylist()
    number = np.array(top.column("c").to_pylist(), np.int64)
    tokens, distinct = np.zeros(TAILS), np.zeros(TAILS)
    for tail, n, v in counts.groupBy("tail").agg(F.sum("c"), F.count("word")).collect():  # one row per tail class
        tokens[tail], distinct[tail] = n, v
    total = int(tokens.sum()), int(distinct.sum())
    for word, n in zip(words[:MODELED], number[:MODELED].tolist()):
        tokens[tail_of(word)] -= n
        distinct[tail_of(word)] -= 1
    return Vocabulary(words, number, *total, tokens, distinct)


class Network:
    """Gated recurrent units over word inputs, and the two softmaxes."""

    NAMES = ("X", "U", "C", "c", "W", "w")

    def __init__(self, vocab: Vocabulary):
        rng = np.random.default_rng(SEED)
        k, classes = vocab.modeled, vocab.classes
        self.classes = classes
        self.tokens = 0  # that it was trained on
        inputs = k + TAILS + 1  # the modeled words, a token per tail class, and the start
        self.X = rng.normal(0, 0.1, (inputs, 3 * STATE)).astype(np.float32)
        self.U = rng.normal(0, STATE**-0.5, (STATE, 3 * STATE)).astype(np.float32)
        self.C = np.zeros((STATE, classes + TAILS), np.float32)
        self.W = np.zeros((classes, CLASS_WORDS, STATE), np.float32)
        # The biases start at the training frequencies.
        padded = np.zeros(classes * CLASS_WORDS)
        padded[:k] = vocab.counts[:k]
        self.c = np.log(np.append(padded.reshape(-1, CLASS_WORDS).sum(1), vocab.tail_tokens + 1) + 1e-30).astype(np.float32)
        self.w = np.where(padded > 0, np.log(np.maximum(padded, 1)), -1e9).reshape(classes, CLASS_WORDS).astype(np.float32)

    def get(self) -> bytes:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).tobytes()

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def inputs_of(self, at: np.ndarray, kind: np.ndarray, modeled: int) -> np.ndarray:
        """What the network reads before each token: the one before it."""
        seen = np.where((at >= 0) & (at < modeled), at, modeled + kind - self.classes)
        return np.concatenate([[modeled + TAILS], seen[:-1]]).astype(np.int32)

    def run(self, x: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the rows of ``x`` (steps by lanes), from ``h`` or, at a document's start, from zero.

        ``keep`` gets what going back needs.
        """
        steps, lanes = x.shape
        # Lanes come last, so that each gate is one stretch of memory; callers see states lane by lane.
        states = np.empty((steps, STATE, lanes), np.float32)
        # Gates are computed from negated sums, so that one exponential is all they need, and take the place of the inputs.
        sign = np.concatenate([np.full(2 * STATE, -1, np.float32), np.ones(STATE, np.float32)])
        inputs = (self.X * sign).astype(np.float32, copy=False)
        recurrent = np.ascontiguousarray((self.U * sign).T, np.float32)
        h = np.ascontiguousarray(h.T, np.float32)
        fresh = x == len(self.X) - 1
        starts = fresh.any(1).tolist()
        kept = steps if keep is not None else 1
        gates, sums = (np.empty((kept, 3 * STATE, lanes), np.float32) for _ in range(2))
        before, reset = np.empty((kept, STATE, lanes), np.float32), np.empty_like(h)
        for t in range(steps):
            if starts[t]:
                h = h * ~fresh[t]
            k = t if keep is not None else 0
            gate, gh = gates[k], np.matmul(recurrent, h, out=sums[k])
            gate[:] = inputs[x[t]].T
            zr, n = gate[: 2 * STATE], gate[2 * STATE :]
            zr += gh[: 2 * STATE]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            n += np.multiply(zr[STATE:], gh[2 * STATE :], out=reset)
            np.tanh(n, out=n)
            if keep is not None:
                before[t] = h
            h = np.subtract(h, n, out=states[t])
            h *= zr[:STATE]
            h += n
        if keep is not None:
            keep.extend([before, gates, sums[:, 2 * STATE :]])
        return states.transpose(0, 2, 1)

    def output(self, s: np.ndarray, kind: np.ndarray, place: np.ndarray, backward: bool = False):
        """Natural log probabilities of classes and of words within modeled classes; and gradients, if asked for."""
        # Tokens are worked on sorted by class, so that those of a class are one stretch.
        order = np.argsort(kind.astype(np.uint16), kind="stable")
        kind, place = kind[order], place[order]
        s1 = np.empty((len(s), STATE + 1), s.dtype)
        s1[:, :STATE], s1[:, STATE] = s[order], 1
        out, dC = np.empty(len(s), s.dtype), np.zeros((STATE + 1, self.c.size), s.dtype)
        ds = np.empty((len(s), STATE), s.dtype) if backward else None
        weights, safe = _with_bias(self.C.T, self.c)
        for a in range(0, len(s), AT_ONCE):
            part = slice(a, a + AT_ONCE)
            out[part], p, scale = _log_softmax(s1[part], weights.T, kind[part], safe.all())
            if backward:
                np.multiply(p @ self.C.T, scale, out=ds[part])
                dC += (s1[part] * scale).T @ p
        bounds = np.searchsorted(kind, np.arange(self.classes + 1)).tolist()
        dW = np.zeros((*self.w.shape, STATE + 1), s.dtype) if backward else None
        inside, safe = _with_bias(self.W, self.w)
        safe = safe.all(-1).tolist()
        for k in range(self.classes):
            if bounds[k] == bounds[k + 1]:
                continue
            part = slice(bounds[k], bounds[k + 1])
            found, p, scale = _log_softmax(s1[part], inside[k].T, place[part], safe[k])
            out[part] += found
            if backward:
                ds[part] += (p @ self.W[k]) * scale
                np.matmul(p.T, s1[part] * scale, out=dW[k])
        sums = np.empty_like(out)
        sums[order] = out
        if not backward:
            return sums
        states = np.empty_like(ds)
        states[order] = ds
        return sums, states, {"C": dC[:STATE], "c": dC[STATE], "W": dW[..., :STATE], "w": dW[..., STATE]}

    def back(self, x: np.ndarray, keep: list, ds: np.ndarray) -> dict:
        """Gradients of the recurrent part from those of the states; none goes from a window to the one before."""
        h, made, ghn = keep
        z, r, n = (made[:, k * STATE : (k + 1) * STATE] for k in range(3))
        steps, lanes = x.shape
        ds = np.ascontiguousarray(ds.transpose(0, 2, 1))
        of_n, of_z, of_r = (np.empty((STATE, lanes), np.float32) for _ in range(3))
        gates = np.empty((steps, 3 * STATE, lanes), np.float32)  # gradients of the recurrent sums
        moved = np.empty((steps, lanes, 3 * STATE), np.float32)  # and of the inputs
        dh = np.zeros_like(ds[0])
        fresh = x == len(self.X) - 1
        starts = fresh.any(1).tolist()
        back = self.U.astype(np.float32, copy=False)
        for t in range(steps - 1, -1, -1):
            dh = ds[t] if (t + 1) % STEPS == 0 else dh + ds[t]
            zt, rt, nt, g = z[t], r[t], n[t], gates[t]
            # The derivatives: (1 - z)(1 - n n), (h - n) z (1 - z) and ghn r (1 - r).
            dn = np.subtract(1, zt, out=of_n)
            np.multiply(np.subtract(h[t], nt, out=of_z), zt, out=of_z)
            of_z *= dn
            np.multiply(dh, of_z, out=g[:STATE])
            np.multiply(nt, nt, out=of_r)
            dn *= np.subtract(1, of_r, out=of_r)
            dn *= dh
            np.multiply(dn, rt, out=g[2 * STATE :])
            np.multiply(np.subtract(1, rt, out=of_r), ghn[t], out=of_r)
            np.multiply(of_r, g[2 * STATE :], out=g[STATE : 2 * STATE])
            moved[t, :, : 2 * STATE], moved[t, :, 2 * STATE :] = g[: 2 * STATE].T, dn.T
            dh = dh * zt
            dh += back @ g
            if starts[t]:
                dh *= ~fresh[t]
        dU = np.matmul(h, gates.transpose(0, 2, 1)).sum(0)
        # Each input row's gradients, added up where rows are equal.
        order = np.argsort(x.astype(np.uint16), axis=None, kind="stable")
        seen = x.ravel()[order]
        firsts = np.flatnonzero(np.diff(seen, prepend=-1))
        dx = np.zeros_like(self.X)
        dx[seen[firsts]] = np.add.reduceat(moved.reshape(-1, 3 * STATE)[order], firsts, axis=0)
        return {"U": dU, "X": dx}


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of softmax rows side by side, shifted so that the exponentials neither overflow nor vanish.

    States lie within -1 and 1, so a logit is within the sum of its absolute weights of its bias. Only where that is
    much, which the second result denies, do rows need their own maximum, which :func:`_log_softmax` then takes.
    """
    shifted = (bias - bias.max(-1, keepdims=True))[..., None]
    return np.concatenate([weights, shifted], -1), np.abs(weights).sum(-1) <= SAFE_LOGIT


def _log_softmax(s1: np.ndarray, weights: np.ndarray, at: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of column ``at`` of each row, and the gradients of the logits: a matrix, and what its rows are to be scaled by."""
    p = s1 @ weights
    if not safe:
        p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    total = p @ np.ones(p.shape[1], p.dtype)
    rows = np.arange(len(p))
    found = p[rows, at]
    out = np.log(np.maximum(found, LEAST) / total)
    p[rows, at] = found - total
    return out, p, (1 / total)[:, None]


def windows(lengths: np.ndarray):
    """Start and size of each window, and how many of the documents, sorted by falling length, reach it."""
    start = 0
    while start < int(lengths[0]):
        lanes = int(np.searchsorted(-lengths, -start, side="left"))
        size = max(STEPS, SCORE_TOKENS // lanes)
        yield start, size, lanes
        start += size


class Trainer:
    def __init__(self, net: Network):
        self.net = net
        self.m = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
        self.v = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
        self.turn = 0
        self.tokens = 0

    def update(self, grads: dict) -> None:
        self.turn += 1
        rate = RATE * np.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn)
        squares = {name: np.einsum("...i,...i->...", g, g) for name, g in grads.items()}
        norm = np.sqrt(sum(float(q.sum()) for q in squares.values()))
        clip = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        for name, g in grads.items():
            m, v = self.m[name], self.v[name]
            # Of the inputs only those that occurred move.
            rows = np.flatnonzero(squares[name]) if name == "X" else None
            if rows is not None:
                g, m, v = g[rows], m[rows], v[rows]
            g = g * clip
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            g *= np.float32(0.001)
            v *= np.float32(0.999)
            v += g
            step = np.sqrt(v, out=g)
            step += np.float32(1e-8)
            np.divide(m, step, out=step)
            step *= np.float32(rate)
            if rows is None:
                getattr(self.net, name)[...] -= step
            else:
                self.m[name][rows], self.v[name][rows] = m, v
                getattr(self.net, name)[rows] -= step

    def learn(self, docs: Iterable[np.ndarray]) -> None:
        """One pass over documents, given as rows of input, class and place.

        A lane goes through its document to the end, and then takes the longest of those that wait.
        """
        docs, waiting, number = iter(docs), [], count()
        held = 0  # tokens of those that wait

        def following() -> np.ndarray | None:
            nonlocal held
            while held < WAITING_TOKENS and (doc := next(docs, None)) is not None:
                heapq.heappush(waiting, (-len(doc), next(number), doc))
                held += len(doc)
            if not waiting:
                return None
            doc = heapq.heappop(waiting)[2]
            held -= len(doc)
            return doc

        lanes: list = []  # what is left of each lane's document
        while len(lanes) < TRAIN_LANES and (doc := following()) is not None:
            lanes.append(doc)
        h = np.zeros((len(lanes), STATE), np.float32)
        while lanes:
            long = STEPS * min(MOST_WINDOWS, -(-LEAST_TOKENS // (len(lanes) * STEPS)))
            cells = np.zeros((len(lanes), long, 3), np.int32)
            filled = np.zeros((len(lanes), long), bool)
            for j, doc in enumerate(lanes):
                at = 0
                while at < long and doc is not None:
                    part = doc[: long - at]
                    cells[j, at : at + len(part)] = part
                    at += len(part)
                    doc = doc[len(part) :] if len(doc) > len(part) else following()
                filled[j, :at] = True
                lanes[j] = doc
            size = int(filled.any(0).sum())
            x, kind, place = np.ascontiguousarray(cells[:, :size].transpose(2, 1, 0))
            filled = filled[:, :size].T
            keep: list = []
            states = self.net.run(x, h, keep)
            if filled.all():
                shape = (-1, STATE)
                _, ds, grads = self.net.output(states.reshape(shape), kind.ravel(), place.ravel(), backward=True)
                ds = ds.reshape(states.shape)
            else:
                _, ds_filled, grads = self.net.output(states[filled], kind[filled], place[filled], backward=True)
                ds = np.zeros_like(states)
                ds[filled] = ds_filled
            grads |= self.net.back(x, keep, ds)
            tokens = int(filled.sum())
            self.update({n: g * np.float32(1 / tokens) for n, g in grads.items()})
            self.tokens += tokens
            left = [j for j, doc in enumerate(lanes) if doc is not None]
            h = states[-1][left]
            lanes = [lanes[j] for j in left]


def _average(rows: list[tuple[float, bytes]]) -> tuple[float, bytes]:
    total = sum(n for n, _ in rows)
    mean = sum(np.frombuffer(w, np.float32).astype(np.float64) * (n / total) for n, w in rows)
    return total, mean.astype(np.float32).tobytes()


def encoded(docs: DataFrame, vocab, train_where: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document once as numbers, stored: ``slice, key, row, ids, n_tokens, known, base, static, rest``.

    ``slice`` is the round in which it is trained on, -1 for none; ``known``, ``base`` and ``static`` are the parts of count, base score
    and score that the words in memory have, and ``rest`` the words that must be looked up. ``vocab`` is a broadcast vocabulary.
    """

    def run(batches):
        vocab = vocab_.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(2)
            for start, stop in portions(texts):
                words, sizes = words_of(texts.slice(start, stop - start))
                at, kind = vocab.look_up_all(words, sizes)
                starts = np.cumsum(sizes + 1) - sizes - 1

                def added(values, starts=starts):
                    return np.add.reduceat(values, starts)

                head, tail = at >= 0, kind >= vocab.classes
                log_count = np.zeros(len(at))
                log_count[head] = vocab.log_count[at[head]]
                static = np.where(tail, log_count, 0)
                static[tail] -= vocab.tail_scale[kind[tail] - vocab.classes]
                inside = np.ones(len(at), bool)
                inside[starts + sizes] = False
                missing = ~head & inside
                rest = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(added(missing.astype(np.int32)))), pa.int32()), words.filter(pa.array(missing[inside]))
                )
                bounds = np.append(starts, len(at)).astype(np.int32) * np.int32(2)
                ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(vocab.numbers(at, kind))])
                columns = [pa.array(np.arange(row, row + len(sizes))), ids, pa.array(sizes + 1), pa.array(added(head.astype(np.int64))), pa.array(added(log_count)), pa.array(added(static)), rest]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, stop - start) for k in (0, 1)), *columns], names)
                row += len(sizes)

    vocab_ = vocab
    names = ["slice", "key", "row", "ids", "n_tokens", "known", "base", "static", "rest"]
    kind = docs.schema[key].dataType.simpleString()
    turn = F.when(F.coalesce(train_where, F.lit(False)), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(SLICES))).otherwise(-1)
    rows = docs.select(turn.cast("int").alias("slice"), F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"slice int, key {kind}, row long, ids binary, n_tokens long, known long, base double, static double, rest array<binary>"
    return stored(rows.mapInArrow(run, schema), "numbers", by=["slice"])


def train_on(numbers: DataFrame, known, vocab: Vocabulary) -> Network:
    """Rounds of training and averaging over stored numbers; ``known`` is the broadcast ``vocab``.

    A round has one task for every ``TASK_TOKENS`` tokens; the weights of ``FAN_IN`` tasks meet in one, until as few are left.
    """
    net = Network(vocab)
    spark = numbers.sparkSession
    sizes = dict(numbers.where("slice >= 0").groupBy("slice").agg(F.sum("n_tokens")).collect())  # one row per round
    for turn in range(SLICES):
        if turn not in sizes:
            continue
        start = spark.sparkContext.broadcast(net.get())

        def run(batches, start=start):
            vocab = known.value
            net = Network(vocab)
            net.put(np.frombuffer(start.value, np.float32))
            trainer = Trainer(net)
            trainer.learn(vocab.rows(np.frombuffer(v.as_py(), np.uint16)) for batch in batches for v in batch.column(0))
            if trainer.tokens:
                yield pa.RecordBatch.from_arrays([pa.array([float(trainer.tokens)]), pa.array([net.get()], pa.binary())], ["n", "weights"])

        def mean(batches):
            total = None
            for batch in batches:
                for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total = _average([row] + ([total] if total else []))
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1]], pa.binary())], ["n", "weights"])

        tasks = max(1, round(sizes[turn] / TASK_TOKENS))
        trained = numbers.where(F.col("slice") == turn).select("ids").coalesce(tasks).mapInArrow(run, "n double, weights binary")
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            trained = trained.repartition(tasks).mapInArrow(mean, "n double, weights binary")
        found = trained.collect()  # of ``FAN_IN`` tasks at most
        tokens, mean_weights = _average([tuple(r) for r in found])
        net.put(np.frombuffer(mean_weights, np.float32))
        net.tokens += int(tokens)
    return net


def train(docs: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text") -> Network:
    """A network that has learned from all rows."""
    known = docs.sparkSession.sparkContext.broadcast(vocab)
    numbers = encoded(docs, known, F.lit(True), key, text)
    net = train_on(numbers, known, vocab)
    release(numbers)
    return net


def log_likelihoods(net: Network, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Natural log probability of each document's classes and modeled words, the state carried through."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i][0]))
    out = np.zeros(len(docs))
    for first in range(0, len(order), SCORE_LANES):
        group = order[first : first + SCORE_LANES]
        part = [docs[i] for i in group]
        lengths = np.array([len(d[0]) for d in part])
        total = np.zeros(len(part))
        inputs, kinds, places = (np.concatenate([d[k] for d in part]) for k in range(3))
        firsts = np.cumsum(lengths) - lengths
        h = np.zeros((len(part), STATE), np.float32)
        for start, size, lanes in windows(lengths):
            step = np.arange(start, min(start + size, lengths[0]))[:, None]
            filled = step < lengths[:lanes]
            cells = firsts[:lanes] + step
            x = inputs[np.minimum(cells, len(inputs) - 1)]  # a document that has ended reads on, for nothing
            cells = cells[filled]
            states = net.run(x, h[:lanes])
            found = net.output(states[filled], kinds[cells], places[cells])
            total += np.bincount(np.nonzero(filled)[1], found, len(part))
            h = states[-1]
        out[group] = total
    return out


def score(docs: DataFrame, train_where: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` of every row, learning from those of ``train_where``."""
    counts = count_words(docs.where(train_where), text)
    vocab = vocabulary(counts)
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(vocab)
    numbers = encoded(docs, known, train_where, key, text)
    weights = sc.broadcast(train_on(numbers, known, vocab).get())

    def run(batches):
        vocab = known.value
        net = Network(vocab)
        net.put(np.frombuffer(weights.value, np.float32))
        for batch in batches:
            ids, sizes = batch.column(0), batch.column(1).to_numpy()
            at = 0
            while at < batch.num_rows:
                # Many documents at once, so that long ones run beside others of their kind; bounded in tokens.
                within = int(np.searchsorted(np.cumsum(sizes[at:]), WAITING_TOKENS))
                stop = at + max(1, min(within, 10 * SCORE_LANES))
                docs = [tuple(vocab.rows(np.frombuffer(v.as_py(), np.uint16)).T) for v in ids.slice(at, stop - at)]
                model = log_likelihoods(net, docs) / np.log(10) + batch.column(2).to_numpy()[at:stop]
                yield pa.RecordBatch.from_arrays([pa.array(model), *(batch.column(c).slice(at, stop - at) for c in names[1:])], names)
                at = stop

    names = ["model", "key", "row", "n_tokens", "known", "base"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"model double, key {kind}, row long, n_tokens long, known long, base double"
    main = numbers.select("ids", "n_tokens", "static", "key", "row", "known", "base").mapInArrow(run, schema)
    # What the head lacks: only words that training has seen add anything.
    rare = numbers.select("row", F.explode("rest").alias("word")).join(counts.select("word", "c"), "word")
    more = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("c").alias("seen"))
    scale = F.log10(F.lit(float(vocab.tokens + vocab.distinct + 1)))
    extra = F.coalesce("more", F.lit(0.0))
    return main.join(more, "row", "left").select(
        F.col("key").alias(key), "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("model") + extra if vocab.tokens else F.lit(0.0)).alias("score"),
    )
