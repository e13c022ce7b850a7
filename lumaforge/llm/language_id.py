"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text becomes lower-case letters with one space for any run of other characters. Each window of one to three
characters is hashed into one of ``buckets`` cells. Training counts cells per language in every partition and
adds the counts up by a shuffle; the summed table is at most languages times buckets numbers whatever the data,
so its log probabilities are broadcast. A batch is scored by gathering a row of the matrix for each window and
summing the rows of each text.

A text that is null or has no letter is ``und`` with score 0. Training rows without a language or without a
letter add nothing. If there is no training row at all, every text is ``und``. Texts are used whole, in chunks
of bounded size. Repeated rows count as often as they occur, and each gets its own result. Ties go to the
language that sorts first. Only the named columns are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
ORDERS = (1, 2, 3)
#: Cells of the hash table, for fewer than about a thousand languages.
BUCKETS = 1 << 16
#: Numbers in the matrix at most; with more languages the table gets fewer cells.
MATRIX_CELLS = 1 << 25
SMOOTHING = 0.5
#: Characters hashed at once.
CHUNK = 1 << 18
#: Cells that wait in a training task before they are counted.
HELD = 1 << 20

_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@functools.lru_cache(1)
def _letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str | None) -> np.ndarray:
    """Code points of the text as words of lower-case letters, a space before each and after the last; none without a letter."""
    if not text:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letter_table()[codes]
    kept = letter.copy()
    kept[:-1] |= letter[1:]  # what stands before a letter
    kept[1:] |= letter[:-1]  # what stands behind one
    codes, letter = codes[kept], letter[kept]
    if not len(codes):
        return codes
    codes = np.where(letter, codes, np.uint32(32))
    twice = ~letter
    twice[0] = False
    twice[1:] &= ~letter[:-1]
    return codes[~twice]


def cells(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Hash cell of every window."""
    found = []
    rolling = np.zeros(len(codes), np.uint32)
    for order in ORDERS:
        n = len(codes) - order + 1
        if n <= 0:
            break
        rolling = rolling[:n] * np.uint32(0x01000193) + codes[order - 1 :]
        mixed = (rolling ^ np.uint32(order * 0x1F123BB5 & 0xFFFFFFFF)) * np.uint32(_MULTIPLIERS[order - 1])
        found.append((mixed >> np.uint32(15)) & np.uint32(buckets - 1))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def _chunks(codes: np.ndarray):
    """Pieces of a long text that overlap, so that no window is lost; windows in the overlap count twice."""
    step = CHUNK - max(ORDERS) + 1
    for start in range(0, max(1, len(codes) - max(ORDERS) + 1), step):
        yield codes[start : start + CHUNK]


def buckets_for(languages: int) -> int:
    size = BUCKETS
    while size > 256 and size * languages > MATRIX_CELLS:
        size //= 2
    return size


def add_up(totals: dict[int, np.ndarray], waiting: dict[int, list[np.ndarray]], buckets: int) -> None:
    """Count the cells that wait for each language, and forget them."""
    for k, found in waiting.items():
        totals[k][:buckets] += np.bincount(np.concatenate(found), minlength=buckets)
    waiting.clear()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None) -> tuple[list[str], np.ndarray]:
    """Language names in order, and log probabilities as a matrix of cells by languages, prior in its last row."""
    rows = docs if where is None else docs.where(where)
    rows = rows.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not names:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    buckets = buckets_for(len(names))

    def count(batches):
        place = {name: i for i, name in enumerate(names)}
        totals: dict[int, np.ndarray] = {}
        waiting: dict[int, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                plain, k = letters(value.as_py()), place[name]
                if not len(plain):
                    continue
                totals.setdefault(k, np.zeros(buckets + 1, np.int64))[buckets] += 1
                for chunk in _chunks(plain):
                    found = cells(chunk, buckets)
                    waiting.setdefault(k, []).append(found)
                    held += len(found)
                    if held > HELD:
                        add_up(totals, waiting, buckets)
                        held = 0
        add_up(totals, waiting, buckets)
        for k, row in totals.items():
            used = np.flatnonzero(row)
            columns = [pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(row[used])]
            yield pa.RecordBatch.from_arrays(columns, ["k", "cell", "n"])

    partial = rows.mapInArrow(count, "k int, cell int, n long")
    summed = partial.groupBy("k", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((buckets + 1, len(names)))
    counts[summed["cell"].to_numpy(), summed["k"].to_numpy()] = summed["n"].to_numpy()
    grams = counts[:buckets] + SMOOTHING
    prior = counts[buckets:] + SMOOTHING
    table = np.concatenate([np.log(grams / grams.sum(0)), np.log(prior / prior.sum())])
    # Only differences between languages matter; small numbers add up exactly enough in single precision.
    return names, (table - table.mean(1, keepdims=True)).astype(np.float32)


def score(texts: list[str | None], names: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Best language and its posterior probability for each text."""
    buckets = len(table) - 1
    best, posterior = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not names:
        return best, posterior
    for i, value in enumerate(texts):
        plain = letters(value)
        if not len(plain):
            continue
        total = table[buckets].astype(np.float64)
        for chunk in _chunks(plain):
            found = table[cells(chunk, buckets)]
            total += np.ones(len(found), np.float32) @ found
        k = int(total.argmax())
        best[i], posterior[i] = names[k], 1 / np.exp(total - total[k]).sum()
    return best, posterior


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names, table = shared.value
        for batch in batches:
            best, posterior = score(batch.column(1).to_pylist(), names, table)
            columns = [batch.column(0), pa.array(best, pa.string()), pa.array(posterior)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
