"""Best-fit packing of documents into sequences of a fixed number of tokens, by linear grouping.

1. Documents become pieces: a document longer than a sequence is cut into whole sequences, and the rest comes
   first. Pieces are stored with their place among the equally long pieces of their task.
2. What decides the packing is how many pieces have each length, a table of at most ``capacity`` rows. Large
   lengths, ``capacity / SMALL`` and more, are dealt into groups of equal cardinality and rounded up to
   the largest of their group. With so few sizes, configurations (how many of each size share a sequence) are
   optimised as a linear program by column generation: a knapsack over the sizes' prices finds the next useful
   configuration. The solution is rounded up.
3. Actual pieces take the places of their rounded sizes, longest first. What a place is longer than its piece
   is free again. Small pieces then go, longest first, to the sequence they fit best, and to new ones last.

Sequences of like content are handled as one run with a count, and so are equally long pieces. The plan is a
table of ``(length, first rank, count) -> (first sequence, offset)`` rows whose size depends on ``capacity`` and
the number of groups, not on the documents; a piece finds its sequence by its rank among pieces of its length.
Ranks come from counts per task and length, so no length, however common, meets in one task.

Null texts are handled as empty. Each row is one document, repeated or not, with at least the end token. An empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaforge.llm.tables import stored

FILE = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
CAPACITY = 2048
END = 0

#: Pieces longer than ``capacity / SMALL`` are packed by configurations.
SMALL = 4
#: Distinct sizes after rounding.
GROUPS = 240
#: Rounds of column generation at most.
ROUNDS = 1_500

#: Stretches of text whose ids a worker keeps; a full table is emptied.
TABLE_SIZE = 500_000
LONGEST_KEPT = 64
#: Only below this character do both tokenizer libraries surely agree on what letters are.
PLAIN_BELOW = "ɐ"
_ODD_SPACE = re.compile(r"\s")


class Tokens:
    """Ids of texts as the tokenizer file defines them.

    A text is cut before each space. Where no space is followed by white space or the text's end, no token
    crosses such a cut, so stretches can be encoded apart and remembered. Other texts are encoded in one go.
    """

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.fast = self._fast(ranks) if ranks else None
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _fast(ranks: str):
        """The same vocabulary in the library that is quicker with short strings."""
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _ids(self, text: str) -> bytes:
        if self.fast and text and max(text) < PLAIN_BELOW and "<|" not in text:
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        head, *rest = text.split(" ")
        if rest and ("" in rest or any(map(_ODD_SPACE.match, rest))):
            return self._ids(text)
        known = self.known
        if len(known) > TABLE_SIZE:
            known.clear()
        out = [self._ids(head)]
        for stretch in rest:
            ids = known.get(stretch)
            if ids is None:
                ids = self._ids(" " + stretch)
                if len(stretch) <= LONGEST_KEPT:
                    known[stretch] = ids
            out.append(ids)
        return b"".join(out)


@functools.lru_cache(2)
def tokens(path: str | None, ranks: str | None) -> Tokens:
    import public_tokenizers

    return Tokens(path or public_tokenizers.path(FILE), ranks or (None if path else public_tokenizers.path(RANKS)))


def pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32``, with the task and the rank among its equals there."""

    def run(batches):
        coder = tokens(path, ranks)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            keys, out = [], []
            for row, value in enumerate(batch.column(1)):
                ids = coder.encode(value.as_py() or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                for k in range(-(-n // capacity)):
                    a = first + (k - 1) * capacity if k else 0
                    b = first + k * capacity
                    keys.append(row)
                    out.append((k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), seen[b - a]))
                    seen[b - a] += 1
            table = np.array(out, np.int64).reshape(-1, 5)
            columns = [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(table[:, 0].astype(np.int32))]
            columns += [pa.array(table[:, i]) for i in range(1, 5)] + [pa.array(np.full(len(keys), task, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "length", "ids_crc32", "local", "task"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, local long, task int"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(run, schema).withColumnRenamed("key", key), "pieces")


# ---- The plan: from lengths and counts to places.


def grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, falling, and the number of items of each, after rounding up in groups of equal cardinality.

    ``lengths`` fall. With few enough lengths nothing is rounded.
    """
    if len(lengths) <= groups:
        return lengths, counts
    share = -(-int(counts.sum()) // groups)
    # A group ends where its share is reached; its size is the largest length in it.
    ends = np.cumsum(counts)
    sizes, amounts = [], []
    for g in range(int((ends[-1] - 1) // share) + 1):
        a, b = g * share, min((g + 1) * share, int(ends[-1]))
        sizes.append(int(lengths[np.searchsorted(ends, a, side="right")]))
        amounts.append(b - a)
    sizes, amounts = np.array(sizes), np.array(amounts)
    kept, inverse = np.unique(-sizes, return_inverse=True)
    return -kept, np.bincount(inverse, amounts).astype(np.int64)


def _best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: how many of each size make the most of a sequence."""
    value = np.zeros(capacity + 1)
    before = []
    for size, price in zip(sizes.tolist(), prices.tolist()):
        before.append(value)
        value = value.copy()
        for _ in range(capacity // size):  # one more of this size each time
            more = value[:-size] + price
            better = more > value[size:] + 1e-12
            if not better.any():
                break
            value[size:][better] = more[better]
    out = np.zeros(len(sizes), np.int64)
    r = capacity
    for k in range(len(sizes) - 1, -1, -1):
        size, price = int(sizes[k]), float(prices[k])
        while r >= size and value[r] > before[k][r] + 1e-12:
            out[k] += 1
            r -= size
        value = before[k]
    return out


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination with row exchange, without the threads that a library would start for a small matrix."""
    n = len(matrix)
    both = np.concatenate([matrix, np.eye(n)], 1)
    for k in range(n):
        p = k + int(np.abs(both[k:, k]).argmax())
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        others = both[:, k].copy()
        others[k] = 0
        both -= np.outer(others, both[k])
    return both[:, n:]


def configurations(sizes: np.ndarray, amounts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, so that at least ``amounts`` places of each size result.

    The basis starts with one size per sequence. Each round prices the sizes, finds the configuration of
    greatest value and exchanges it for the column that limits it.
    """
    n = len(sizes)
    if not n:
        return []
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    use = (inverse * amounts).sum(1)
    for turn in range(rounds):
        prices = np.maximum(inverse.sum(0), 0)
        new = _best_configuration(sizes, prices, capacity).astype(float)
        if (new * prices).sum() <= 1 + 1e-7:
            break
        step = (inverse * new).sum(1)
        able = step > 1e-9
        if not able.any():
            break
        limits = np.where(able, use / np.where(able, step, 1), np.inf)
        out = int(limits.argmin())
        columns[:, out] = new
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        if turn % 100 == 99:  # rounding errors add up
            inverse = _inverse(columns)
        use = np.maximum((inverse * amounts).sum(1), 0)
    # Whole numbers: as much as the program says, rounded down; what is left is filled largest first.
    whole = np.floor(np.nan_to_num(use, posinf=0) + 1e-6).astype(np.int64).clip(0, amounts.sum())
    out = [(columns[:, j].astype(np.int64), int(whole[j])) for j in range(n) if whole[j]]
    left = amounts - columns.astype(np.int64) @ whole
    while (left > 0).any():
        config, room = np.zeros(n, np.int64), capacity
        for k in range(n):
            take = min(max(int(left[k]), 0), room // int(sizes[k]))
            config[k], room = take, room - take * int(sizes[k])
        times = int((np.maximum(left, 0)[config > 0] // config[config > 0]).min())
        out.append((config, max(times, 1)))
        left = left - config * max(times, 1)
    return out


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> np.ndarray:
    """Rows ``length, first rank, count, first sequence, offset``, sorted: item ``first + i`` goes to sequence ``first + i``."""
    lengths = np.array(sorted(counts, reverse=True), np.int64)
    amounts = np.array([counts[n] for n in lengths.tolist()], np.int64)
    large = lengths * small > capacity
    sizes, places = grouped(lengths[large], amounts[large], groups)
    stock = _Stock(lengths[large], amounts[large])
    rows: list[tuple[int, int, int, int, int]] = []
    runs: list[tuple[int, int, int]] = []  # first sequence, how many, tokens used
    sequence = 0
    for config, times in configurations(sizes, places, capacity):
        # Runs of this configuration's sequences that have held the same lengths so far.
        parts = [(sequence, times, 0)]
        sequence += times
        for k in np.repeat(np.arange(len(sizes)), config):
            split = []
            for first, n, used in parts:
                done = 0
                for length, rank, m in stock.take(int(sizes[k]), n):
                    if m and length:
                        rows.append((length, rank, m, first + done, used))
                    split.append((first + done, m, used + length))
                    done += m
            parts = split
        runs += parts
    assert stock.empty()
    runs = [r for r in runs if r[1]]
    used_any = [r for r in runs if r[2]]
    # Sequences whose places all stayed empty are not made: number the others anew, without gaps.
    shift, renumbered, starts = 0, [], []
    for first, n, used in sorted(runs):
        if used:
            renumbered.append((first - shift, n, used))
            starts.append((first, shift))
        else:
            shift += n
    if len(used_any) != len(runs):
        firsts = np.array([s[0] for s in starts])
        shifts = [s[1] for s in starts]
        rows = [(a, b, c, d - shifts[np.searchsorted(firsts, d, side="right") - 1], e) for a, b, c, d, e in rows]
    sequence -= shift
    _fill(rows, renumbered, lengths[~large], amounts[~large], sequence, capacity)
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


class _Stock:
    """Large pieces still to be placed, as (length, next rank, left), lengths falling."""

    def __init__(self, lengths: np.ndarray, amounts: np.ndarray):
        self.items = [[int(n), 0, int(c)] for n, c in zip(lengths, amounts)]
        self.at: dict[int, int] = {}

    def take(self, size: int, n: int):
        """``n`` places of ``size``: the longest pieces that fit, as (length, first rank, count); length 0 for unused places."""
        i = self.at.get(size)
        if i is None:
            i = next((k for k, item in enumerate(self.items) if item[0] <= size), len(self.items))
        while n and i < len(self.items):
            length, rank, left = self.items[i]
            m = min(n, left)
            if m:
                yield length, rank, m
                self.items[i][1] += m
                self.items[i][2] -= m
                n -= m
            if not self.items[i][2]:
                i += 1
        self.at[size] = i
        if n:
            yield 0, 0, n

    def empty(self) -> bool:
        return not any(left for _, _, left in self.items)


def _fill(rows: list, runs: list, lengths: np.ndarray, amounts: np.ndarray, sequence: int, capacity: int) -> None:
    """Best fit for the small pieces: the fullest run of sequences that still has room, then new sequences."""
    by_room: dict[int, list[tuple[int, int]]] = {}
    for first, n, used in runs:
        by_room.setdefault(capacity - used, []).append((first, n))
    for length, left in zip(lengths.tolist(), amounts.tolist()):
        rank = 0
        for room in range(length, capacity + 1):
            if not left:
                break
            waiting = by_room.get(room)
            while waiting and left:
                first, n = waiting.pop()
                each = min(room // length, left)
                full = min(n, left // each)
                if full < n:
                    waiting.append((first + full, n - full))
                for k in range(each):
                    rows.append((length, rank, full, first, capacity - room + k * length))
                    rank += full
                left -= each * full
                by_room.setdefault(room - each * length, []).append((first, full))
        while left:
            each = min(capacity // length, left)
            full = left // each
            for k in range(each):
                rows.append((length, rank, full, sequence, k * length))
                rank += full
            left -= each * full
            by_room.setdefault(capacity - each * length, []).append((sequence, full))
            sequence += full


def pack(
    parts: DataFrame, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    spark = parts.sparkSession
    counts = parts.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "offsets")
    histogram = offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    plan = make_plan({r[0]: r[1] for r in histogram}, capacity, small, groups)
    shared = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = shared.value
        most = int(max(table[:, 1].max(initial=0), rank.max() if len(rank) else 0)) + 1
        at = np.searchsorted(table[:, 0] * most + table[:, 1], length.to_numpy() * most + rank.to_numpy(), side="right") - 1
        row = table[at]
        return pd.DataFrame({"sequence_id": row[:, 3] + rank.to_numpy() - row[:, 1], "offset": row[:, 4]})

    ranked = parts.join(offsets.drop("n"), ["task", "length"]).withColumn("rank", F.col("before") + F.col("local"))
    placed = ranked.withColumn("place", place("length", "rank"))
    keep = [c for c in parts.columns if c not in ("task", "local")]
    return placed.select(*keep, "place.sequence_id", "place.offset")
