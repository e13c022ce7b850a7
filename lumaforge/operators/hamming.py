"""Pairs of 64-bit hashes within a Hamming distance, and what they connect.

The bits are cut into chunks. With ``t`` as the threshold and ``m`` chunks, two hashes within ``t`` are within
``t div m`` in at least one chunk, so one side is filed under its chunk's value, the other under every value that
near to its own. Many narrow chunks mean few keys but crowded ones, few wide chunks the reverse; ``chunking`` takes the
number that costs least for the number of hashes at hand.

Hashes of one key are compared in numpy, in tiles of at most ``TILE`` rows on either side, so a pattern
that most hashes share is spread over as many tasks as it needs. A pair is reported by the first chunk that finds it.

At a threshold so wide that chunks leave a good part of all pairs, comparing all with all costs less: the hashes are dealt
into a number of parts that does not grow with them, and each two parts meet in a task as one square of a matrix. A row is
shuffled once for each part, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaforge.operators.batches import whole_groups
from lumaforge.operators.skew import join_counted
from lumaforge.session import cut_lineage

BITS = 64
#: Rows of a key on one side that are compared in one task.
TILE = 4096
#: Pairs compared at once.
PAIRS = 1 << 20
#: Cost of a row filed under a key in comparisons.
ROW_COST = 100
#: Keys of one hash, at most.
MOST_KEYS = 5000
#: Pairs of a square that are compared in the time of one pair of scattered rows.
SQUARE_GAIN = 30
#: Parts that are compared with each other, at least; fewer hashes than ``TILE`` are one part.
PARTS = 16
#: Rows of a part, at most.
PART_ROWS = 1 << 20
#: Pairs of a square that are worked on at once, so that they stay in the processor's cache.
SQUARE_PAIRS = 1 << 16


@dataclass(frozen=True)
class Chunk:
    shift: int
    width: int
    radius: int

    @property
    def mask(self) -> int:
        return ((1 << self.width) - 1) << self.shift

    @property
    def near(self) -> int:
        """Number of values within the radius of one."""
        return sum(comb(self.width, k) for k in range(min(self.radius, self.width) + 1))

    def patterns(self) -> np.ndarray:
        """What to flip for each of those values."""
        flips = [sum(1 << b for b in bits) for k in range(self.radius + 1) for bits in combinations(range(self.width), k)]
        return np.array(flips, np.uint64)


def chunks_of(threshold: int, m: int) -> list[Chunk]:
    wide, extra = divmod(BITS, m)
    out, at = [], 0
    for k in range(m):
        width = wide + (k < extra)
        out.append(Chunk(at, width, min(threshold // m, width)))
        at += width
    return out


def cost(chunks: list[Chunk], n: int) -> float:
    """Comparisons, and what filing the rows costs, for ``n`` evenly spread hashes."""
    return n * sum(1 + c.near for c in chunks) * ROW_COST + float(n) * n * sum(c.near / 2**c.width for c in chunks)


def chunking(threshold: int, n: int) -> list[Chunk]:
    """The cheapest chunks; one that spans all values is a comparison of all with all, in tiles."""
    options = [chunks_of(threshold, m) for m in range(1, min(threshold + 1, 32) + 1)]
    fit = [c for c in options if sum(x.near for x in c) <= MOST_KEYS]
    if not fit:
        return [Chunk(0, 0, 0)]
    best = min(fit, key=lambda c: cost(c, n))
    return best if cost(best, n) < float(n) * n + 2 * n * ROW_COST else [Chunk(0, 0, 0)]


def filed(distinct: DataFrame, chunks: list[Chunk]) -> DataFrame:
    """``chunk, key, probe, h, ord``: each hash under its own values (probe 0) and under those near to them (1)."""
    plans = [(k, np.uint64(c.shift), np.uint64((1 << c.width) - 1), c.patterns()) for k, c in enumerate(chunks)]

    def run(batches):
        for batch in batches:
            h = batch.column(0).to_numpy()
            order = batch.column(1).to_numpy()
            bits = h.view(np.uint64)
            for k, shift, mask, patterns in plans:
                value = (bits >> shift) & mask
                for probe, flips in ((0, patterns[:1]), (1, patterns)):
                    step = max(1, PAIRS // 8 // max(1, len(h)))
                    for start in range(0, len(flips), step):
                        some = flips[start : start + step]
                        keys = (value[:, None] ^ some[None, :]).ravel().view(np.int64)
                        size = len(keys)
                        columns = [np.full(size, k, np.int32), keys, np.full(size, probe, np.int8), np.repeat(h, len(some)), np.repeat(order, len(some))]
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["chunk", "key", "probe", "h", "ord"])

    return distinct.select("h", F.col("ord").cast("long").alias("ord")).mapInArrow(run, "chunk int, key long, probe byte, h long, ord long")


def tiled(rows: DataFrame, tile: int) -> DataFrame:
    """``chunk, key, a, b, probe, h, ord`` grouped by the first four: each tile of plain rows meets each of probes.

    Only keys with more rows than a tile are counted out and dealt again; one look says whether there are any.
    """
    key = ["chunk", "key"]
    sizes = rows.groupBy(*key).agg(F.count_if(F.col("probe") == 0).alias("plain"), F.count_if(F.col("probe") == 1).alias("probes"))
    crowded = cut_lineage(
        sizes.where((F.col("plain") > tile) | (F.col("probes") > tile))
        .selectExpr(*key, f"cast(ceil(plain / {tile}) AS int) AS a_parts", f"cast(ceil(probes / {tile}) AS int) AS b_parts", "plain + probes AS _size")
    )
    nothing = crowded.isEmpty()
    calm = rows if nothing else join_counted(rows, crowded, key, "_size", "left_anti")
    out = calm.selectExpr(*key, "0 AS a", "0 AS b", "probe", "h", "ord")
    if not nothing:
        own = "cast(pmod(xxhash64(ord), if(probe = 0, a_parts, b_parts)) AS int)"
        dealt = join_counted(rows, crowded, key, "_size").selectExpr(
            *key, f"{own} AS own", "explode(sequence(0, greatest(if(probe = 0, b_parts, a_parts), 1) - 1)) AS other", "probe", "h", "ord"
        )
        out = out.unionByName(dealt.selectExpr(
            *key, "if(probe = 0, own, other) AS a", "if(probe = 0, other, own) AS b", "probe", "h", "ord"
        ))
    group = [*key, "a", "b"]
    return out.repartition(*group).sortWithinPartitions(*group, "probe")


def products(plain: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs of a plain row and a probe of its group, in portions; plain rows come first in a group."""
    ends = np.append(firsts[1:], len(plain))
    before = np.concatenate([[0], np.cumsum(plain)])
    split = firsts + before[ends] - before[firsts]
    times, first = np.repeat(ends - split, split - firsts), np.repeat(split, split - firsts)
    lefts = np.flatnonzero(plain)
    done = np.cumsum(times)
    at = 0
    while at < len(lefts):
        so_far = done[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(done, so_far + PAIRS, side="right")))
        some = times[at:stop]
        inside = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        yield np.repeat(lefts[at:stop], some), np.repeat(first[at:stop], some) + inside
        at = stop


def parts_of(n: int, parallelism: int = 1, rows: int = PART_ROWS) -> int:
    """Number of parts for ``n`` hashes: enough squares for the cores, and for memory."""
    return max(1 if n <= TILE else max(PARTS, ceil(sqrt(8 * parallelism))), -(-n // rows))


def in_squares(threshold: int, n: int) -> bool:
    """Whether comparing all ``n`` hashes with all costs less than what chunks leave."""
    return float(n) * n / SQUARE_GAIN + n * parts_of(n) * ROW_COST < cost(chunking(threshold, n), n)


def near_in(left: np.ndarray, right: np.ndarray, threshold: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``left`` and ``right`` of all hashes within the threshold, and distances; if both are the ``same``, each two once."""
    wide = max(1, min(len(right), SQUARE_PAIRS // 16))
    high = max(1, SQUARE_PAIRS // wide)
    apart, bits, near = (np.empty((high, wide), kind) for kind in (np.uint64, np.uint8, bool))
    found, held = [], 0
    for start in range(0, len(left), high):
        rows = left[start : start + high, None]
        for at in range(start - start % wide if same else 0, len(right), wide):
            columns = right[None, at : at + wide]
            cut = slice(len(rows)), slice(columns.shape[1])
            np.bitwise_count(np.bitwise_xor(rows, columns, out=apart[cut]), out=bits[cut])
            cells = np.flatnonzero(np.less_equal(bits[cut], threshold, out=near[cut]))
            if not len(cells):
                continue
            a, b = np.divmod(cells, columns.shape[1])
            part = a + start, b + at, bits[a, b]
            if same:
                part = tuple(c[part[0] < part[1]] for c in part)
            found.append(part)
            held += len(part[0])
            if held >= SQUARE_PAIRS:
                yield tuple(map(np.concatenate, zip(*found)))
                found, held = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*found)))


def first_near(rows: np.ndarray, leaders: np.ndarray, threshold: int) -> np.ndarray:
    """Place of the first of the ``leaders`` within the threshold of each row, -1 if there is none."""
    out = np.full(len(rows), -1, np.int64)
    for at in range(0, len(leaders), SQUARE_PAIRS // 64):
        some = leaders[None, at : at + SQUARE_PAIRS // 64]
        still = np.flatnonzero(out < 0)
        for start in range(0, len(still), 64):
            pick = still[start : start + 64]
            near = np.bitwise_count(rows[pick, None] ^ some) <= threshold
            first = near.argmax(1)
            hit = near[np.arange(len(pick)), first]
            out[pick[hit]] = first[hit] + at
    return out


def squares(distinct: DataFrame, threshold: int, emit: Callable, schema: str, parts: int) -> DataFrame:
    """All pairs within the threshold, each two parts in one group; see :func:`near_pairs`."""

    def compare(batches):
        for table, firsts in whole_groups(batches, ["square"]):
            square, part, h, order = (table.column(c).to_numpy() for c in ("square", "part", "h", "ord"))
            bits = h.view(np.uint64)
            for start, end in zip(firsts.tolist(), [*firsts[1:].tolist(), len(order)]):
                first, second = divmod(int(square[start]), parts)
                split = start + int(np.searchsorted(part[start:end], first, side="right"))
                left = slice(start, split)
                right = left if first == second else slice(split, end)

                def pairs(left=left, right=right):
                    for a, b, distance in near_in(bits[left], bits[right], threshold, left == right):
                        a, b = a + left.start, b + right.start
                        turned = order[a] > order[b]
                        yield np.where(turned, b, a) - left.start, np.where(turned, a, b) - left.start, distance

                yield from emit(order[start:end], pairs())

    part = F.pmod(F.xxhash64("ord"), F.lit(parts)).cast("int")
    rows = distinct.where("h IS NOT NULL AND ord IS NOT NULL").select("h", F.col("ord").cast("long").alias("ord"), part.alias("part"))
    met = f"explode(transform(sequence(0, {parts - 1}), other -> least(part, other) * {parts} + greatest(part, other))) AS square"
    # By number, since small shuffles that take long to compare are not to be put together.
    tasks = min(parts * (parts + 1) // 2, max(256, 32 * distinct.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.selectExpr("h", "ord", "part", met).repartition(tasks, "square")
    return dealt.sortWithinPartitions("square", "part").mapInArrow(compare, schema)


def near_pairs(distinct: DataFrame, threshold: int, emit: Callable, schema: str, n: int | None = None, tile: int | None = None) -> DataFrame:
    """Compare all candidates of ``distinct(h, ord)``; ``emit(ord, pairs)`` makes record batches of a task's pairs.

    ``pairs`` yields row numbers of the smaller and of the larger ``ord``, and distances; each pair comes once.
    ``tile`` bounds the rows of one side that a task compares.
    """
    if not 0 <= threshold < BITS:
        raise ValueError("threshold must be between 0 and 63")
    n = distinct.count() if n is None else n
    if in_squares(threshold, n):
        parallelism = distinct.sparkSession.sparkContext.defaultParallelism
        return squares(distinct, threshold, emit, schema, parts_of(n, parallelism, tile or PART_ROWS))
    tile = tile or TILE
    chunks = chunking(threshold, n)
    masks = [(np.uint64(c.mask), c.radius) for c in chunks]

    def compare(batches):
        for table, firsts in whole_groups(batches, ["chunk", "key", "a", "b"]):
            number, probe, h, order = (table.column(c).to_numpy() for c in ("chunk", "probe", "h", "ord"))
            bits = h.view(np.uint64)

            def pairs():
                for a, b in products(probe == 0, firsts):
                    fit = order[a] < order[b]
                    a, b = a[fit], b[fit]
                    apart = bits[a] ^ bits[b]
                    distance = np.bitwise_count(apart)
                    fit = distance <= threshold
                    a, b, apart, distance = a[fit], b[fit], apart[fit], distance[fit]
                    fit = np.ones(len(a), bool)
                    for k, (mask, radius) in enumerate(masks[:-1]):
                        fit &= (number[a] <= k) | (np.bitwise_count(apart & mask) > radius)
                    yield a[fit], b[fit], distance[fit]

            yield from emit(order, pairs())

    return tiled(filed(distinct, chunks), tile).mapInArrow(compare, schema)


def pairs_within(distinct: DataFrame, threshold: int, tile: int | None = None) -> DataFrame:
    """``a, b, distance``: every pair of hashes within the threshold once, ``a < b`` by ``ord``."""

    def emit(order, pairs):
        for a, b, distance in pairs:
            columns = [pa.array(order[a]), pa.array(order[b]), pa.array(distance.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "distance"])

    return near_pairs(distinct, threshold, emit, "a long, b long, distance int", tile=tile)


def linking_edges(distinct: DataFrame, threshold: int, tile: int | None = None) -> DataFrame:
    """``a, b``: pairs within the threshold that connect what all such pairs connect.

    Of the pairs that a task finds among the rows it holds only a star over each connected set leaves it, so a dense
    cluster never has its pairs written out.
    """

    def emit(order, pairs):
        ids, place = np.unique(order, return_inverse=True)
        label = np.arange(len(ids))
        for a, b, _ in pairs:
            label = linked(label, place[a], place[b])
        moved = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[label[moved]]), pa.array(ids[moved])], ["a", "b"])

    return near_pairs(distinct, threshold, emit, "a long, b long", tile=tile).distinct()


def linked(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each connected set, after links ``a, b`` are added to the sets of ``label``."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low, high = np.minimum(x, y), np.maximum(x, y)
        label = label.copy()
        np.minimum.at(label, high, low)
        while (jumped := label[label]).tobytes() != label.tobytes():
            label = jumped
