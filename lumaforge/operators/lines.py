"""Filters over a neighborhood of any size, on strips of lines as arrays.

Pixels are packed into one number, dealt by strip of lines with the lines around it copied along, and collected to one
row per line; that is the only shuffle. A task then sees a strip as an array, strips of one shape side by side, and
returns its pixels. A strip is as high as the copies around it at least, so a line is copied to three strips at most.

The blur adds shifted lines up, or multiplies spectra where the kernel is wide; the median sorts small windows and
counts, level by level, with running sums in large ones. Either way the cost of a pixel does not grow with
the radius beyond a bound, and all results are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaforge.functions.color import CHANNELS
from lumaforge.operators.batches import whole_groups
from lumaforge.operators.pointwise import STRIP_ROWS

FIXED_POINT = 1 << 20
#: Pixels that are filtered at once.
AT_ONCE = 1 << 18
#: Kernels that reach further are applied by spectra.
SPECTRAL_REACH = 24
#: Windows above this size are counted, not sorted.
SORTED_SIZE = 7

#: Takes strips (number, line, x, channel) with the lines around them, and returns the strips filtered.
Filter = Callable[[np.ndarray], np.ndarray]


def packed_lines(px: DataFrame, reach: int) -> tuple[DataFrame, int]:
    """``img_id, w, h, strip, y, line`` with one row per line and strip, sorted, and the height of strips."""
    height = max(STRIP_ROWS, 2 * reach)
    first, last = f"greatest(0, y - {reach}) div {height}", f"least(h - 1, y + {reach}) div {height}"
    pixel = "shiftleft(cast(x AS bigint), 24) | shiftleft(cast(r AS bigint), 16) | shiftleft(cast(g AS bigint), 8) | cast(b AS bigint)"
    dealt = px.selectExpr(
        "img_id", "cast(w AS int) AS w", "cast(h AS int) AS h", "cast(y AS int) AS y", f"{pixel} AS pixel",
        f"explode(sequence(cast({first} AS int), cast({last} AS int))) AS strip",
    )
    lines = dealt.repartition("img_id", "strip").groupBy("img_id", "strip", "w", "h", "y").agg(F.collect_list("pixel").alias("line"))
    return lines.sortWithinPartitions("img_id", "strip", "y"), height


def filtered(px: DataFrame, reach: int, run: Filter) -> DataFrame:
    """Apply a filter that looks at up to ``reach`` lines above and below; positions outside repeat the edge.

    A pixel table holds every pixel of its images. The alpha channel is not kept.
    """
    order = [c for c in px.columns if c != "a"]
    lines, height = packed_lines(px, reach)

    def strips(batches):
        for table, firsts in whole_groups(batches, ["img_id", "strip"]):
            yield from _filter_table(table, firsts, height, reach, run)

    kind = px.schema["img_id"].dataType.simpleString()
    found = lines.mapInArrow(strips, f"img_id {kind}, w int, h int, x int, y int, r int, g int, b int")
    return found.select(*[F.col(c).cast(px.schema[c].dataType).alias(c) for c in order])


def _filter_table(table: pa.Table, firsts: np.ndarray, height: int, reach: int, run: Filter) -> Iterator[pa.RecordBatch]:
    w, h, strip, y = (table.column(c).to_numpy() for c in ("w", "h", "strip", "y"))
    lists = table.column("line").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    pixels = lists.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.append(firsts[1:], table.num_rows)
    shapes, kind = np.unique(np.column_stack([w[firsts], h[firsts], strip[firsts]]), axis=0, return_inverse=True)
    kind = kind.ravel()
    for k, (wide, high, number) in enumerate(shapes.tolist()):
        top, bottom = number * height, min(high, (number + 1) * height)
        low = max(0, top - reach)
        lines = min(high, bottom + reach) - low
        # Which line stands at each place of the strip and around it.
        around = np.clip(np.arange(top - reach, bottom + reach), 0, high - 1) - low
        groups = np.flatnonzero(kind == k)
        step = max(1, AT_ONCE // (lines * wide))
        for at in range(0, len(groups), step):
            some = groups[at : at + step]
            rows, own = _ranges(firsts[some], ends[some] - firsts[some])
            cells, line = _ranges(starts[rows], sizes[rows])
            found = pixels[cells]
            strips = np.zeros((len(some), lines, wide, len(CHANNELS)), np.uint8)
            strips[own[line], (y[rows] - low)[line], found >> 24] = np.stack([(found >> 16) & 255, (found >> 8) & 255, found & 255], 1)
            out = run(strips[:, around])
            shape = out.shape[:3]
            ids = table.column("img_id").take(pa.array(np.repeat(firsts[some], shape[1] * shape[2]))).combine_chunks()
            x = np.broadcast_to(np.arange(wide, dtype=np.int32), shape).ravel()
            rows = np.broadcast_to(np.arange(top, bottom, dtype=np.int32)[None, :, None], shape).ravel()
            columns = [ids, np.full(len(x), wide, np.int32), np.full(len(x), high, np.int32), x, rows]
            columns += [out[..., c].astype(np.int32).ravel() for c in range(3)]
            names = ["img_id", "w", "h", "x", "y", "r", "g", "b"]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else pa.array(c) if isinstance(c, np.ndarray) else c for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges in a row, and which range each belongs to."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    before = np.cumsum(sizes) - sizes
    return np.arange(len(own)) + (starts - before)[own], own


# --- blur ---------------------------------------------------------------------------------------


def gaussian_weights(radius: float) -> list[int]:
    """Fixed-point weights for distances ``0..ceil(3 * radius)``."""
    reach = math.ceil(3 * radius)
    return [math.floor(math.exp(-d * d / (2.0 * radius * radius)) * FIXED_POINT + 0.5) for d in range(reach + 1)]


def weighted_sums(values: np.ndarray, weights: list[int], axis: int) -> np.ndarray:
    """Exact sums along an axis, shorter by the kernel's reach at both ends."""
    reach = len(weights) - 1
    size = values.shape[axis] - 2 * reach

    def shifted(d: int) -> np.ndarray:
        return np.take(values, range(reach + d, reach + d + size), axis).astype(np.int64)

    if reach <= SPECTRAL_REACH:
        out = weights[0] * shifted(0)
        for d in range(1, reach + 1):
            out += weights[d] * (shifted(d) + shifted(-d))
        return out
    # Sums stay far below 2**53 and the rounding of the transforms far below one half, so rounding restores them.
    kernel = np.array(weights[:0:-1] + weights, np.float64)
    length = 1 << (values.shape[axis] - 1).bit_length()
    shape = [1] * values.ndim
    shape[axis] = length // 2 + 1
    spectrum = np.fft.rfft(values, length, axis) * np.fft.rfft(kernel, length).reshape(shape)
    # Places that wrap around are those before the kernel fits, which are not asked for.
    full = np.fft.irfft(spectrum, length, axis)
    return np.rint(np.take(full, range(2 * reach, 2 * reach + size), axis)).astype(np.int64)


def _rounded(total: np.ndarray, weight: int) -> np.ndarray:
    return np.clip((2 * total + weight) // (2 * weight), 0, 255).astype(np.uint8)


def gaussian_blur(px: DataFrame, radius: float) -> DataFrame:
    """Two separable passes cut at three sigma; positions outside the image repeat the edge."""
    if radius <= 0:
        return px
    weights = gaussian_weights(radius)
    reach, total = len(weights) - 1, weights[0] + 2 * sum(weights[1:])

    def run(strips: np.ndarray) -> np.ndarray:
        wide = np.pad(strips, ((0, 0), (0, 0), (reach, reach), (0, 0)), "edge")
        return _rounded(weighted_sums(_rounded(weighted_sums(wide, weights, 2), total), weights, 1), total)

    return filtered(px, reach, run)


# --- median -------------------------------------------------------------------------------------


def window_median(padded: np.ndarray, size: int) -> np.ndarray:
    """Middle value of each ``size`` x ``size`` window of (number, line, x, channel)."""
    lines, wide = padded.shape[1] - size + 1, padded.shape[2] - size + 1
    middle = size * size // 2
    if size <= SORTED_SIZE:
        stack = np.stack([padded[:, i : i + lines, j : j + wide] for i in range(size) for j in range(size)])
        return np.partition(stack, middle, axis=0)[middle]
    out = np.zeros((len(padded), lines, wide, padded.shape[3]), np.uint8)
    open_ = np.ones(out.shape, bool)
    sums = np.zeros((padded.shape[0], padded.shape[1] + 1, padded.shape[2] + 1, padded.shape[3]), np.int32)
    for level in np.unique(padded).tolist():
        # The running histogram: how many values of each window are at this level or below.
        np.cumsum(padded <= level, axis=1, out=sums[:, 1:, 1:])
        np.cumsum(sums[:, 1:, 1:], axis=2, out=sums[:, 1:, 1:])
        below = sums[:, size:, size:] - sums[:, :-size, size:] - sums[:, size:, :-size] + sums[:, :-size, :-size]
        now = open_ & (below > middle)
        out[now] = level
        open_ &= ~now
        if not open_.any():
            break
    return out


def median_filter(px: DataFrame, size: int = 3) -> DataFrame:
    """Median of a size x size window clamped to the edge; an even size counts as the next odd one."""
    reach = size // 2

    def run(strips: np.ndarray) -> np.ndarray:
        wide = np.pad(strips, ((0, 0), (0, 0), (reach, reach), (0, 0)), "edge")
        # Windows of some lines at a time, so that the sorted stack stays small.
        step = max(1, AT_ONCE // max(1, wide.shape[0] * wide.shape[2] * min(2 * reach + 1, SORTED_SIZE)))
        step = max(step, 2 * reach)
        lines = wide.shape[1] - 2 * reach
        parts = [window_median(wide[:, at : min(at + step, lines) + 2 * reach], 2 * reach + 1) for at in range(0, lines, step)]
        return np.concatenate(parts, axis=1)

    return filtered(px, reach, run)
