"""Pixel operators on odd shapes, against plain Python."""

import math
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaforge.operators import lines
from lumaforge.operators import neighborhood as nb
from lumaforge.operators import pointwise as pw
from lumaforge.operators import skew
from lumaforge.operators.ranking import number_within


def image(spark, w, h, img_id=1):
    cells = [(img_id, w, h, x, y, (x * 37 + y * 11) % 256, (x * y * 7) % 256, (255 - x * 5 - y) % 256)
             for y in range(h) for x in range(w)]
    schema = "img_id bigint, w int, h int, x int, y int, r int, g int, b int"
    return spark.createDataFrame(cells, schema), {(c[3], c[4]): c[5:] for c in cells}


def collected(df):
    rows = df.collect()
    out = {(r.x, r.y): (r.r, r.g, r.b) for r in rows}
    assert len(out) == len(rows)
    w, h = rows[0].w, rows[0].h
    assert {(r.w, r.h) for r in rows} == {(w, h)}
    assert set(out) == {(x, y) for x in range(w) for y in range(h)}
    return w, h, out


def clamp(v):
    return int(max(0, min(255, math.floor(v))))


@pytest.mark.parametrize("w,h,radius", [(1, 1, 1.5), (1, 5, 1.5), (7, 2, 1.5), (3, 200, 1.5), (40, 30, 12.0), (3, 230, 15.0)])
def test_blur_small_and_thin_images(spark, w, h, radius):
    """The last two are wide enough for spectra."""
    px, src = image(spark, w, h)
    weights = nb.gaussian_weights(radius)
    reach = len(weights) - 1

    def axis(get, n, at):
        s = t = 0
        for d in range(-reach, reach + 1):
            s += weights[abs(d)] * get(max(0, min(n - 1, at + d)))
            t += weights[abs(d)]
        return clamp((2 * s + t) / (2.0 * t))

    _, _, got = collected(nb.gaussian_blur(px, radius))
    for k in range(3):
        mid = {(x, y): axis(lambda i: src[(i, y)][k], w, x) for x in range(w) for y in range(h)}
        for x, y in src:
            assert got[(x, y)][k] == axis(lambda i: mid[(x, i)], h, y)


@pytest.mark.parametrize("w,h", [(1, 1), (2, 3), (5, 4), (3, 140)])
@pytest.mark.parametrize("size", [3, 5, 9])
def test_median(spark, w, h, size):
    px, src = image(spark, w, h)
    reach = size // 2
    _, _, got = collected(nb.median_filter(px, size))
    for x, y in src:
        around = [src[(max(0, min(w - 1, x + i)), max(0, min(h - 1, y + j)))]
                  for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
        assert got[(x, y)] == tuple(sorted(p[k] for p in around)[(size * size + 1) // 2 - 1] for k in range(3))


def test_windows_by_sorting_and_by_counting_agree(monkeypatch):
    values = np.random.default_rng(1).integers(0, 256, (2, 40, 30, 3)).astype(np.uint8)
    sorted_ = {size: lines.window_median(values, size) for size in (3, 5, 7)}
    monkeypatch.setattr(lines, "SORTED_SIZE", 1)
    for size, want in sorted_.items():
        assert (lines.window_median(values, size) == want).all()


def test_spectra_give_the_exact_sums(monkeypatch):
    values = np.random.default_rng(2).integers(0, 256, (1, 700, 9, 3)).astype(np.uint8)
    for radius in (0.3, 4, 30, 80):
        weights = nb.gaussian_weights(radius)
        monkeypatch.setattr(lines, "SPECTRAL_REACH", 10**6)
        plain = lines.weighted_sums(values, weights, 1)
        monkeypatch.setattr(lines, "SPECTRAL_REACH", 0)
        assert (lines.weighted_sums(values, weights, 1) == plain).all()


def test_many_images_of_several_shapes_at_once(spark):
    """Each image is filtered as if it were alone, whatever shares its batch."""
    shapes = [(4, 3), (4, 3), (2, 130), (5, 1)]
    frames = [image(spark, w, h, img_id=k)[0].withColumn("r", (F.col("r") + 40 * k) % 256) for k, (w, h) in enumerate(shapes)]
    together = reduce(DataFrame.unionByName, frames)
    for run in (lambda p: nb.gaussian_blur(p, 2.0), lambda p: nb.median_filter(p, 3)):
        want = sorted(tuple(r) for f in frames for r in run(f).collect())
        assert sorted(tuple(r) for r in run(together).collect()) == want


@pytest.mark.parametrize("w,h", [(1, 1), (2, 5), (5, 4), (4, 135)])
def test_sharpen(spark, w, h):
    px, src = image(spark, w, h)
    _, _, got = collected(nb.sharpen(px, 0.5))
    for (x, y), v in src.items():
        if x in (0, w - 1) or y in (0, h - 1):
            assert got[(x, y)] == v
            continue
        near = [src[(x + i, y + j)] for i in (-1, 0, 1) for j in (-1, 0, 1)]
        full = [clamp((34 * v[k] - 2 * sum(p[k] for p in near)) / 16 + 0.5) for k in range(3)]
        assert got[(x, y)] == tuple(clamp(a + 0.5 * (b - a)) for a, b in zip(v, full))


@pytest.mark.parametrize("angle", [0, 30, 45, 90, -133.7, 180, 270])
@pytest.mark.parametrize("expand", [False, True])
def test_rotation_covers_canvas_once(spark, angle, expand):
    w, h = 9, 5
    px, src = image(spark, w, h)
    cw, ch, got = collected(nb.rotate(px, angle, expand, (1, 2, 3)))
    if not expand:
        assert (cw, ch) == (w, h)
    cos, sin = nb._trig(angle)
    for (x, y), v in got.items():
        dx, dy = x + 0.5 - cw / 2, y + 0.5 - ch / 2
        at = (math.floor(cos * dx - sin * dy + w / 2), math.floor(sin * dx + cos * dy + h / 2))
        assert v == src.get(at, (1, 2, 3))


@pytest.mark.parametrize("kernel", ["NEAREST", "BILINEAR", "BICUBIC", "LANCZOS"])
def test_resize_keeps_flat_color_and_shape(spark, kernel):
    px, _ = image(spark, 11, 6)
    flat = px.withColumns({"r": F.lit(200), "g": F.lit(3), "b": F.lit(255)})
    for tw, th in [(4, 9), (11, 6), (23, 1)]:
        w, h, got = collected(nb.resize(flat, tw, th, maintain_aspect=False, resample=kernel))
        assert (w, h) == (tw, th) and set(got.values()) == {(200, 3, 255)}


def test_resize_same_size_is_identity(spark):
    px, src = image(spark, 6, 4)
    for kernel in ("NEAREST", "BILINEAR", "BICUBIC", "LANCZOS"):
        assert collected(nb.resize(px, 6, 4, maintain_aspect=False, resample=kernel))[2] == src


def test_resize_keeps_aspect(spark):
    px, _ = image(spark, 8, 6)
    assert collected(nb.resize(px, width=4))[:2] == (4, 3)


def test_contrast_over_many_strips(spark):
    px, src = image(spark, 3, 200)
    luma = [(19595 * r + 38470 * g + 7471 * b + 32768) >> 16 for r, g, b in src.values()]
    m = math.floor((2 * sum(luma) + len(luma)) / (2.0 * len(luma)))
    _, _, got = collected(pw.contrast(px, 1.5))
    assert got == {at: tuple(clamp(m + 1.5 * (v - m)) for v in p) for at, p in src.items()}


def test_attach_per_image_keeps_rows_without_match(spark):
    px, _ = image(spark, 2, 130)
    other, _ = image(spark, 2, 3, img_id=2)
    names = spark.createDataFrame([(1, "one")], "img_id bigint, name string")
    got = pw.attach_per_image(px.unionByName(other), names).groupBy("img_id", "name").count().collect()
    assert {(r.img_id, r["name"], r["count"]) for r in got} == {(1, "one", 260), (2, None, 6)}


def test_transpose_rejects_unknown(spark):
    with pytest.raises(ValueError):
        pw.transpose(image(spark, 2, 2)[0], "sideways")


def test_levels_identity_and_sepia_off(spark):
    px, src = image(spark, 4, 4)
    assert collected(pw.levels(px))[2] == src
    assert collected(pw.sepia(px, 0.0))[2] == src
    assert collected(pw.hue(px, 0))[2].keys() == src.keys()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot", [2, 1000])
def test_join_counted_equals_plain_join(spark, how, hot):
    big = spark.range(100).selectExpr("id", "if(id < 40, 0, id % 13) AS k")
    small = big.groupBy("k").count().where("k % 2 = 0").withColumn("v", F.col("k") * 10)
    want = sorted(map(tuple, big.join(small.drop("count"), ["k"], how).collect()), key=repr)
    got = skew.join_counted(big, small, ["k"], "count", how, hot_rows=hot)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_numbering_spreads_one_large_group(spark):
    df = spark.range(5000).selectExpr("'all' AS parent", "format_string('%05d', (id * 7919) % 5000) AS path")
    rows = number_within(df, ["parent"], ["path"], "n").collect()
    assert sorted((r.n, r.path) for r in rows) == [(i + 1, f"{i:05d}") for i in range(5000)]


@pytest.mark.parametrize("batch", [3, 10000])
def test_numbering_of_groups_that_span_ranges(spark, batch):
    """Groups of one row, of many ranges, and null, in batches that cut them."""
    rows = [(None if i % 5 == 0 else "hot" if i % 5 < 4 else f"k{i % 11}", i * 7919 % 4001, f"x{i}") for i in range(4001)]
    df = spark.createDataFrame(rows, "k string, v int, _extra string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, number_within(df, ["k"], ["v"], "n").collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    seen, want = {}, []
    for k, v, extra in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, v, extra, seen[k]))
    assert got == sorted(want, key=repr)
    assert number_within(df.limit(0), ["k"], ["v"]).count() == 0
    assert sorted(r.row_no for r in number_within(df, [], ["v"]).collect()) == list(range(1, 4002))


@pytest.mark.parametrize("words", [0, 1 << 18])
@pytest.mark.parametrize("position", ["bottom_right", "center"])
def test_overlay_cells_by_word_or_by_join(spark, monkeypatch, words, position):
    """Cells beyond the declared size, repeated, null or off the image; equal to a plain loop."""
    monkeypatch.setattr(nb, "OVERLAY_WORDS", words)
    px = spark.range(100 * 70).selectExpr(
        "1L AS img_id", "100 AS w", "70 AS h", "int(id % 100) AS x", "int(id div 100) AS y",
        "int(id % 251) AS r", "int(id % 241) AS g", "int(id % 239) AS b", "255 AS a", "id AS ox",
    )
    cells = {(i * 37 % 90 - 5, i * 13 % 40 - 3) for i in range(700)}
    overlay = spark.createDataFrame([*cells, *list(cells)[:9], (None, 1)], "ox int, oy int")
    got = nb.alpha_composite(px, overlay, 60, 30, position, 0.5)
    assert got.columns == px.columns
    left, top = {"bottom_right": (100 - 60 - 10, 70 - 30 - 10), "center": (20, 20)}[position]
    changed = {(r.x, r.y) for r in got.collect() if r.r != r.ox % 251}
    assert changed == {(x + left, y + top) for x, y in cells if 0 <= x + left < 100 and 0 <= y + top < 70}
    assert got.count() == 7000 and [r.ox for r in got.orderBy("ox").limit(3).collect()] == [0, 1, 2]
    assert nb.alpha_composite(px, overlay.limit(0), 60, 30).count() == 7000
