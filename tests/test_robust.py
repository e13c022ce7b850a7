"""One bad row or an odd name must neither end a job nor vanish."""

import struct

import pyspark.sql.functions as F
import pytest

from lumaforge.functions import geometry, templates, validation
from lumaforge.operators import neighborhood
from lumaforge.operators import pointwise as pw
from lumaforge.operators.catalog import assets_from_pixels
from lumaforge.operators.registry import OPERATORS, Operator, OperatorError
from lumaforge.plans import recipe_run, steps
from lumaforge.plans.duplicates import find_duplicates
from lumaforge.sources import images, tagscan
from lumaforge.sources.headers import header
from lumaforge.streaming.arrivals import run_on_arrivals, watch_images

from conftest import png_bytes

NAMES = ["plain.png", "my photo.png", "100%.png", "a+b.png", "c#d.png", "café.png"]


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for i, name in enumerate(NAMES):
        rows = [[(i * 40 + x * 9 + y) % 256 for x in range(3 * 4)] for y in range(4)]
        (root / name).write_bytes(png_bytes(rows, 3))
    (root / "broken file.png").write_bytes(b"no image")
    (root / "notes.txt").write_text("not an image file")
    return root


def test_every_file_is_an_asset_or_rejected(spark, folder):
    webp = b"VP8X" + struct.pack("<I", 10) + b"\x10\0\0\0" + (319).to_bytes(3, "little") + (199).to_bytes(3, "little")
    (folder / "sound.webp").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(webp)) + b"WEBP" + webp)
    assets, rejected = images.load_assets(images.scan(spark, str(folder)))
    assert sorted(r.path.rsplit("/", 1)[1] for r in assets.collect()) == sorted([*NAMES, "sound.webp"])
    assert [r.path.rsplit("/", 1)[1] for r in rejected.collect()] == ["broken file.png"]
    decoded, undecoded = images.split_decoded(images.load_images(spark, str(folder)))
    assert sorted(r.path.rsplit("/", 1)[1] for r in decoded.collect()) == sorted(NAMES)
    assert {r.path.rsplit("/", 1)[1]: r.error for r in undecoded.collect()} == {
        "broken file.png": "cannot identify image file", "sound.webp": "no decoder for this format",
    }


def test_duplicates_with_odd_names(spark, folder):
    (folder / "copy of plain.png").write_bytes((folder / "plain.png").read_bytes())
    groups, _ = find_duplicates(spark, str(folder), 0)
    assert {"plain.png", "copy of plain.png"} <= {r.path.rsplit("/", 1)[1] for r in groups.collect()}


def test_unreadable_arrivals_are_recorded(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    run_on_arrivals(watch_images(spark, str(folder)), lambda px: px, out, str(tmp_path / "ckpt")).awaitTermination()
    bad = spark.read.parquet(f"{out}-rejected").collect()
    assert [r.path.rsplit("/", 1)[1] for r in bad] == ["broken file.png"]


def test_arrivals_left_without_pixels_are_recorded(spark, folder, tmp_path):
    out = str(tmp_path / "cropped")
    narrow = [[9, 9, 9]]
    (folder / "narrow.png").write_bytes(png_bytes(narrow, 3))
    run_on_arrivals(watch_images(spark, str(folder)), lambda px: pw.crop(px, x=2), out, str(tmp_path / "ckpt2")).awaitTermination()
    bad = {r.path.rsplit("/", 1)[1]: r.error for r in spark.read.parquet(f"{out}-rejected").collect()}
    assert bad == {"broken file.png": "cannot identify image file", "narrow.png": "no pixels left after the run"}
    assert {(r.w, r.h) for r in spark.read.parquet(out).select("w", "h").distinct().collect()} == {(2, 4)}


def test_half_written_arrivals_are_read_again(spark, tmp_path):
    """One file is completed before its second try, one is removed, one stays broken until its tries are used up."""
    files, out = tmp_path / "in", str(tmp_path / "out")
    files.mkdir()
    whole = png_bytes([[1, 2, 3, 4, 5, 6]], 3)

    def arrive(name, content):
        (files / name).write_bytes(content)
        query = run_on_arrivals(watch_images(spark, str(files)), lambda px: px, out, str(tmp_path / "ckpt"), tries=3)
        query.awaitTermination()

    def names(folder):
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(folder).collect())

    (files / "late [1].png").write_bytes(whole[:20])
    (files / "gone.png").write_bytes(b"x")
    arrive("broken.png", whole[:9])
    assert names(f"{out}-waiting/batch=0") == ["broken.png", "gone.png", "late [1].png"] and not names(f"{out}-rejected")
    (files / "late [1].png").write_bytes(whole)
    (files / "gone.png").unlink()
    arrive("second.png", whole)
    assert spark.read.parquet(f"{out}/batch=1").select("img_id").distinct().count() == 2
    assert names(f"{out}-waiting/batch=1") == ["broken.png", "gone.png"]
    arrive("third.png", whole)
    assert spark.read.parquet(out).count() == 3 * 2 and not names(f"{out}-waiting/batch=2")
    assert names(f"{out}-rejected") == ["broken.png", "gone.png"]


def test_images_lost_by_an_operator_are_found_from_the_run(spark, tmp_path):
    """The counts of the run say that images are missing, though no step was expected to fail."""
    px = pixels(spark, (3, 3)).unionByName(pixels(spark, (3, 3)).withColumn("img_id", F.col("img_id") + 1))
    ids = [r.img_id for r in px.select("img_id").distinct().orderBy("img_id").collect()]
    catalog = spark.createDataFrame([(i, f"/p/{i}.png") for i in [*ids, 99]], "asset_id long, path string")
    drop = Operator("drop_first", "Drop", lambda p: p.where(F.col("img_id") != ids[0]), {})
    OPERATORS.register(drop)
    try:
        got = steps.run_to_folder(catalog, px, [{"name": "drop_first"}], str(tmp_path / "run"))
    finally:
        OPERATORS.unregister("drop_first")
    assert {r.asset_id: r.error for r in got.collect()} == {
        ids[0]: "no pixels left after the run", **{i: None for i in ids[1:]}, 99: "image has no pixels",
    }
    assert {(r.img_id, r.w, r.h) for r in pw.outside_crop(px, x=3).collect()} == {(i, 3, 3) for i in ids}


def test_cut_off_resource_segment_costs_nothing_else():
    body = b"Photoshop 3.0\0" + b"8BIM\x04"
    segment = b"\xff\xed" + struct.pack(">H", len(body) + 2) + body
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x0100, 3, 1, 7) + struct.pack("<I", 0)
    exif = b"Exif\0\0" + tiff
    data = b"\xff\xd8" + segment + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xd9"
    assert tagscan.iptc_rows(data) == []
    assert [(tag, number) for _, tag, _, number, _ in tagscan.exif_rows(data)] == [(0x0100, 7)]


def test_sizes_without_pixels(spark):
    rows = spark.createDataFrame([(10, 0), (0, 10), (10, 5)], "w int, h int")
    w, h = F.col("w"), F.col("h")
    fit = rows.select(geometry.fit_size(w, h, 5, 5).alias("f")).collect()
    assert [r.f.error for r in fit] == ["Image has no pixels"] * 2 + [None] and (fit[2].f.width, fit[2].f.height) == (5, 2)
    target = rows.select(geometry.resize_target(w, h, 4)["h"].alias("h")).collect()
    assert target[2].h == 2


def test_color_component_beyond_integers(spark):
    rows = spark.createDataFrame([([1e12, 0.0, 0.0],), ([1.0, 2.0, 3.0],)], "c array<double>")
    found = [str(r[0]) for r in rows.select(validation.color_value(F.col("c"), F.lit("RGB"))).collect()]
    assert "out of range" in found[0] and "out of range" not in found[1]


def test_template_overflow_is_an_error_of_its_row(spark):
    assets = spark.createDataFrame([(1, 10), (2, 4_000_000_000)], "asset_id long, width long")
    for expression in ("width*width*width", "width**9", "width+width"):
        rows = templates.render(assets, f"<{expression}>", {"width": F.col("width")}).orderBy("asset_id").collect()
        assert rows[0].rendered == str(eval(expression, {"width": 10}))
        assert expression == "width+width" or rows[1].rendered is None


@pytest.mark.parametrize("word,size", [("yes", (4, 4)), ("on", (4, 4)), ("1", (4, 4)), ("true", (4, 4)), ("no", (4, 2)), ("false", (4, 2))])
def test_flag_words_of_the_prediction(spark, word, size):
    actions = steps.actions_literal([{"name": "resize", "parameters": {"width": 4, "height": 2, "maintain_aspect": word}}])
    last = spark.range(1).select(steps.size_after(actions, F.lit(9), F.lit(9))[0].alias("s")).first().s
    assert (last.w, last.h) == size
    kept = spark.range(1).select(validation.relevant_parameters(F.lit("resize"), actions[0]["parameters"]).alias("p")).first().p
    assert ("height" in kept) == (size == (4, 2))


def pixels(spark, *sizes):
    rows = [(i, w, h, x, y, 9, 9, 9) for i, (w, h) in enumerate(sizes) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "img_id long, w int, h int, x int, y int, r int, g int, b int")


def test_a_failing_image_stops_nothing_and_is_reported(spark):
    px = pixels(spark, (8, 8), (2, 2), (300, 1))
    catalog = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "asset_id long, path string")
    actions = [{"name": "crop", "parameters": {"x": 5, "y": 0}}, {"name": "resize", "parameters": {"width": 1}}, {"name": "sepia"}]
    out, outcomes, trail = steps.run_with_outcomes(catalog, px, actions)
    got = {r.path: r.error for r in outcomes.collect()}
    assert got == {
        "a": None, "b": "step 1 (crop) leaves no pixels", "c": "step 2 (resize) leaves no pixels", "d": "image has no pixels",
    }
    assert {r.img_id for r in out.collect()} == {0} == {r.img_id for r in trail.collect()}
    assert {r.status: r.n for r in steps.batch_summary(outcomes).collect()} == {"successful": 1, "failed": 3}


def test_catalog_rows_without_pixels_stay(spark):
    catalog = spark.createDataFrame(
        [(0, 5, 5, "L", 72, 72), (1, 7, 7, "RGB", None, None)], "asset_id long, width int, height int, mode string, dpi_x int, dpi_y int"
    )
    rows = {r.asset_id: r for r in assets_from_pixels(catalog, pixels(spark, (3, 2))).collect()}
    assert (rows[0].width, rows[0].height, rows[0].mode) == (3, 2, "L") and (rows[1].width, rows[1].mode) == (7, "RGB")


def test_letters_without_glyph_are_drawn(spark):
    px = pixels(spark, (120, 60))
    blank = neighborhood.watermark(px, F.lit("   ")).where("r != 9").count()
    assert blank == 0
    for letter in "é©,&+!":
        assert neighborhood.watermark(px, F.lit(letter)).where("r != 9").count() > 0


def full_catalog(spark, *paths):
    from lumaforge.schemas import EXIF_TYPE, IPTC_TYPE

    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "asset_id long, path string")
    return rows.select(
        "asset_id", "path", F.lit("PNG").alias("format"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit("RGB").alias("mode"),
        F.lit(0).cast("long").alias("size_bytes"), F.lit(72).alias("dpi_x"), F.lit(72).alias("dpi_y"),
        F.lit(None).cast("string").alias("color_profile"), F.lit(None).cast("string").alias("original_path"),
        F.lit(None).cast(EXIF_TYPE).alias("exif"), F.lit(None).cast(IPTC_TYPE).alias("iptc"),
    )


def test_a_list_with_pixel_and_metadata_steps(spark, tmp_path):
    catalog, px = full_catalog(spark, "/p/one.png", "/p/two.png"), pixels(spark, (8, 8), (8, 8))
    out = recipe_run.run_recipe(catalog, px, [
        {"name": "resize", "parameters": {"width": 120, "height": 60, "maintain_aspect": "no"}},
        {"name": "watermark", "parameters": {"text": "<filename>", "opacity": 100}},
        {"name": "write_metadata", "parameters": {"title": "Photo <filename>", "creator": "me"}},
        {"name": "extract_metadata", "parameters": {"format": "json"}},
        {"name": "save", "parameters": {"folder": str(tmp_path / "out")}},
        {"name": "sepia", "enabled": False},
    ])
    rows = {r.asset_id: r for r in out.catalog.collect()}
    assert (rows[0].width, rows[0].height) == (120, 60) and "Photo one" in str(rows[0].iptc) and "Photo two" in str(rows[1].iptc)
    report = out.reports[0].collect()
    assert len(report) == 2 and any("Photo one" in str(r) for r in report)
    saved = spark.read.parquet(out.saved[0])
    assert saved.count() == 2 * 120 * 60
    marked = {r.img_id: r.n for r in out.pixels.where("r != 9").groupBy("img_id").agg(F.count("*").alias("n")).collect()}
    assert set(marked) == {0, 1} and marked[0] != marked[1]


def test_a_failing_image_leaves_a_list_with_metadata_steps_with_its_message(spark, tmp_path):
    catalog, px = full_catalog(spark, "/p/one.png", "/p/small.png", "/p/flat.png", "/p/none.png"), pixels(spark, (8, 8), (2, 2), (300, 1))
    out = recipe_run.run_recipe(catalog, px, [
        {"name": "write_metadata", "parameters": {"title": "<filename>"}}, {"name": "crop", "parameters": {"x": 5, "y": 0}},
        {"name": "resize", "parameters": {"width": 1}}, {"name": "extract_metadata"}, {"name": "save", "parameters": {"folder": str(tmp_path / "out")}},
    ])
    assert {r.path: r.message for r in out.failed.collect()} == {
        "/p/small.png": "step 2 (crop) leaves no pixels", "/p/flat.png": "step 3 (resize) leaves no pixels", "/p/none.png": "image has no pixels",
    }
    assert [r.path for r in out.catalog.collect()] == ["/p/one.png"] and out.reports[0].count() == 1
    assert {r.img_id for r in out.pixels.collect()} == {0} == {r.img_id for r in spark.read.parquet(out.saved[0]).collect()}
    marked = recipe_run.run_recipe(catalog, px, [{"name": "write_metadata", "parameters": {"title": "<filename>"}}])
    assert marked.failed.isEmpty() and marked.catalog.count() == 4
    assert recipe_run.run_recipe(catalog, px, []).pixels.count() == px.count()
    unlisted = recipe_run.run_recipe(catalog.where("asset_id = 0"), px, [{"name": "crop", "parameters": {"x": 5}}])
    assert [(r.asset_id, r.path) for r in unlisted.failed.collect()] == [(1, None)]
    copied = recipe_run.run_recipe(marked.catalog, px, [
        {"name": "crop", "parameters": {"x": 5, "y": 0}}, {"name": "copy_metadata", "parameters": {"source_path": "/p/small.png"}},
    ])
    assert {r.path: "small" in str(r.iptc) for r in copied.catalog.collect()} == {"/p/one.png": True, "/p/flat.png": True}


def test_copy_and_remove_steps(spark):
    catalog, px = full_catalog(spark, "/p/one.png", "/p/two.png"), pixels(spark, (8, 8), (8, 8))
    first = recipe_run.run_recipe(catalog, px, [{"name": "write_metadata", "parameters": {"title": "<filename>"}}]).catalog
    copied = recipe_run.run_recipe(first, px, [{"name": "copy_metadata", "parameters": {"source_path": "/p/one.png"}}]).catalog
    assert {"one" in str(r.iptc) for r in copied.collect()} == {True}
    cleared = recipe_run.run_recipe(copied, px, [{"name": "remove_metadata", "parameters": {"metadata_type": "iptc"}}]).catalog
    assert {r.iptc for r in cleared.collect()} == {None}


def test_recipes_are_checked_before_they_run(spark):
    catalog, px = full_catalog(spark, "/p/one.png"), pixels(spark, (8, 8))
    for bad in ({"name": "nothing"}, {"name": "copy_metadata"}, {"name": "extract_metadata", "parameters": {"format": "xls"}}):
        with pytest.raises(OperatorError):
            recipe_run.run_recipe(catalog, px, [bad])


def test_resolution_and_sizes_come_from_the_header(spark, folder):
    import zlib

    body = b"pHYs" + struct.pack(">IIB", 11811, 11811, 1)
    plain = (folder / "plain.png").read_bytes()
    (folder / "plain.png").write_bytes(plain[:33] + struct.pack(">I", 9) + body + struct.pack(">I", zlib.crc32(body)) + plain[33:])
    webp = b"VP8X" + struct.pack("<I", 10) + b"\x10\0\0\0" + (319).to_bytes(3, "little") + (199).to_bytes(3, "little")
    (folder / "new.webp").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(webp)) + b"WEBP" + webp)
    assets, _ = images.load_assets(images.scan(spark, str(folder)))
    rows = {r.path.rsplit("/", 1)[1]: r for r in assets.collect()}
    assert (rows["plain.png"].dpi_x, rows["my photo.png"].dpi_x) == (300, 72)
    assert (rows["new.webp"].width, rows["new.webp"].height, rows["new.webp"].mode, rows["new.webp"].format) == (320, 200, "RGBA", "WEBP")
    frame = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1\2" + struct.pack(">HH", 100, 50) + b"\0\0\xff\xc0" + struct.pack(">HBHHB", 17, 8, 30, 40, 3)
    assert header(frame) == (40, 30, "RGB", 254, 127)
    assert header(frame[:24]) == header(b"") == header(None) == header(b"\x89PNG\r\n\x1a\n") == (None,) * 5
