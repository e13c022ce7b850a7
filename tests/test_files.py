"""Image files, tag blocks, recipes, the registry and streams."""

import json
import os
import struct

import pytest
from conftest import png_bytes
from pyspark.sql import functions as F

from lumaforge.operators import metadata
from lumaforge.operators import pointwise as pw
from lumaforge.operators.registry import OPERATORS, Operator, OperatorError, Param, Registry, run_steps
from lumaforge.plans.duplicates import find_duplicates
from lumaforge.plans.steps import run_with_lineage
from lumaforge.sources import images, png_sink, recipes, sinks, tagscan
from lumaforge.sources.headers import header
from lumaforge.streaming import arrivals


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "photos"
    (root / "sub").mkdir(parents=True)
    (root / "rgb.png").write_bytes(png_bytes([[250, 1, 2, 3, 4, 5], [6, 7, 8, 9, 10, 255]], 3))
    (root / "sub" / "alpha.PNG").write_bytes(png_bytes([[1, 2, 3, 128]], 4))
    (root / "gray.png").write_bytes(png_bytes([[0, 128, 255]], 1))
    (root / "broken.jpg").write_bytes(b"not an image")
    (root / "notes.txt").write_bytes(b"text")
    return str(root)


def name_of(path):
    return path.rsplit("/", 1)[-1]


def test_scan(spark, folder):
    assert {name_of(r.path) for r in images.scan(spark, folder).collect()} == {"rgb.png", "alpha.PNG", "gray.png", "broken.jpg"}
    assert {name_of(r.path) for r in images.scan(spark, folder, "*.png").collect()} == {"rgb.png", "gray.png"}


def test_pixels_and_quarantine(spark, folder):
    good, rejected = images.split_decoded(images.load_images(spark, folder))
    assert {name_of(r.path) for r in rejected.collect()} >= {"broken.jpg"}
    px = images.explode_pixels(good).join(
        good.select(images.image_id(F.col("path")).alias("img_id"), "path"), "img_id"
    )
    got = {(name_of(r.path), r.x, r.y): (r.r, r.g, r.b, r.a) for r in px.collect()}
    assert got == {
        ("rgb.png", 0, 0): (250, 1, 2, 255), ("rgb.png", 1, 0): (3, 4, 5, 255),
        ("rgb.png", 0, 1): (6, 7, 8, 255), ("rgb.png", 1, 1): (9, 10, 255, 255),
        ("alpha.PNG", 0, 0): (1, 2, 3, 128),
        ("gray.png", 0, 0): (0, 0, 0, 255), ("gray.png", 1, 0): (128, 128, 128, 255), ("gray.png", 2, 0): (255, 255, 255, 255),
    }


def test_load_assets(spark, folder):
    rows = images.load_assets(images.scan(spark, folder))[0].collect()
    got = {name_of(r.path): (r.format, r.width, r.height, r.mode, r.dpi_x) for r in rows}
    assert got == {
        "rgb.png": ("PNG", 2, 2, "RGB", 72), "alpha.PNG": ("PNG", 1, 1, "RGBA", 72), "gray.png": ("PNG", 3, 1, "L", 72),
    }


@pytest.mark.parametrize(
    "head,name",
    [(b"\xff\xd8\xff\xe0", "JPEG"), (b"RIFF\0\0\0\0WEBPVP8 ", "WEBP"), (b"II*\0", "TIFF"), (b"MM\0*", "TIFF"), (b"BM", "BMP"),
     (b"GIF89a", "GIF"), (b"hello", "UNKNOWN"), (b"", "UNKNOWN")],
)
def test_formats(spark, head, name):
    assert spark.range(1).select(images.format_of(F.lit(bytearray(head)))).first()[0] == name


def test_png_export_of_large_image_streams_strips(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "STRIP_PIXELS", 40)
    px = spark.range(1).selectExpr("5L AS img_id", "17 AS w", "30 AS h", "explode(sequence(0, 509)) AS k").selectExpr(
        "img_id", "w", "h", "k % 17 AS x", "cast(k div 17 AS int) AS y", "k % 256 AS r", "k % 7 AS g", "255 - k % 256 AS b"
    )
    assert sinks.png_strips(px).count() == 15
    (row,) = sinks.export_png(px, str(tmp_path / "out")).collect()
    assert row.img_id == 5 and os.path.getsize(row.path.removeprefix("file:")) == row.size_bytes
    assert os.listdir(tmp_path / "out") == ["5.png"]
    back = images.explode_pixels(images.split_decoded(images.load_images(spark, row.path))[0])
    same = back.select("x", "y", "r", "g", "b").exceptAll(px.select("x", "y", "r", "g", "b"))
    assert back.count() == 510 and same.isEmpty()


def test_failed_export_leaves_nothing_behind(spark, tmp_path):
    """Half of the images are written when a later one ends the job: the files of every task go."""
    cell = "named_struct('w', 1, 'h', 1)"
    px = spark.range(40, numPartitions=8).selectExpr("id AS img_id", f"{cell}.w AS w", f"{cell}.h AS h", "0 AS x", "0 AS y", "1 AS r", "2 AS g", "3 AS b")
    strips = sinks.png_strips(px)
    bad = strips.withColumn("bytes", F.when(F.col("img_id") != 33, F.col("bytes")))
    folder = tmp_path / "out"
    spark.dataSource.register(png_sink.PngFiles)

    def write(df):
        df.repartition(4, "img_id").sortWithinPartitions("img_id", "strip").write.format(png_sink.NAME).mode("append").option("path", f"file://{folder}").save()

    with pytest.raises(Exception, match="Writ|write|NoneType"):
        write(bad)
    assert os.listdir(folder) == []
    write(strips)
    assert sorted(os.listdir(folder)) == sorted(f"{k}.png" for k in range(40))


@pytest.mark.parametrize("uri,path", [("/a b/c", "/a b/c"), ("file:/a b/c", "/a b/c"), ("file:///a%20b", "/a%20b"), ("rel/x:y", "rel/x:y")])
def test_folders_are_paths_or_uris(uri, path):
    system, found = png_sink.file_system(uri)
    assert (system.type_name, found) == ("local", path)


def bmp(bits, colors=b"", meters=(0, 0)):
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(colors)) + struct.pack("<IiiHHIIiiII", 40, 7, -5, 1, bits, 0, 0, *meters, len(colors) // 4, 0) + colors


def tiff_header(order, entries, extra=b""):
    code = {b"II": "<", b"MM": ">"}[order]
    out = order + struct.pack(f"{code}HIH", 42, 8, len(entries))
    for tag, kind, count, value in entries:
        out += struct.pack(f"{code}HHI", tag, kind, count) + (struct.pack(f"{code}HH", value, 0) if kind == 3 and count == 1 else struct.pack(f"{code}I", value))
    return out + struct.pack(f"{code}I", 0) + extra


def tiff_file(order, photometric, samples, bits, unit=2, dots=300):
    code = {b"II": "<", b"MM": ">"}[order]
    entries = [(256, 3, 1, 40), (257, 3, 1, 30), (258, 3, 1, bits), (262, 3, 1, photometric), (277, 3, 1, samples)]
    at = 10 + 12 * (len(entries) + 3) + 4
    entries += [(282, 5, 1, at), (283, 5, 1, at), (296, 3, 1, unit)]
    return tiff_header(order, entries, struct.pack(f"{code}II", dots, 1))


def png_head(depth, color):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 3, 2, depth, color, 0, 0, 0) + b"\0" * 4


GRAY = b"".join(bytes([k, k, k, 0]) for k in range(256))


@pytest.mark.parametrize(
    "data,want",
    [
        (png_head(8, 3), (3, 2, "P", None, None)), (png_head(8, 4), (3, 2, "LA", None, None)), (png_head(1, 0), (3, 2, "1", None, None)),
        (png_head(16, 0), (3, 2, "I;16", None, None)), (png_head(16, 6), (3, 2, "RGBA", None, None)),
        (bmp(24, meters=(11811, 3780)), (7, 5, "RGB", 300, 96)), (bmp(8, GRAY), (7, 5, "L", None, None)),
        (bmp(8, GRAY[:-4] + b"\1\2\3\0"), (7, 5, "P", None, None)), (bmp(1, b"\0\0\0\0\xff\xff\xff\0"), (7, 5, "1", None, None)),
        (tiff_file(b"II", 2, 3, 8), (40, 30, "RGB", 300, 300)), (tiff_file(b"MM", 5, 4, 8, unit=3, dots=100), (40, 30, "CMYK", 254, 254)),
        (tiff_file(b"II", 1, 1, 1, unit=1), (40, 30, "1", None, None)), (tiff_file(b"II", 3, 1, 8), (40, 30, "P", 300, 300)), (tiff_file(b"MM", 1, 2, 8), (40, 30, "LA", 300, 300)),
        (b"GIF89a" + struct.pack("<HH", 9, 8), (9, 8, "P", None, None)),
        (b"\xff\xd8\xff\xff\xff\xc0" + struct.pack(">HBHHB", 17, 8, 30, 40, 4), (40, 30, "CMYK", None, None)),
        (b"II*\0", (None,) * 5), (b"BM", (None,) * 5), (tiff_header(b"II", [(256, 3, 1, 5)]), (None,) * 5),
    ],
)
def test_headers_of_all_formats(data, want):
    assert header(data) == want


def test_jpeg_resolution_from_tags_where_the_frame_has_none():
    block = tiff_file(b"II", 2, 3, 8, dots=240)
    assert header(jpeg((0xE1, b"Exif\0\0" + block), (0xC0, struct.pack(">BHHB", 8, 30, 40, 3)))) == (40, 30, "RGB", 240, 240)


def test_assets_bring_their_records_from_one_read(spark, tmp_path):
    block = iim((5, b"Title"), (25, b"one"), (25, b" "), (25, b"two"))
    resource = b"Photoshop 3.0\0" + b"8BIM\x04\x04\0\0" + struct.pack(">I", len(block)) + block
    frame = (0xC0, struct.pack(">BHHB", 8, 30, 40, 3))
    (tmp_path / "full #1.jpg").write_bytes(jpeg((0xE1, b"Exif\0\0" + tiff(b"II")), (0xED, resource), frame))
    (tmp_path / "plain.jpg").write_bytes(jpeg(frame))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG")
    good, bad = images.load_assets(images.scan(spark, str(tmp_path)))
    rows = {name_of(r.path): r for r in good.collect()}
    assert set(rows) == {"full #1.jpg", "plain.jpg"} and [name_of(r.path) for r in bad.collect()] == ["broken.png"]
    full, plain = rows["full #1.jpg"], rows["plain.jpg"]
    assert (full.iptc.title, full.iptc.keywords) == ("Title", ["one", "two"]) and full.exif is not None
    assert (plain.exif, plain.ratios, plain.iptc) == (None, None, None)
    text = good._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and text.count("FileScan") == 1
    files = images.scan(spark, str(tmp_path)).withColumn("asset_id", images.image_id(F.col("path")))
    apart = metadata.exif_records(tagscan.scan_exif_tags(files)).collect()
    assert [r.exif for r in apart] == [full.exif] and [r.ratios for r in apart] == [full.ratios]


def test_save_pixels(spark, tmp_path):
    px = spark.range(3).selectExpr("id AS img_id", "2 AS w", "1 AS h", "explode(sequence(0, 1)) AS x").selectExpr(
        "*", "0 AS y", "1 AS r", "2 AS g", "3 AS b"
    )
    sinks.save_pixels(px, str(tmp_path / "px"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "px")).drop("bucket").exceptAll(px).isEmpty()


def test_find_duplicates_of_folder(spark, tmp_path):
    rows = [[(x * 16 + y * 3) % 256 for x in range(16)] for y in range(16)]
    near = [list(r) for r in rows]
    near[0][0] = 9
    other = [[255 * ((x // 4 + y // 4) % 2) for x in range(16)] for y in range(16)]
    for name, pic in [("b.png", rows), ("a.png", near), ("c.png", other)]:
        (tmp_path / name).write_bytes(png_bytes(pic, 1))
    (tmp_path / "bad.png").write_bytes(b"x")
    groups, rejected = find_duplicates(spark, str(tmp_path))
    assert [name_of(r.path) for r in rejected.collect()] == ["bad.png"]
    got = sorted((name_of(r.leader_path), name_of(r.path)) for r in groups.collect())
    assert got == [("a.png", "a.png"), ("a.png", "b.png")]


def test_lineage_follows_real_sizes(spark):
    px = spark.range(1).selectExpr("id AS img_id", "6 AS w", "4 AS h", "explode(sequence(0, 23)) AS k").selectExpr(
        "img_id", "w", "h", "k % 6 AS x", "cast(k div 6 AS int) AS y", "k AS r", "k AS g", "k AS b"
    )
    chain = [
        {"name": "crop", "parameters": {"x": 1, "width": 4}}, {"name": "sepia", "enabled": False},
        {"name": "rotate", "parameters": {"angle": 30}}, {"name": "transpose", "parameters": {"method": "rotate_90"}},
        {"name": "resize", "parameters": {"width": 3}}, {"name": "rotate"},
    ]
    for n in range(1, len(chain) + 1):
        out, trail = run_with_lineage(px, chain[:n])
        last = trail.orderBy(F.desc("step")).first()
        assert {(r.w, r.h) for r in out.select("w", "h").distinct().collect()} == {(last.width, last.height)}
        assert out.count() == last.width * last.height


# --- tag blocks ---------------------------------------------------------------------------------


def tiff(order):
    """Make, orientation and an Exif sub-block with exposure time."""
    e = ">" if order == b"MM" else "<"
    make, sub = b"Canon\0", 8 + 2 + 3 * 12 + 4
    ifd = struct.pack(f"{e}H", 3)
    ifd += struct.pack(f"{e}HHII", 271, 2, 6, sub)
    ifd += struct.pack(f"{e}HHIHH", 274, 3, 1, 6, 0)
    ifd += struct.pack(f"{e}HHII", 34665, 4, 1, sub + 6) + struct.pack(f"{e}I", 0)
    exif = struct.pack(f"{e}H", 1) + struct.pack(f"{e}HHII", 33434, 5, 1, sub + 6 + 18) + struct.pack(f"{e}I", 0)
    return order + struct.pack(f"{e}HI", 42, 8) + ifd + make + exif + struct.pack(f"{e}II", 1, 250)


def jpeg(*segments):
    body = b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(s) + 2) + s for m, s in segments)
    return b"\xff\xd8" + body + b"\xff\xda\0\0"


def iim(*records):
    return b"".join(b"\x1c\x02" + bytes([n]) + struct.pack(">H", len(v)) + v for n, v in records)


WANT = {("0th", 271, "Canon", None, None), ("0th", 274, None, 6, None), ("Exif", 33434, None, None, (1, 250))}


def as_set(rows):
    return {(i, t, s, n, None if r is None else (r[0]["num"], r[0]["den"])) for i, t, s, n, r in rows}


@pytest.mark.parametrize("order", [b"II", b"MM"])
def test_exif_containers(order):
    block = tiff(order)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", len(block)) + b"eXIf" + block + b"crc!"
    webp = b"RIFF\0\0\0\0WEBP" + b"EXIF" + struct.pack("<I", len(block)) + block
    for data in (jpeg((0xE0, b"JFIF"), (0xE1, b"Exif\0\0" + block)), png, webp, block):
        assert as_set(tagscan.exif_rows(data)) == WANT


@pytest.mark.parametrize("data", [b"", b"\xff\xd8", b"text", jpeg((0xE1, b"Exif\0\0II*\0\xff\xff\xff\xff")), jpeg((0xE1, b"Exif\0\0XX"))])
def test_broken_exif_gives_no_rows(data):
    assert tagscan.exif_rows(data) == []


def test_iptc_records():
    block = iim((5, b"Title"), (25, b"one"), (25, b"two"))
    resource = b"8BIM\x04\x04\0\0" + struct.pack(">I", len(block)) + block
    other = b"8BIM\x03\xed\0\0" + struct.pack(">I", 3) + b"abc\0"
    data = jpeg((0xED, b"Photoshop 3.0\0" + other + resource))
    assert tagscan.iptc_rows(data) == [(5, 0, "Title"), (25, 1, "one"), (25, 2, "two")]
    assert tagscan.iptc_rows(b"junk") == []


def test_scan_job(spark):
    files = spark.createDataFrame(
        [(1, bytearray(jpeg((0xE1, b"Exif\0\0" + tiff(b"II"))))), (2, bytearray(b"junk"))], "asset_id bigint, content binary"
    )
    rows = tagscan.scan_exif_tags(files).collect()
    assert {(r.asset_id, r.tag) for r in rows} == {(1, 271), (1, 274), (1, 33434)}
    assert tagscan.scan_iptc_tags(files).count() == 0


# --- recipes ------------------------------------------------------------------------------------


def test_recipe_files(spark, tmp_path):
    good = {"name": "web", "actions": [{"name": "resize", "parameters": {"width": 800}}, {"name": "sepia", "enabled": False}]}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "cut.json").write_text('{"name": "x", "actions": [')
    (tmp_path / "nameless.json").write_text('{"name": "", "actions": []}')
    (tmp_path / "other.txt").write_text("no")
    rows = {name_of(r.file): r for r in recipes.read_recipes(spark, str(tmp_path)).collect()}
    assert set(rows) == {"good.json", "cut.json", "nameless.json"}
    web = rows["good.json"]
    assert web.error is None and web.name == "web"
    assert [(a.name, a.parameters, a.enabled) for a in web.actions] == [
        ("resize", {"width": "800"}, True), ("sepia", {}, False)
    ]
    valid = {name_of(r.file): r.valid for r in recipes.validate_files(spark, str(tmp_path)).collect()}
    assert valid == {"good.json": True, "cut.json": False, "nameless.json": False}


def test_recipe_round_trip(spark, tmp_path):
    text = '{"name":"n","actions":[{"name":"crop","parameters":{"y":"2","x":"1"}}],"metadata":{"b":"2","a":"1"}}'
    df = spark.createDataFrame([(text,)], "doc string")
    parsed = recipes.recipes_from_text(df, "doc")
    recipes.write_recipes(parsed, str(tmp_path / "out"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert line == (
        '{"actions":[{"description":"","enabled":true,"name":"crop","parameters":{"x":"1","y":"2"}}],'
        '"metadata":{"a":"1","b":"2"},"name":"n"}'
    )
    again = recipes.recipes_from_text(spark.createDataFrame([(line,)], "doc string"), "doc")
    assert again.collect() == parsed.collect()


# --- registry -----------------------------------------------------------------------------------


def test_register_and_unregister(spark):
    reg = Registry()
    op = Operator("noop", "No-op", lambda px: px, {}, ("test",))
    reg.register(op)
    reg.register(op)
    with pytest.raises(OperatorError):
        reg.register(Operator("noop", "Other", lambda px: px.limit(0), {}))
    reg.unregister("noop")
    with pytest.raises(OperatorError):
        reg.get("noop")


def test_operator_table(spark):
    rows = OPERATORS.table(spark).collect()
    assert [r.name for r in rows] == OPERATORS.names() == sorted(r.name for r in rows)
    assert [r.name for r in OPERATORS.by_tag(spark, "geometry").collect()] == ["crop", "resize", "rotate", "transpose"]


@pytest.mark.parametrize(
    "name,params",
    [("brightness", {"factor": 3.5}), ("brightness", {"factor": "abc"}), ("resize", {"width": 0}), ("watermark", {}),
     ("transpose", {"method": "sideways"}), ("rotate", {"expand": "maybe"})],
)
def test_validation_stops_bad_parameters(name, params):
    with pytest.raises(OperatorError):
        OPERATORS.get(name).validated(params)


def test_defaults_and_coercion():
    assert OPERATORS.get("resize").validated({"width": "40", "junk": 1}) == {
        "width": 40, "height": None, "maintain_aspect": True, "resample": "LANCZOS"
    }
    assert Param("bool").coerce("x", "Off") is False


def test_run_steps_skips_disabled(spark):
    px = spark.createDataFrame([(1, 1, 1, 0, 0, 100, 50, 10)], "img_id bigint, w int, h int, x int, y int, r int, g int, b int")
    out = run_steps(px, [
        {"name": "brightness", "parameters": {"factor": "2"}}, {"name": "grayscale", "enabled": False},
        {"name": "crop", "parameters": {}}, {"name": "levels", "parameters": {}}, {"name": "rotate", "parameters": {}},
        {"name": "blur", "parameters": {}}, {"name": "sharpen", "parameters": {}}, {"name": "sharpness", "parameters": {}},
        {"name": "transpose", "parameters": {}}, {"name": "watermark", "parameters": {"text": "hi"}},
    ]).collect()
    assert [(r.r, r.g, r.b) for r in out] == [(200, 100, 20)]


# --- streams ------------------------------------------------------------------------------------


def test_watch_folder(spark, folder, tmp_path):
    stream = arrivals.watch_folder(spark, folder)
    arrivals.drain_to_table(stream, str(tmp_path / "rows"), str(tmp_path / "ckpt"))
    (open(f"{folder}/late.webp", "wb")).write(b"RIFF\0\0\0\0WEBPVP8 ")
    arrivals.drain_to_table(arrivals.watch_folder(spark, folder), str(tmp_path / "rows"), str(tmp_path / "ckpt"))
    rows = spark.read.parquet(str(tmp_path / "rows")).collect()
    assert sorted((name_of(r.path), r.format) for r in rows) == [
        ("alpha.PNG", "PNG"), ("broken.jpg", "UNKNOWN"), ("gray.png", "PNG"), ("late.webp", "WEBP"), ("rgb.png", "PNG"),
    ]


def test_operators_on_arrivals(spark, folder, tmp_path):
    query = arrivals.run_on_arrivals(
        arrivals.watch_images(spark, folder), lambda px: pw.brightness(px, 2.0), str(tmp_path / "out"), str(tmp_path / "ck")
    )
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.r, r.g, r.b) for r in rows if (r.w, r.h) == (2, 2)) == [(6, 8, 10), (12, 14, 16), (18, 20, 255), (255, 2, 4)]
    assert len(rows) == 8
