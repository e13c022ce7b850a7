"""Literal cases of the data model: labels, templates, sizes, rules, operation strings."""

import pytest
from pyspark.sql import functions as F

from lumaforge.functions import derived as d
from lumaforge.functions import geometry as g
from lumaforge.functions import tagvalues as tv
from lumaforge.functions import templates as tpl
from lumaforge.functions import validation as v
from lumaforge.plans import steps


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def lit_rational(n, den):
    return F.lit(n).cast("long"), F.lit(den).cast("long")


def test_exif_labels(spark):
    assert one(spark, d.focal_length_label(*lit_rational(85, 1))) == "85mm"
    assert one(spark, d.focal_length_label(*lit_rational(50, 1))) == "50mm"
    assert one(spark, d.aperture_label(*lit_rational(28, 10))) == "f/2.8"
    assert one(spark, d.aperture_label(*lit_rational(18, 10))) == "f/1.8"
    assert one(spark, d.exposure_label(*lit_rational(1, 250))) == "1/250s"
    assert one(spark, d.exposure_label(*lit_rational(1, 125))) == "1/125s"
    assert one(spark, d.exposure_label(*lit_rational(3, 2))) == "1.50s"
    assert one(spark, d.focal_length_label(F.lit(None).cast("long"), F.lit(None).cast("long"))) == ""


@pytest.mark.parametrize(
    "path,parts",
    [
        ("/a/b/photo.JPG", ("photo", "photo.JPG", "JPG", "b", "/a/b")),
        ("/a/archive.tar.gz", ("archive.tar", "archive.tar.gz", "gz", "a", "/a")),
        ("/a/.hidden", (".hidden", ".hidden", "", "a", "/a")),
        ("plain", ("plain", "plain", "", "", ".")),
    ],
)
def test_path_parts(spark, path, parts):
    p = F.lit(path)
    got = spark.range(1).select(d.stem(p), d.basename(p), d.extension(p), d.parent_name(p), d.parent_path(p)).first()
    assert tuple(got) == parts


CONTEXT = {
    "filename": "test", "width": 1920, "height": 1080, "title": "Mountain Sunset", "camera_make": "Canon",
    "camera_model": "EOS R5", "focal_length": "85mm", "ratio": 1.78, "keywords": ["b", "a"],
}


def render(spark, template):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in CONTEXT.items()]).withColumn(
        "image", F.struct(F.col("width").alias("width"), F.struct(F.lit("deep").alias("c")).alias("b"))
    )
    out = tpl.render(df, template, {c: F.col(c) for c in df.columns}).select("rendered", "template_error").first()
    return out.rendered if out.template_error is None else ValueError(out.template_error)


@pytest.mark.parametrize(
    "template,text",
    [
        ("<camera_make>_<camera_model>_<focal_length>", "Canon_EOS R5_85mm"),
        ("<filename>_<width*2>px", "test_3840px"),
        ("upper(<title>)", "MOUNTAIN SUNSET"),
        ("<width if width < 2000 else 2000>", "1920"),
        ("max(<width>, <height>)", "1920"),
        ("max(10, 20, 30)", "30"),
        ("len(<filename>)", "4"),
        ("file_###.jpg", "file_%03d.jpg"),
        ("file_####.jpg", "file_%04d.jpg"),
        ("a_##_b", "a_##_b"),
        ("upper(<filename>)_<min(width, 1000)>", "TEST_1000"),
        ("abs(-5)|abs(-2.5)", "5|2.5"),
        ("<image.width>x<image.b.c>", "1920xdeep"),
        ("<width / 2>|<width // 7>|<-width % 7>|<2 ** 10>", "960.0|274|5|1024"),
        ("<width > 5>", "1920 5>"),
        ("<height < 5 or filename == 'test'>", "True"),
        ("sorted(<keywords>)", "['a', 'b']"),
        ("replace(<filename>, 't', 'T')", "TesT"),
        ("round(<ratio>, 1)|round(2.5)|pow(2, 8)", "1.8|2|256"),
        ("plain", "plain"),
        ("", ""),
    ],
)
def test_templates(spark, template, text):
    assert render(spark, template) == text


@pytest.mark.parametrize(
    "template",
    [
        "eval(<filename>)", "open('/etc/passwd')", "<missing>", "<__import__('os')>", "<filename.__class__>",
        "<[x for x in 'a']>", "IMG(1)", "<width +>", "<image.nope>", "<lambda: 1>", "<width + filename>",
    ],
)
def test_bad_templates_fail_at_compile_time(spark, template):
    with pytest.raises(tpl.TemplateError):
        render(spark, template)


def test_row_errors(spark):
    assert str(render(spark, "int(<filename>)")) == "Function 'int' failed"
    assert str(render(spark, "<width / (height - 1080)>")) == "division by zero"
    assert render(spark, "<7 if height < 2000 else width / (height - 1080)>") == "7"


@pytest.mark.parametrize(
    "w,h,keep,size",
    [(960, None, True, (960, 540)), (None, 540, True, (960, 540)), (800, 600, True, (800, 450)),
     (800, 600, False, (800, 600)), (None, None, True, None)],
)
def test_fit_size(spark, w, h, keep, size):
    got = one(spark, g.fit_size(F.lit(1920), F.lit(1080), w, h, keep))
    if size is None:
        assert got.error == "Must specify at least one target dimension"
    else:
        assert (got.width, got.height, got.error) == (*size, None)


def test_crop_rules(spark):
    def check(x, y, w, h):
        return one(spark, g.crop_error(F.lit(1920), F.lit(1080), *[F.lit(n) for n in (x, y, w, h)]))

    assert check(100, 50, 800, 600) is None
    assert check(-1, 0, 1, 1) == "Crop X position cannot be negative"
    assert check(0, 0, 1921, 1) == "Crop area extends beyond image width"


@pytest.mark.parametrize("word", ["true", "YES", "1", "on", "Enabled"])
def test_true_words(spark, word):
    got = one(spark, v.boolean(F.lit(word)))
    assert got.value is True and got.error is None


@pytest.mark.parametrize("word", ["false", "No", "0", "off", "disabled"])
def test_false_words(spark, word):
    got = one(spark, v.boolean(F.lit(word)))
    assert got.value is False and got.error is None


def test_other_words(spark):
    got = one(spark, v.boolean(F.lit("maybe")))
    assert got.value is None and got.error.message == "String value not recognized as boolean"


def test_numbers(spark):
    assert one(spark, v.clamp(F.lit(-5.0), 0.0, 10.0)) == 0
    n = [(75.0, 0.0, 100.0, 0, 1), (50.0, 0.0, 100.0, 0, 255), (5.0, 5.0, 5.0, 0, 1), (-50.0, -100.0, 100.0, 0, 1)]
    got = [one(spark, v.normalize(F.lit(a), F.lit(b), F.lit(c), lo, hi)) for a, b, c, lo, hi in n]
    assert got == [0.75, 127.5, 0.0, 0.25]


def test_gps(spark):
    ref = F.lit(0).cast("long")
    assert one(spark, tv.gps_altitude(*lit_rational(150, 1), ref)) == 150.0
    clock = F.expr("array(" + ",".join(f"named_struct('num', {n}L, 'den', 1L)" for n in (10, 20, 30)) + ")")
    assert one(spark, tv.gps_timestamp(clock, F.lit("2024:01:01"))) == "2024:01:01 10:20:30"
    assert one(spark, tv.gps_timestamp(clock, F.lit(None).cast("string"))) == "10:20:30"
    assert one(spark, tv.gps_decimal(F.expr("slice(array(named_struct('num', 1L, 'den', 1L)), 1, 1)"), F.lit("N"))) == 0.0


@pytest.mark.parametrize(
    "text,name,kinds",
    [
        ("resize:width=800", "resize", {"width": "int"}),
        ("brightness:factor=1.2", "brightness", {"factor": "float"}),
        ("resize:width=800,maintain_aspect=true", "resize", {"width": "int", "maintain_aspect": "bool"}),
        ("sepia:", "sepia", {}),
        ("invalid_format", "invalid_format", {}),
        ("a:k=1=2,k=x:y,zz", "a", {"k": "str"}),
    ],
)
def test_action_strings(spark, text, name, kinds):
    got = one(spark, steps.parse_action(F.lit(text)))
    assert got.name == name and set(got.parameters) == set(kinds)
    for key, kind in kinds.items():
        assert one(spark, steps.parameter_type(F.lit(got.parameters[key]))) == kind


def test_predicted_size_after_three_steps(spark):
    actions = F.expr(
        "array(" + ",".join(
            f"named_struct('name', '{n}', 'parameters', {p}, 'enabled', true, 'description', '')"
            for n, p in [("resize", "map('width', '1920')"), ("watermark", "map('text', 'x')"), ("save", "map('quality', '90')")]
        ) + ")"
    )
    trail = one(spark, steps.size_after(actions, F.lit(4000), F.lit(3000)))
    assert [(s.action, s.w, s.h) for s in trail][-1] == ("save", 1920, 1440)


def test_clean_values(spark):
    assert one(spark, tv.clean_tag_value(F.lit(bytearray(b"Canon\0\0")))) == "Canon"
    assert one(spark, tv.clean_tag_value(F.lit(bytearray(b"\xff\xfe")))) == "fffe"
