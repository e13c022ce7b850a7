"""Typed parameter checks over raw columns.

Every rule returns a struct ``(value, error)``; ``error`` is null or a struct ``(field, expected, actual,
message)``. A bad row is kept with its error instead of stopping the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words accepted as booleans, in any case.
TRUE_WORDS = ("true", "yes", "1", "on", "enabled")
FALSE_WORDS = ("false", "no", "0", "off", "disabled")
LENIENT_TRUE = ("true", "yes", "1", "on")

# Color mode -> (description, channels, has alpha, web safe, compatible modes).
MODES = {
    "RGB": ("RGB Color (24-bit)", 3, False, True, ("RGB", "RGBA", "L", "LA")),
    "RGBA": ("RGB with Alpha (32-bit)", 4, True, True, ("RGB", "RGBA", "L", "LA")),
    "L": ("Grayscale (8-bit)", 1, False, True, ("L", "LA", "RGB", "RGBA")),
    "LA": ("Grayscale with Alpha (16-bit)", 2, True, False, ("L", "LA", "RGB", "RGBA")),
    "CMYK": ("CMYK (32-bit)", 4, False, False, ("CMYK", "RGB")),
    "P": ("Palette (8-bit)", 1, True, False, ("P", "RGB", "RGBA")),
    "1": ("Bitmap (1-bit)", 1, False, False, ("RGB", "L")),
}
UNKNOWN_MODE_COMPATIBLE = ("RGB", "L")

# Choices of the mode and format fields, value -> label.
MODE_CHOICES = {m: MODES[m][0] for m in ("RGB", "RGBA", "L", "LA", "CMYK", "P")}
FORMAT_CHOICES = {
    "JPEG": "JPEG (lossy compression)",
    "PNG": "PNG (lossless, supports transparency)",
    "WebP": "WebP (modern format, good compression)",
    "TIFF": "TIFF (uncompressed, professional)",
    "BMP": "BMP (uncompressed bitmap)",
    "GIF": "GIF (supports animation)",
}

INT_TEXT = r"^[+-]?[0-9]+$"
FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _problem(field: str, expected: str, actual: Column, message: str) -> Column:
    return F.struct(
        F.lit(field).alias("field"), F.lit(expected).alias("expected"),
        actual.cast("string").alias("actual"), F.lit(message).alias("message"),
    )


def _first(*cases: tuple[Column, Column]) -> Column:
    """First case that holds; null conditions count as false."""
    return F.coalesce(*[F.when(cond, problem) for cond, problem in cases])


def _result(value: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def required(v: Column, default=None, is_required: bool = True, field: str = "field") -> Column:
    """Fill a null with the default; a null without default is an error when required."""
    filled = v if default is None else F.coalesce(v, F.lit(default))
    missing = F.lit(is_required) & filled.isNull()
    error = _first((missing, _problem(field, "non-null value", filled, "Field is required but no value provided")))
    return _result(filled, error)


def _ranged(value: Column, raw: Column, noun: str, bad: str, lo, hi, field: str, expected: str) -> Column:
    cases = [(raw.isNotNull() & value.isNull(), _problem(field, expected, raw, bad))]
    if lo is not None:
        cases.append((value < lo, _problem(field, f"{noun} >= {lo}", value, f"Value must be at least {lo}")))
    if hi is not None:
        cases.append((value > hi, _problem(field, f"{noun} <= {hi}", value, f"Value must be at most {hi}")))
    return _result(value, _first(*cases))


def to_integer(raw: Column) -> Column:
    text = F.trim(raw.cast("string"))
    return F.when(text.rlike(INT_TEXT), text.try_cast("bigint"))


def to_float(raw: Column) -> Column:
    text = F.trim(raw.cast("string"))
    return F.when(text.rlike(FLOAT_TEXT), text.try_cast("double"))


def integer(raw: Column, lo=None, hi=None, field: str = "integer_field") -> Column:
    return _ranged(
        to_integer(raw), raw, "integer", "Value must be convertible to integer", lo, hi, field, "integer number"
    )


def floating(raw: Column, lo=None, hi=None, field: str = "float_field") -> Column:
    return _ranged(to_float(raw), raw, "number", "Value must be convertible to number", lo, hi, field, "numeric value")


def boolean(raw: Column, field: str = "boolean_field") -> Column:
    word = F.lower(raw)
    value = F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    bad = _problem(field, "boolean value (true/false)", raw, "String value not recognized as boolean")
    return _result(value, _first((raw.isNotNull() & value.isNull(), bad)))


def lenient_boolean(raw: Column) -> Column:
    """True for a few words, false for any other text; never an error."""
    return F.lower(raw).isin(*LENIENT_TRUE)


def string_length(v: Column, lo=None, hi=None, field: str = "string_field") -> Column:
    n = F.char_length(v)
    cases = []
    if lo is not None:
        message = f"String must be at least {lo} characters long"
        cases.append((n < lo, _problem(field, f"string with at least {lo} characters", v, message)))
    if hi is not None:
        message = f"String must be at most {hi} characters long"
        cases.append((n > hi, _problem(field, f"string with at most {hi} characters", v, message)))
    return _result(v, _first(*cases) if cases else F.lit(None))


def choice(v: Column, choices: list[str] | dict[str, str], field: str = "choice_field") -> Column:
    values = list(choices)
    expected = "one of: " + ", ".join(sorted(values))
    bad = _problem(field, expected, v, "Value is not a valid choice")
    return _result(v, _first((~v.isin(*values), bad)))


def choice_label(v: Column, choices: dict[str, str]) -> Column:
    """Display label of a choice; an unknown value stands for itself."""
    table = F.create_map(*[F.lit(c) for pair in choices.items() for c in pair])
    return F.coalesce(F.try_element_at(table, v), v)


def matches_pattern(v: Column, pattern: str) -> Column:
    """Whether the text matches a regular expression from its start."""
    return v.rlike(f"^(?:{pattern})")


def constrained(
    raw: Column, kind: str, lo=None, hi=None, choices=None, pattern: str | None = None, name: str = "parameter"
) -> Column:
    """Coerce to a parameter type, then check min, max, choices and pattern, in this order."""
    if kind == "int":
        value, bad = to_integer(raw), f"Parameter '{name}' must be an integer"
    elif kind == "float":
        value, bad = to_float(raw), f"Parameter '{name}' must be a number"
    elif kind == "bool":
        value, bad = lenient_boolean(raw), ""
    elif kind in ("str", "path", "enum"):
        value, bad = raw, ""
    else:
        raise ValueError(f"Invalid parameter type: {kind}")
    cases = []
    if bad:
        cases.append((raw.isNotNull() & value.isNull(), _problem(name, kind, raw, bad)))
    if lo is not None:
        cases.append((value < lo, _problem(name, f">= {lo}", raw, f"Parameter '{name}' must be >= {lo}")))
    if hi is not None:
        cases.append((value > hi, _problem(name, f"<= {hi}", raw, f"Parameter '{name}' must be <= {hi}")))
    if choices is not None:
        listed = "[" + ", ".join(repr(c) for c in choices) + "]"
        message = f"Parameter '{name}' must be one of {listed}"
        cases.append((~value.isin(*choices), _problem(name, listed, raw, message)))
    if pattern is not None and kind in ("str", "path", "enum"):
        message = f"Parameter '{name}' doesn't match required pattern"
        cases.append((~matches_pattern(value, pattern), _problem(name, pattern, raw, message)))
    return _result(value, _first(*cases) if cases else F.lit(None))


def dimension(v: Column, name: str = "width", lo: int = 1, hi: int = 50000) -> Column:
    value = to_integer(v)
    title = name.title()
    error = _first(
        (v.isNotNull() & value.isNull(), _problem(name, "integer", v, f"{title} must be an integer")),
        (value < lo, _problem(name, f"integer >= {lo}", value, f"{title} must be at least {lo}")),
        (value > hi, _problem(name, f"integer <= {hi}", value, f"{title} must be at most {hi}")),
    )
    return _result(value, error)


def percentage(v: Column, allow_over: bool = False, field: str = "percentage") -> Column:
    value = to_float(v)
    cases = [
        (v.isNotNull() & value.isNull(), _problem(field, "numeric percentage value", v, "Percentage must be a number")),
        (value < 0, _problem(field, "non-negative percentage", value, "Percentage cannot be negative")),
    ]
    if not allow_over:
        cases.append((value > 100, _problem(field, "percentage <= 100", value, "Percentage cannot exceed 100%")))
    return _result(value, _first(*cases))


def factor(v: Column, lo: float = 0.0, hi: float | None = None, field: str = "factor") -> Column:
    value = to_float(v)
    cases = [
        (v.isNotNull() & value.isNull(), _problem(field, "numeric factor value", v, "Factor must be a number")),
        (value < lo, _problem(field, f"factor >= {lo}", value, f"Factor must be at least {lo}")),
    ]
    if hi is not None:
        cases.append((value > hi, _problem(field, f"factor <= {hi}", value, f"Factor must be at most {hi}")))
    return _result(value, _first(*cases))


# --- color modes --------------------------------------------------------------------------------


def color_mode(mode: Column, supported: list[str] | None = None) -> Column:
    supported = list(MODES) if supported is None else supported
    message = F.concat(F.lit("Color mode '"), mode, F.lit("' not supported for this operation"))
    problem = F.struct(
        F.lit("color_mode").alias("field"), F.lit("one of " + ", ".join(supported)).alias("expected"),
        mode.alias("actual"), message.alias("message"),
    )
    return _result(mode, _first((~mode.isin(*supported), problem)))


def mode_info(mode: Column) -> Column:
    """Struct ``(description, channels, has_alpha, web_safe, compatible)``; unknown modes get defaults."""

    def entry(description: Column, channels, alpha, web, compatible) -> Column:
        return F.struct(
            description.alias("description"), F.lit(channels).alias("channels"), F.lit(alpha).alias("has_alpha"),
            F.lit(web).alias("web_safe"), F.array(*[F.lit(c) for c in compatible]).alias("compatible"),
        )

    out = None
    for name, (description, channels, alpha, web, compatible) in MODES.items():
        item = entry(F.lit(description), channels, alpha, web, compatible)
        out = F.when(mode == name, item) if out is None else out.when(mode == name, item)
    unknown = F.concat(F.lit("Unknown mode: "), mode)
    return out.otherwise(entry(unknown, 1, False, False, UNKNOWN_MODE_COMPATIBLE))


# Components of a color in each multi-channel mode; gray modes take one.
COLOR_COMPONENTS = {"RGB": 3, "RGBA": 4, "CMYK": 4, "LA": 2}
GRAY_MODES = ("L", "1")


def color_value(color: Column, mode: Column, lo: int = 0, hi: int = 255) -> Column:
    """Check an array of components against its mode; components are truncated to integers."""
    ints = F.transform(color, lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("bigint"))
    expected = F.when(mode.isin(*GRAY_MODES), 1)
    for name, n in COLOR_COMPONENTS.items():
        expected = expected.when(mode == name, n)
    expected = expected.otherwise(3)
    gray = mode.isin(*GRAY_MODES)
    wrong = F.struct(
        F.lit("color").alias("field"), expected.cast("string").alias("expected"),
        F.size(color).cast("string").alias("actual"),
        F.when(gray, F.lit("Grayscale modes require single color value"))
        .otherwise(F.concat(mode, F.lit(" mode requires "), expected.cast("string"), F.lit(" color components")))
        .alias("message"),
    )
    outside = F.filter(
        F.transform(ints, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda s: (s["c"] < lo) | (s["c"] > hi)
    )
    first = F.get(outside, F.lit(0))
    place = first["i"].cast("string")
    off = F.struct(
        F.when(gray, F.lit("color")).otherwise(F.concat(F.lit("color_component_"), place)).alias("field"),
        F.lit(f"value between {lo} and {hi}").alias("expected"), first["c"].cast("string").alias("actual"),
        F.when(gray, F.lit("Color value out of range"))
        .otherwise(F.concat(F.lit("Color component "), place, F.lit(" out of range"))).alias("message"),
    )
    # A component beyond the range of an integer is an error above and has no value.
    narrow = F.transform(ints, lambda c: c.try_cast("int"))
    return _result(narrow, _first((F.size(color) != expected, wrong), (F.size(outside) > 0, off)))


# --- numbers ------------------------------------------------------------------------------------


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def normalize(v: Column, in_min: Column, in_max: Column, out_min: float = 0.0, out_max: float = 1.0) -> Column:
    """Map one range to another; an input range without width gives ``out_min``."""
    unit = (v - in_min) / F.nullif(in_max - in_min, F.lit(0.0))
    return F.coalesce(F.lit(float(out_min)) + unit * F.lit(float(out_max - out_min)), F.lit(float(out_min)))


# --- parameter relevance ------------------------------------------------------------------------


def relevant_parameters(action: Column, params: Column) -> Column:
    """Drop parameters that have no effect given the others.

    Resize ignores ``height`` while the aspect is kept; save uses ``quality`` only for lossy formats.
    """
    keeps_aspect = ~F.coalesce(F.lower(F.try_element_at(params, F.lit("maintain_aspect"))), F.lit("true")).isin(*FALSE_WORDS)
    lossy = F.coalesce(F.try_element_at(params, F.lit("format")), F.lit("JPEG")).isin("JPEG", "WebP")
    return F.map_filter(
        params,
        lambda k, _: ~((action == "resize") & (k == "height") & keeps_aspect)
        & ~((action == "save") & (k == "quality") & ~lossy),
    )
