"""Named operators: what they are called, what they take, and how a list of them runs over pixels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaforge.functions.validation import FALSE_WORDS, TRUE_WORDS
from lumaforge.operators import neighborhood as nb
from lumaforge.operators import pointwise as pw
from lumaforge.session import cut_lineage


class OperatorError(ValueError):
    """A parameter or a registration is not acceptable."""


@dataclass(frozen=True)
class Param:
    """A typed parameter: ``kind`` is int, float, bool, str or choice."""

    kind: str
    default: object = None
    lo: float | None = None
    hi: float | None = None
    choices: tuple[str, ...] = ()
    required: bool = False

    def coerce(self, name: str, raw):
        if raw is None:
            if self.required and self.default is None:
                raise OperatorError(f"{name}: a value is required")
            return self.default
        try:
            value = self._convert(raw)
        except (TypeError, ValueError) as e:
            raise OperatorError(f"{name}: {raw!r} is not a valid {self.kind}") from e
        if self.lo is not None and value < self.lo:
            raise OperatorError(f"{name}: must be at least {self.lo}")
        if self.hi is not None and value > self.hi:
            raise OperatorError(f"{name}: must be at most {self.hi}")
        return value

    def _convert(self, raw):
        if self.kind == "int":
            return int(raw)
        if self.kind == "float":
            return float(raw)
        if self.kind == "bool":
            word = str(raw).lower()
            if word not in (*TRUE_WORDS, *FALSE_WORDS):
                raise ValueError(raw)
            return word in TRUE_WORDS
        text = str(raw)
        if self.choices and text not in self.choices:
            raise ValueError(raw)
        return text


@dataclass(frozen=True)
class Operator:
    name: str
    label: str
    apply: Callable[..., DataFrame]
    params: dict[str, Param]
    tags: tuple[str, ...] = ()
    description: str = ""
    version: str = "1.0.0"
    author: str = "lumaforge"
    # Whether the operator reads its input more than once.
    rereads: bool = False

    def validated(self, raw: dict) -> dict:
        """Coerced parameters; names the operator does not know are dropped."""
        return {name: p.coerce(name, raw.get(name)) for name, p in self.params.items()}

    def __call__(self, px: DataFrame, **raw) -> DataFrame:
        return self.apply(px, **self.validated(raw))


class Registry:
    def __init__(self) -> None:
        self._items: dict[str, Operator] = {}

    def register(self, op: Operator) -> Operator:
        known = self._items.get(op.name)
        if known is not None and known.apply is not op.apply:
            raise OperatorError(f"operator '{op.name}' is already registered")
        self._items[op.name] = op
        return op

    def unregister(self, name: str) -> None:
        self._items.pop(name, None)

    def get(self, name: str) -> Operator:
        if name not in self._items:
            raise OperatorError(f"operator '{name}' not found; known: {', '.join(sorted(self._items))}")
        return self._items[name]

    def names(self) -> list[str]:
        return sorted(self._items)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per operator, sorted by name."""
        rows = [
            (o.name, o.label, o.description, o.version, o.author, list(o.tags), list(o.params))
            for o in self._items.values()
        ]
        schema = (
            "name string, label string, description string, version string, author string,"
            " tags array<string>, fields array<string>"
        )
        return spark.createDataFrame(rows, schema).orderBy("name")

    def by_tag(self, spark: SparkSession, tag: str) -> DataFrame:
        return self.table(spark).where(F.array_contains("tags", tag)).orderBy("name")


OPERATORS = Registry()


def _resize(px, width, height, maintain_aspect, resample):
    # With the aspect kept, height has no effect as soon as a width is given.
    return nb.resize(px, width, None if maintain_aspect and width else height, maintain_aspect, resample)


def _levels(px, shadows, midtones, highlights):
    """Map the tone sliders to black point, white point and gamma; the white point stays above the black one."""
    black = -255.0 * shadows
    white = max(255.0 / max(highlights, 1.0 / 255.0), black + 1.0)
    return pw.levels(px, input_black=black, input_white=white, gamma=midtones)


def _rotate(px, angle, expand):
    return nb.rotate(px, angle, expand)


def _watermark(px, text, position, opacity, font_size):
    return nb.watermark(px, F.lit(text), position, opacity, font_size)


def _add(name, label, apply, tags, description, rereads=False, **params):
    OPERATORS.register(Operator(name, label, apply, params, tuple(tags.split()), description, rereads=rereads))


ANCHORS = ("top_left", "top_right", "bottom_left", "bottom_right", "center")
RESAMPLES = ("NEAREST", "BILINEAR", "BICUBIC", "LANCZOS")
TRANSPOSES = (
    "flip_horizontal", "flip_vertical", "rotate_90", "rotate_180", "rotate_270", "transpose", "transverse",
    "FLIP_LEFT_RIGHT", "FLIP_TOP_BOTTOM", "ROTATE_90", "ROTATE_180", "ROTATE_270", "TRANSPOSE", "TRANSVERSE",
)

_add("resize", "Resize Image", _resize, "geometry basic resize", "Scale to a width and height",
     width=Param("int", None, 1, 50000), height=Param("int", None, 1, 50000),
     maintain_aspect=Param("bool", True), resample=Param("choice", "LANCZOS", choices=RESAMPLES))
_add("crop", "Crop Image", pw.crop, "geometry basic crop", "Cut out a rectangle",
     x=Param("int", 0, 0), y=Param("int", 0, 0), width=Param("int", None, 1), height=Param("int", None, 1))
_add("rotate", "Rotate Image", _rotate, "geometry rotation transform", "Turn counter-clockwise",
     angle=Param("float", 90.0, -360, 360), expand=Param("bool", True))
_add("transpose", "Transpose Image", pw.transpose, "geometry flip transform", "Flip or turn by quarters",
     method=Param("choice", "flip_horizontal", choices=TRANSPOSES))
_add("brightness", "Adjust Brightness", pw.brightness, "color tone brightness adjustment", "Blend with black",
     factor=Param("float", 1.0, 0, 3))
_add("contrast", "Adjust Contrast", pw.contrast, "color tone contrast adjustment", "Blend with the mean luma",
     rereads=True,
     factor=Param("float", 1.0, 0, 3))
_add("saturation", "Adjust Saturation", pw.saturation, "color saturation adjustment", "Blend with gray",
     factor=Param("float", 1.0, 0, 3))
_add("hue", "Adjust Hue", pw.hue, "color hue adjustment creative", "Turn the color wheel",
     shift=Param("float", 0.0, -180, 180))
_add("levels", "Adjust Levels", _levels, "color tone levels professional", "Shadows, midtones and highlights",
     shadows=Param("float", 0.0, -1, 1), midtones=Param("float", 1.0, 0.1, 3), highlights=Param("float", 1.0, 0, 2))
_add("sepia", "Sepia Tone", pw.sepia, "effect sepia vintage creative", "Brown tone",
     intensity=Param("float", 1.0, 0, 1))
_add("blur", "Blur Image", nb.gaussian_blur, "effect blur filter", "Gaussian blur",
     radius=Param("float", 2.0, 0.1, 20))
_add("sharpen", "Sharpen Image", nb.sharpen, "effect sharpen filter", "Sharpen edges",
     factor=Param("float", 1.0, 0.1, 3))
_add("sharpness", "Adjust Sharpness", nb.sharpness, "effect sharpen adjustment", "Blend with a smoothed image",
     factor=Param("float", 1.0, 0, 3))
_add("noise_reduction", "Noise Reduction", nb.noise_reduction, "enhancement noise quality cleanup", "Median filter",
     strength=Param("float", 1.0, 0.1, 3))
_add("watermark", "Add Watermark", _watermark, "text branding watermark effect", "Draw a text",
     text=Param("str", required=True), position=Param("choice", "bottom_right", choices=ANCHORS),
     opacity=Param("int", 75, 1, 100), font_size=Param("int", 5, 5, 500))
_add("grayscale", "Grayscale", pw.grayscale, "color tone", "Replace the channels by luma")
_add("flatten_alpha", "Flatten Alpha", pw.flatten_alpha, "output format", "Composite on white and drop alpha")


def run_steps(px: DataFrame, actions: list[dict], registry: Registry = OPERATORS) -> DataFrame:
    """Apply enabled actions ``{name, parameters, enabled}`` in order, as one lazy plan.

    Only before an operator that reads its input twice are the steps so far materialized, so that they
    are not computed twice.
    """
    out = px
    for action in (a for a in actions if a.get("enabled", True)):
        op = registry.get(action["name"])
        if op.rereads and out is not px:
            out = cut_lineage(out)
        out = op(out, **action.get("parameters", {}))
    return out
