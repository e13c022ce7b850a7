"""What an image file's header says: size, mode and resolution, without decoding."""

from __future__ import annotations

import struct

from lumaforge.sources.tagscan import entries

# Fixed values: (bit depth, color type) of a PNG header -> mode. Sixteen bits per gray value have a mode of their own.
PNG_MODES = {
    (1, 0): "1", (2, 0): "L", (4, 0): "L", (8, 0): "L", (16, 0): "I;16", (8, 2): "RGB", (16, 2): "RGB",
    (1, 3): "P", (2, 3): "P", (4, 3): "P", (8, 3): "P", (8, 4): "LA", (16, 4): "RGBA", (8, 6): "RGBA", (16, 6): "RGBA",
}
# Components of a JPEG frame -> mode.
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
# Fixed values: (photometric interpretation, samples per pixel) of a TIFF -> mode; eight bits per sample.
TIFF_MODES = {
    (0, 1): "L", (1, 1): "L", (1, 2): "LA", (2, 3): "RGB", (2, 4): "RGBA", (3, 1): "P", (5, 4): "CMYK", (6, 3): "RGB",
}
INCH_IN_METERS, INCH_IN_CENTIMETERS = 0.0254, 2.54
#: Resolution unit of a tag block -> dots per inch in one of it; without a unit the numbers are no resolution.
PER_INCH = {2: 1.0, 3: INCH_IN_CENTIMETERS}
WIDTH_TAG, HEIGHT_TAG, BITS_TAG, PHOTOMETRIC_TAG, SAMPLES_TAG, X_TAG, Y_TAG, UNIT_TAG = 256, 257, 258, 262, 277, 282, 283, 296

FIELDS = ("width", "height", "mode", "dpi_x", "dpi_y")
NOTHING = (None, None, None, None, None)


def _png(data: bytes) -> tuple:
    width, height, depth, color = struct.unpack_from(">IIBB", data, 16)
    at, dpi = 8, (None, None)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IDAT":
            break
        if kind == b"pHYs":
            x, y, unit = struct.unpack_from(">IIB", data, at + 8)
            if unit == 1:
                dpi = round(x * INCH_IN_METERS), round(y * INCH_IN_METERS)
        at += 12 + size
    return width, height, PNG_MODES.get((depth, color)), *dpi


def _tag_block(block: bytes) -> dict:
    """First directory of a tag block: tag -> number, list of numbers, or quotients."""
    out: dict = {}
    for directory, tag, _, text, number, ratios in entries(block):
        if directory != "0th" or tag in out:
            continue
        if ratios is not None:
            out[tag] = [r["num"] / r["den"] for r in ratios if r["den"]]
        elif number is not None:
            out[tag] = number
        elif text is not None and text.replace(" ", "").isdigit():
            out[tag] = [int(v) for v in text.split()]
    return out


def _block_dpi(found: dict) -> tuple:
    scale = PER_INCH.get(found.get(UNIT_TAG, 2))
    x, y = found.get(X_TAG), found.get(Y_TAG)
    return (round(x[0] * scale), round(y[0] * scale)) if scale and x and y else (None, None)


def _tiff(data: bytes) -> tuple:
    found = _tag_block(data)
    bits, samples = found.get(BITS_TAG, 1), found.get(SAMPLES_TAG, 1)
    depth = bits[0] if isinstance(bits, list) else bits
    mode = TIFF_MODES.get((found.get(PHOTOMETRIC_TAG), samples))
    if samples == 1 and mode == "L":
        mode = {1: "1", 16: "I;16", 32: "F"}.get(depth, "L")
    return found[WIDTH_TAG], found[HEIGHT_TAG], mode, *_block_dpi(found)


def _jpeg(data: bytes) -> tuple:
    at, dpi, from_tags = 2, (None, None), (None, None)
    while at + 4 <= len(data) and data[at] == 0xFF:
        if data[at + 1] == 0xFF:  # a fill byte
            at += 1
            continue
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker == 0xE0 and data[at + 4 : at + 9] == b"JFIF\0":
            unit, x, y = struct.unpack_from(">BHH", data, at + 11)
            if unit:
                dpi = tuple(v if unit == 1 else round(v * INCH_IN_CENTIMETERS) for v in (x, y))
        elif marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            try:
                from_tags = _block_dpi(_tag_block(data[at + 10 : at + 2 + size]))
            except (struct.error, KeyError):
                pass
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack_from(">HHB", data, at + 5)
            return width, height, JPEG_MODES.get(parts), *(dpi if dpi[0] else from_tags)
        at += 2 + size
    return NOTHING


def _webp(data: bytes) -> tuple:
    kind = data[12:16]
    if kind == b"VP8X":
        flags = data[20]
        width, height = (1 + int.from_bytes(data[k : k + 3], "little") for k in (24, 27))
        return width, height, "RGBA" if flags & 0x10 else "RGB", None, None
    if kind == b"VP8L":
        bits = struct.unpack_from("<I", data, 21)[0]
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "RGBA" if bits >> 28 & 1 else "RGB", None, None
    width, height = struct.unpack_from("<HH", data, 26)
    return width & 0x3FFF, height & 0x3FFF, "RGB", None, None


def _bmp(data: bytes) -> tuple:
    size = struct.unpack_from("<I", data, 14)[0]
    if size == 12:  # the oldest header
        width, height, _, bits = struct.unpack_from("<HHHH", data, 18)
        x = y = 0
        entry, used = 3, 0
    else:
        width, height, _, bits, _, _, x, y, used = struct.unpack_from("<iiHHIIiiI", data, 18)
        entry = 4
    dpi = tuple(round(v * INCH_IN_METERS) if v > 0 else None for v in (x, y))
    mode = {16: "RGB", 24: "RGB", 32: "RGB"}.get(bits)
    if bits in (1, 4, 8):
        colors = data[14 + size : 14 + size + entry * (used or 1 << bits)]
        steps = [colors[k : k + 3] for k in range(0, len(colors) - 2, entry)]
        if steps == [bytes([0] * 3), bytes([255] * 3)]:
            mode = "1"
        else:
            mode = "L" if len(steps) == 256 and all(c == bytes([k] * 3) for k, c in enumerate(steps)) else "P"
    return width, abs(height), mode, *dpi


def _gif(data: bytes) -> tuple:
    width, height = struct.unpack_from("<HH", data, 6)
    return width, height, "P", None, None


def header(data: bytes | None) -> tuple:
    """``(width, height, mode, dpi_x, dpi_y)``; what the file does not say, or a broken header, is null."""
    try:
        if not data:
            return NOTHING
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(data)
        if data[:2] == b"BM":
            return _bmp(data)
        if data[:4] == b"GIF8":
            return _gif(data)
    except (struct.error, IndexError, KeyError):
        pass
    return NOTHING
