"""EXIF and IPTC tags out of file bytes.

The walk over offsets inside a binary block cannot be written as Column expressions, so it runs as a
``mapInPandas`` job: one pass over the files, long tag rows out, and everything after that is SQL.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaforge.schemas import EXIF_TAGS, IPTC_TAGS

# Byte size of the TIFF value types, and the tags that point to further blocks.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
INT_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
SUB_BLOCKS = {34665: "Exif", 34853: "GPS"}
IPTC_TAG = 33723


def _blocks(data: bytes) -> tuple[bytes | None, bytes | None]:
    """``(tiff block, iptc block)`` of a file, by its container."""
    tiff = iptc = None
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if data[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
                tiff = body[6:]
            elif data[at + 1] == 0xED and body[:14] == b"Photoshop 3.0\0":
                iptc = _resource(body[14:]) or iptc
            at += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = struct.unpack_from(">I", data, at)[0]
            if data[at + 4 : at + 8] == b"eXIf":
                tiff = data[at + 8 : at + 8 + size]
            at += 12 + size
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at : at + 4] == b"EXIF":
                body = data[at + 8 : at + 8 + size]
                tiff = body[6:] if body[:6] == b"Exif\0\0" else body
            at += 8 + size + size % 2
    elif data[:4] in (b"II*\0", b"MM\0*"):
        tiff = data
    return tiff, iptc


def _resource(body: bytes) -> bytes | None:
    """The IPTC record block among the image resources of an editor segment; none if the segment is cut off."""
    at = 0
    while body[at : at + 4] == b"8BIM":
        try:
            kind, name = struct.unpack_from(">HB", body, at + 4)
            at += 6 + name + 1 + (name + 1) % 2
            size = struct.unpack_from(">I", body, at)[0]
        except struct.error:
            return None
        if kind == 0x0404:
            return body[at + 4 : at + 4 + size]
        at += 4 + size + size % 2
    return None


def _value(raw: bytes, kind: int, count: int, order: str):
    """``(text, integer, rationals)`` of one tag; only one of them is set."""
    if kind in (5, 10):
        code = "I" if kind == 5 else "i"
        flat = struct.unpack(f"{order}{2 * count}{code}", raw)
        return None, None, [{"num": n, "den": d} for n, d in zip(flat[::2], flat[1::2])]
    if kind in (2, 7) or (kind == 1 and count > 1):
        try:
            return raw.decode("utf-8").rstrip("\0"), None, None
        except UnicodeDecodeError:
            return raw.hex(), None, None
    numbers = struct.unpack(f"{order}{count}{INT_CODE[kind]}", raw)
    if count == 1:
        return None, numbers[0], None
    return " ".join(map(str, numbers)), None, None


def entries(tiff: bytes) -> Iterator[tuple]:
    """``(block, tag, type, raw value, text, integer, rationals)`` of every readable entry."""
    order = {b"II": "<", b"MM": ">"}[tiff[:2]]
    todo, seen = [("0th", struct.unpack_from(f"{order}I", tiff, 4)[0])], set()
    while todo:
        name, at = todo.pop()
        if at in seen:
            continue
        seen.add(at)
        for k in range(struct.unpack_from(f"{order}H", tiff, at)[0]):
            tag, kind, count = struct.unpack_from(f"{order}HHI", tiff, at + 2 + 12 * k)
            size = TYPE_SIZE.get(kind, 0) * count
            where = at + 2 + 12 * k + 8
            if size > 4:
                where = struct.unpack_from(f"{order}I", tiff, where)[0]
            raw = tiff[where : where + size]
            if size == 0 or len(raw) < size:
                continue
            text, number, ratios = _value(raw, kind, count, order)
            if tag in SUB_BLOCKS and number is not None:
                todo.append((SUB_BLOCKS[tag], number))
            else:
                yield name, tag, raw, text, number, ratios


def exif_rows(data: bytes) -> list[tuple]:
    """``(ifd, tag, str_val, int_val, rationals)`` rows; none when the block is missing or broken."""
    try:
        tiff, _ = _blocks(data)
        if tiff is None:
            return []
        return [(ifd, tag, text, number, ratios) for ifd, tag, _, text, number, ratios in entries(tiff) if tag != IPTC_TAG]
    except (struct.error, KeyError):
        return []


def iptc_rows(data: bytes) -> list[tuple]:
    """``(dataset, ord, value)`` rows of the application record, in file order."""
    try:
        tiff, block = _blocks(data)
        if block is None and tiff is not None and data[:2] != b"\xff\xd8":
            block = next((raw for ifd, tag, raw, *_ in entries(tiff) if tag == IPTC_TAG), None)
        rows, at = [], 0
        while block is not None and at + 5 <= len(block) and block[at] == 0x1C:
            record, dataset, size = struct.unpack_from(">BBH", block, at + 1)
            value = block[at + 5 : at + 5 + size]
            if record == 2:
                rows.append((dataset, len(rows), value.decode("utf-8", errors="ignore")))
            at += 5 + size
        return rows
    except (struct.error, KeyError):
        return []


def _scan(files: DataFrame, rows_of, columns: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, *row) for i, data in zip(batch["asset_id"], batch["content"]) for row in rows_of(data)]
            yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in columns if c in ("asset_id", "int_val")})

    return files.select("asset_id", F.col("content")).mapInPandas(run, schema)


def scan_exif_tags(files: DataFrame) -> DataFrame:
    """``files(asset_id, content)`` -> the long EXIF tag table."""
    return _scan(files, exif_rows, ["asset_id", "ifd", "tag", "str_val", "int_val", "rationals"], EXIF_TAGS)


def scan_iptc_tags(files: DataFrame) -> DataFrame:
    """``files(asset_id, content)`` -> the long IPTC record table."""
    return _scan(files, iptc_rows, ["asset_id", "dataset", "ord", "value"], IPTC_TAGS)
