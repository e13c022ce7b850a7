"""A data source that writes images as PNG files: ``px.write.format("png_files")``, one file per image.

Strips of an image come to one task, compressed and in order, and stream into the file one by one, through the file system
that the folder's URI names. A task attempt writes into a folder of its own below a hidden one of the job. When all tasks are
done, the files of the attempts that count are moved to their names; when the job fails, the hidden folder goes with all
that is in it, so neither a failed nor a killed task leaves anything behind.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "png_files"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "img_id bigint, w int, h int, channels int, strip int, bytes binary, adler bigint, size bigint"
# Schemes that Spark's readers know under another name than this library's file systems.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}
#: Files moved at once when a job ends.
MOVERS = 32


def file_system(uri: str):
    """``(file system, path in it)`` of a URI or of a plain path."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def adler_join(a: int, b: int, size_b: int) -> int:
    """Checksum of two texts put together, from their own checksums."""
    mod = 65521
    low = (a & 0xFFFF) + (b & 0xFFFF) - 1
    high = (a >> 16) + (b >> 16) + size_b * ((a & 0xFFFF) - 1)
    return ((high % mod) << 16) | (low % mod)


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task attempt that has succeeded."""

    attempt: str


class _File:
    """One image on its way out."""

    def __init__(self, system, path: str, w: int, h: int, channels: int):
        self.out, self.check = system.open_output_stream(path), 1
        head = struct.pack(">IIBBBBB", w, h, 8, 6 if channels == 4 else 2, 0, 0, 0)
        self.out.write(SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", b"\x78\x9c"))

    def add(self, strip: bytes, adler: int, size: int) -> None:
        self.out.write(chunk(b"IDAT", strip))
        self.check = adler_join(self.check, adler, size)

    def close(self) -> None:
        tail = b"\x03\x00" + struct.pack(">I", self.check)
        self.out.write(chunk(b"IDAT", tail) + chunk(b"IEND", b""))
        self.out.close()


class PngWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.job = uuid.uuid4().hex

    def _places(self):
        system, folder = file_system(self.folder)
        return system, folder, f"{folder}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, hidden = self._places()
        attempt = uuid.uuid4().hex
        system.create_dir(f"{hidden}/{attempt}", recursive=True)
        current, img_id = None, None
        for batch in iterator:
            for row in batch.to_pylist():
                if row["img_id"] != img_id:
                    if current:
                        current.close()
                    img_id = row["img_id"]
                    current = _File(system, f"{hidden}/{attempt}/{img_id}.png", row["w"], row["h"], row["channels"])
                current.add(row["bytes"], row["adler"], row["size"])
        if current:
            current.close()
        return Written(attempt)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder, hidden = self._places()

        def move(path: str) -> None:
            final = f"{folder}/{path.rsplit('/', 1)[1]}"
            if system.type_name == "hdfs" and system.get_file_info(final).type != fs.FileType.NotFound:
                system.delete_file(final)  # where a rename does not replace
            system.move(path, final)

        with ThreadPoolExecutor(MOVERS) as pool:
            for message in filter(None, messages):
                list(pool.map(move, (f.path for f in system.get_file_info(fs.FileSelector(f"{hidden}/{message.attempt}")))))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, _, hidden = self._places()
        if system.get_file_info(hidden).type != fs.FileType.NotFound:
            system.delete_dir(hidden)


class PngFiles(DataSource):
    """Write-only; the option ``path`` is the folder, as a URI or a plain path."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> PngWriter:
        return PngWriter(self.options["path"])
