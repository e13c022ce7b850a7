"""Header facts, EXIF tags and IPTC records of files, from one read of each."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumaforge.operators.metadata import exif_of_row, iptc_of_row
from lumaforge.sources import tagscan
from lumaforge.sources.headers import FIELDS, header

HEAD = "struct<width:int,height:int,mode:string,dpi_x:int,dpi_y:int>"
EXIF = "array<struct<ifd:string,tag:int,str_val:string,int_val:bigint,rationals:array<struct<num:bigint,den:bigint>>>>"
IPTC = "array<struct<dataset:int,ord:int,value:string>>"

_RATIO = pa.struct([("num", pa.int64()), ("den", pa.int64())])
#: The same as Arrow types.
_ARROW = {
    "head": pa.struct([(c, pa.string() if c == "mode" else pa.int32()) for c in FIELDS]),
    "exif_tags": pa.list_(pa.struct([
        ("ifd", pa.string()), ("tag", pa.int32()), ("str_val", pa.string()), ("int_val", pa.int64()), ("rationals", pa.list_(_RATIO)),
    ])),
    "iptc_tags": pa.list_(pa.struct([("dataset", pa.int32()), ("ord", pa.int32()), ("value", pa.string())])),
}


def _scan(data: bytes | None) -> dict:
    found = data or b""
    exif = [dict(zip(("ifd", "tag", "str_val", "int_val", "rationals"), row)) for row in tagscan.exif_rows(found)]
    iptc = [dict(zip(("dataset", "ord", "value"), row)) for row in tagscan.iptc_rows(found)]
    return {"head": dict(zip(FIELDS, header(found))), "exif_tags": exif, "iptc_tags": iptc}


def read_records(files: DataFrame) -> DataFrame:
    """The columns of ``files`` but ``content``, with ``head``, ``exif_tags`` and ``iptc_tags`` beside them.

    A header that cannot be read has a null ``head.width``; the tag arrays are empty where there are none. Files come in
    batches that are bounded in bytes.
    """
    rest = [f for f in files.schema.fields if f.name != "content"]
    kind = T.StructType([*rest, *T.StructType.fromDDL(f"head {HEAD}, exif_tags {EXIF}, iptc_tags {IPTC}").fields])

    def run(batches):
        for batch in batches:
            found = [_scan(c.as_py()) for c in batch.column("content")]
            columns = [batch.column(f.name) for f in rest] + [pa.array([r[c] for r in found], t) for c, t in _ARROW.items()]
            yield pa.RecordBatch.from_arrays(columns, kind.names)

    return files.mapInArrow(run, kind)


def with_records(records: DataFrame) -> DataFrame:
    """Adds the structured ``exif``, ``ratios`` and ``iptc`` (null where a file has none) of the tags on the row."""
    exif, ratios = exif_of_row(F.col("exif_tags"))
    have = F.size("exif_tags") > 0
    return records.withColumns({
        "exif": F.when(have, exif), "ratios": F.when(have, ratios), "iptc": F.when(F.size("iptc_tags") > 0, iptc_of_row(F.col("iptc_tags"))),
    })


def readable() -> Column:
    return F.col("head.width").isNotNull() & (F.col("head.width") > 0) & (F.col("head.height") > 0)
