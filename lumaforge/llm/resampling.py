"""Importance resampling towards a target: hashed word n-grams by length-bucketed CRC matrices.

Words are runs of ASCII digits, letters (A-Z in lower case) and characters beyond ASCII; features are all runs of
``words[0]`` to ``words[1]`` of them, joined by a space, repeats counted. A feature's bucket is the CRC-32 of its bytes modulo
``BUCKETS``. Features that a task has not met yet are grouped by length into matrices of bytes, one row each; the CRCs of
all rows advance column by column through the usual table of 256 entries, and the buckets are scattered back to the
features. A length with fewer features than ``FEWEST`` is no matrix worth the name and goes row by row.

A bucket's gain is ``floor(1000 ln(((t+1)(S+B)) / ((s+1)(T+B))))`` of its counts ``s`` among the ``S`` features of all documents and ``t``
among the ``T`` of the target; a document's weight is the sum over its features. With Gumbel noise from a hash of its
id added, the highest scores are a sample without replacement in proportion to ``exp(weight / 1000)``.

Only counts per bucket (``BUCKETS`` rows at most) reach the driver. Texts are read twice and never move; the rows that are
ranked hold numbers only, are dealt by ranges of the score, and get their ranks from the ranges' sizes.

A null text has no words: weight 0, and never drawn. A null id hashes like an empty one and comes last among ties. Ties of
score go to the smaller id; repeated rows count as often as they occur, and are ranked one after the other, by number of
features where score and id are the same. Very long texts are taken in portions of ``PORTION`` bytes. An empty table gives
an empty result, an empty target only gains that favor rare buckets. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaforge.llm.tables import stored

BUCKETS = 10_000
#: Shortest and longest run of words that is a feature.
WORDS = (1, 1)
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Features of one length from which on they make a matrix.
FEWEST = 4
#: Features whose bucket a worker keeps, and the longest of them; a full table is emptied.
TABLE_SIZE = 500_000
LONGEST_KEPT = 64
PORTION = 1 << 20

#: Everything that is no word character becomes a space, and A-Z lower case.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def crc_table() -> np.ndarray:
    """CRC-32 of each single byte in the reflected form, eight shifts each."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = crc_table()


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a matrix of bytes, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _TABLE[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def crcs(features: list[bytes]) -> np.ndarray:
    """CRC-32 of each feature, by matrices of equal length."""
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    out = np.zeros(len(features), np.uint32)
    order = np.argsort(lengths, kind="stable")
    bounds = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for start, end in zip(bounds.tolist(), np.append(bounds[1:], len(order)).tolist()):
        at = order[start:end]
        if len(at) < FEWEST:
            out[at] = [zlib.crc32(features[i]) for i in at.tolist()]
        elif size := int(lengths[at[0]]):
            matrix = np.frombuffer(b"".join([features[i] for i in at.tolist()]), np.uint8).reshape(len(at), size)
            out[at] = crc_matrix(matrix)
    return out


def word_portions(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, portion by portion."""
    plain = text.translate(_KEPT)
    start = 0
    while start < len(plain):
        end = len(plain) if len(plain) - start <= PORTION else plain.find(b" ", start + PORTION)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def features_of(text: bytes, words: tuple[int, int]) -> Iterator[tuple[int, list[bytes]]]:
    """Portions of a text: number of words, and the runs of ``words[0]`` to ``words[1]`` words that end there."""
    low, high = words
    rest: list[bytes] = []
    for part in word_portions(text):
        if high == 1:
            yield len(part), part
            continue
        joined, found = rest + part, []
        for size in range(low, high + 1):
            first = max(0, len(rest) - size + 1)
            found += [b" ".join(joined[i : i + size]) for i in range(first, len(joined) - size + 1)]
        yield len(part), found
        rest = joined[max(0, len(joined) - high + 1) :]


def blocks(values: pa.Array, words: tuple[int, int]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Features of many texts together, with rows of text number, words and features, in portions."""
    parts, held, size = [], [], 0
    for i, value in enumerate(values.cast(pa.binary())):
        text = value.as_py() or b""
        size += len(text)
        for said, found in features_of(text, words):
            parts.append((i, said, len(found)))
            held += found
            if len(held) * 4 > PORTION or size > PORTION:
                yield np.array(parts), held
                parts, held, size = [], [], 0
    if parts:
        yield np.array(parts), held


class Buckets:
    """The bucket of every feature, with a bounded table of those met before."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.known: dict[bytes, int] = {}

    def of(self, features: list[bytes]) -> np.ndarray:
        distinct = set(features)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > TABLE_SIZE:
            self.known.clear()
            new = distinct
        if new:
            met = list(new)
            self.known.update(zip(met, (crcs(met) % np.uint32(self.buckets)).tolist()))
        out = np.fromiter(map(self.known.__getitem__, features), np.int64, len(features))
        for f in new:
            if len(f) > LONGEST_KEPT:
                del self.known[f]
        return out


def bucket_counts(docs: DataFrame, text: str, words: tuple[int, int], buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        hashed, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, features in blocks(batch.column(0), words):
                total += np.bincount(hashed.of(features), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "c"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, c long")
    rows = counted.groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()  # as many rows as there are buckets
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("c").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, in thousandths of a natural logarithm."""
    n, all_s, all_t = len(source), float(source.sum() + len(source)), float(target.sum() + len(source))
    ratio = [(float(t) + 1) * all_s / ((float(s) + 1) * all_t) for s, t in zip(source.tolist(), target.tolist())]
    return np.fromiter((math.floor(1000 * math.log(r)) for r in ratio), np.int64, n)


def weighted(docs: DataFrame, gain: np.ndarray, key: str, text: str, words: tuple[int, int]) -> DataFrame:
    """``key, n_words, n_features, weight`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = shared.value
        hashed = Buckets(len(gain))
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for parts, features in blocks(batch.column(1), words):
                owner, said, size = parts.T
                np.add.at(out[0], owner, said)
                np.add.at(out[1], owner, size)
                np.add.at(out[2], np.repeat(owner, size), gain[hashed.of(features)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long").withColumnRenamed("key", key)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a SHA-256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``rank``, the place of each row from 1 on, without bringing all rows into one task.

    Rows are dealt into ranges and sorted there; a row's place is that in its range, which the low 33 bits of its
    number give, after the sizes of the ranges before it. There is one such size for each partition.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, rows_before = 0, []
    for number, n in sizes:
        rows_before.append((number, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(rows_before, "_part long, _before long")
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return joined.withColumn("rank", place).drop("_at", "_part", "_before")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    words: tuple[int, int] = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """``key, n_words, n_features, weight, score, rank`` of every row; ``rank`` is null for those not drawn.

    ``percent`` of the rows with at least ``least_words`` words are drawn, rounded down.
    """
    gain = gains(bucket_counts(docs, text, words, buckets), bucket_counts(target, target_text, words, buckets))
    scored = weighted(docs, gain, key, text, words).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    scored = stored(scored, "scored")
    eligible = F.col("n_words") >= least_words
    drawn = percent * scored.where(eligible).count() // 100
    places = ranked(scored.where(eligible), [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("n_features")])
    places = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return places.unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")))


def drawn_only(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn documents with their columns unchanged; rows that share an id are drawn together."""
    found = resample(docs, target, key, text, **options).where(F.col("rank").isNotNull()).select(key).distinct()
    return docs.join(found, key, "left_semi")
