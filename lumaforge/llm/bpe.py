"""BPE encoding and decoding with merge ranks from a tokenizer file.

A word becomes a doubly linked list of symbols. A heap holds the merges that apply, by rank and then by place;
popping one joins its two symbols and pushes the merges with the new neighbors. Entries whose symbols have
changed meanwhile are recognized by their rank and skipped. A word of n symbols takes O(n log n) steps, so a
text without a single space is no special case. Decoding looks every id up and puts the vocabulary strings
together, with a space between them, since the file names no decoder.

White space separates tokens and is dropped, so the pieces between spaces are encoded independently and
remembered in tables of bounded size.

Nulls: a null text is encoded as an empty one and has no tokens. Repeated rows give repeated results. Only key
and text columns are read; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = "word_bpe_49k.json"

#: Pieces kept in each lookup table of a worker; a full table is emptied.
TABLE_SIZE = 400_000
#: Longer pieces are not kept.
LONGEST_KEPT = 64
#: Characters from here on are segmented by the tokenizer file's own rules, which know their classes.
PLAIN_BELOW = "ɐ"

_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_ODD_SPACES = re.compile("[\x1c-\x1f]")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable stand-in for each byte: itself if visible, else the next free code from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Table(dict):
    """Results by argument; a long argument's result is not kept."""

    def __init__(self, compute: Callable):
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= LONGEST_KEPT:
            self[key] = value
        return value


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in {**self.vocab, **self.special}.items()}
        # Both symbols in one integer, and the rank with the joined symbol in another.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[left] << 20 | self.vocab[right]] = rank << 20 | self.vocab[left + right]
        self.alphabet = byte_alphabet()
        self.first = [self.vocab.get(c) for c in self.alphabet]
        self.last = [self.vocab.get(c + self.suffix) for c in self.alphabet]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.rules = Tokenizer.from_file(path)
        self.words = Table(self._word)
        self.packed = Table(lambda piece: array("I", self.piece_ids(piece)).tobytes())
        self.decoded = Table(lambda piece: self.decode(array("I", self.packed[piece])).encode())

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to one word's symbols."""
        n = len(ids)
        known = self.merges.get
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        # Rank, place and the joined symbol in one integer: ordered by rank, then place.
        heap = [(m >> 20 << 52) | (i << 20) | (m & 0xFFFFF) for i in range(n - 1) if (m := known(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i, joined = (entry >> 20) & 0xFFFFFFFF, entry & 0xFFFFF
            j = after[i]
            if j < 0 or ids[i] < 0:
                continue
            m = known(ids[i] << 20 | ids[j])
            if m is None or m >> 20 != entry >> 52:
                continue
            ids[i], ids[j] = joined, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (m := known(joined << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (m >> 20 << 52) | (i << 20) | (m & 0xFFFFF))
            h = before[i]
            if h >= 0 and (m := known(ids[h] << 20 | joined)) is not None:
                heapq.heappush(heap, (m >> 20 << 52) | (h << 20) | (m & 0xFFFFF))
        return [i for i in ids if i >= 0]

    def _word(self, data: bytes) -> list[int]:
        symbols = [self.first[b] for b in data[:-1]] + [self.last[data[-1]]]
        return self.merge([s for s in symbols if s is not None])

    def _segments(self, piece: str) -> list[bytes]:
        if max(piece) < PLAIN_BELOW:
            return [w.encode() for w in self.pattern.findall(piece.lower())]
        place = {c: b for b, c in enumerate(self.alphabet)}
        parts = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(piece))
        return [bytes(place[c] for c in part) for part, _ in parts]

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of a stretch of text."""
        out: list[int] = []
        for part in self.special_pattern.split(piece) if "<|" in piece else (piece,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for word in self._segments(part):
                    out += self.words[word]
        return out

    def _pieces(self, text: str) -> list[str]:
        """Stretches between white space. Four control characters are white space to Python only."""
        return [p for p in _SPACES.split(text) if p] if _ODD_SPACES.search(text) else text.split()

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers in the machine's byte order, which is little-endian on all that Arrow supports here."""
        return self.round_trip(text)[0]

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))

    def round_trip(self, text: str) -> tuple[bytes, bytes]:
        """Packed ids, and their decoded text in UTF-8."""
        pieces = self._pieces(text)
        packed = b"".join(map(self.packed.__getitem__, pieces))
        decoded = list(map(self.decoded.__getitem__, pieces))
        if b"" in decoded:  # a piece of spaces that only Unicode knows as such
            decoded = filter(None, decoded)
        for kept in (self.words, self.packed, self.decoded):
            if len(kept) > TABLE_SIZE:
                kept.clear()
        return packed, b" ".join(decoded)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and the ``ids`` of each text."""

    def run(batches):
        enc = encoder(path or default_path(FILE))
        for batch in batches:
            ids = [np.frombuffer(enc.encode(t or ""), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``key`` and the ``text`` of each id list; null ids give an empty text."""

    def run(batches):
        enc = encoder(path or default_path(FILE))
        for batch in batches:
            texts = [enc.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Token count, and SHA-256 of the packed ids and of the decoded text."""

    def run(batches):
        enc = encoder(path or default_path(FILE))
        for batch in batches:
            counts, ids, decoded = [], [], []
            for t in batch.column(1):
                packed, back = enc.round_trip(t.as_py() or "")
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
