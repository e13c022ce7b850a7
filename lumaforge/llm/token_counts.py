"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both agree for certain.

A text of up to ``CHUNK`` bytes is encoded at once. A longer one is encoded in chunks that overlap, each with the
byte offsets of its tokens. Two neighbors are spliced at a token boundary inside their overlap that both have and that
is *proven stable*: the characters on its two sides stand next to each other in no piece of the vocabulary. A merge
makes a piece of the vocabulary, so no merge ever crosses such a place, and what lies left and right of it is encoded
as if the other side were not there. The tokens beside the boundary must also be their own surface, so that
normalization and byte fallback have no hand in it. Where the overlap has no such boundary (one letter repeated, say) the
earlier chunk is encoded again with an overlap twice as wide, until there is one or the text ends; in the worst case
the text is encoded at once, after work in proportion to its length.

A null or empty text has no tokens and no bytes. Repeated rows are counted alike, each on its own, and ties do not
arise. Very long texts are counted whole, and hold one chunk's offsets at a time. An empty table gives an empty result.
Ids are passed on as they are, null ones too. Only the two named columns are read, whatever else there is.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaforge.llm.bpe import default_path

FILE = "piece_bpe_32k.model"
#: Bytes of a chunk, and of the overlap of two at first.
CHUNK = 1 << 15
OVERLAP = 1 << 10
#: Texts handed to the tokenizer at once, at most about, in bytes.
PORTION = 1 << 22
LIMIT = 4096
SPACE = "▁"

#: ``(begin, end, piece)`` of each token, in bytes; pieces as the vocabulary has them.
Offsets = list[tuple[int, int, bytes]]


def adjacent_pairs(pieces: list[str]) -> set[str]:
    """Two characters each that are next to each other in some piece."""
    return {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}


class Counter:
    """Counts with one model; ``chunk`` and ``overlap`` are bytes."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [k for k in range(self.model.get_piece_size()) if not (self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_byte(k))]
        self.pairs = adjacent_pairs([self.model.id_to_piece(k) for k in plain])
        self.chunk, self.overlap = chunk, overlap

    def offsets(self, part: bytes) -> Offsets:
        found = self.model.encode(part, return_type="offset_mapping", return_bytes=True)
        return [(a, b, piece) for (a, b), piece in zip(found["offsets"], found["pieces"])]

    def stable(self, text: bytes, at: int, left: tuple[int, int, bytes], right: tuple[int, int, bytes]) -> bool:
        """Is the boundary of two tokens at ``at`` one that no merge can cross? Offsets are into ``text``."""
        sides = []
        for begin, end, piece in (left, right):
            shown = piece.decode()
            if shown.replace(SPACE, " ").encode() != text[begin:end] or begin == end:
                return False
            sides.append(shown)
        return sides[0][-1] + sides[1][0] not in self.pairs

    def boundaries(self, text: bytes, start: int, tokens: Offsets, low: int) -> dict[int, int]:
        """Place of each stable boundary after ``low``, with the number of the chunk's tokens before it."""
        out = {}
        for k in range(len(tokens) - 1, 0, -1):
            left, right = tokens[k - 1], tokens[k]
            at = start + right[0]
            if at <= low:
                break
            if left[1] == right[0] and self.stable(text[start : start + right[1]], at - start, left, right):
                out[at] = k
        return out

    def cut(self, text: bytes, at: int) -> int:
        """The next place from ``at`` on where a character starts."""
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        return min(at, len(text))

    def huge(self, text: bytes, seen: Callable[[int], None] = lambda width: None) -> int:
        """Tokens of a text of any length. ``seen`` is told the width of each overlap that was tried."""
        total, start, skipped = 0, 0, 0
        end = self.cut(text, self.chunk)
        tokens = self.offsets(text[:end])
        while end < len(text):
            # Tokens of this chunk before ``skipped`` are counted already.
            width = self.overlap
            following = self.cut(text, max(start + 1, end - width))
            until = self.cut(text, end + self.chunk)
            after = self.offsets(text[following:until])
            while True:
                seen(width)
                mine = self.boundaries(text, start, tokens, following)
                theirs = self.boundaries(text, following, after, following)
                both = [at for at in mine if at in theirs and mine[at] >= skipped]
                if both or end == until == len(text):
                    break
                # Nothing to splice at: the chunk goes on, and so does the next one, as far as it must.
                width *= 2
                end = self.cut(text, min(end + width, len(text)))
                tokens = self.offsets(text[start:end])
                if until < min(end + self.overlap, len(text)):
                    until = self.cut(text, end + self.chunk)
                    after = self.offsets(text[following:until])
            if not both:
                return total + len(tokens) - skipped
            at = max(both)
            total += mine[at] - skipped
            start, end, tokens, skipped = following, until, after, theirs[at]
        return total + len(tokens) - skipped

    def counts(self, texts: list[bytes]) -> list[int]:
        out = [0] * len(texts)
        held, size = [], 0

        def encode():
            found = self.model.encode([texts[i] for i in held], num_threads=1, return_type="numpy")
            for i, ids in zip(held, found):
                out[i] = len(ids)
            held.clear()

        for i, text in enumerate(texts):
            if len(text) > self.chunk:
                out[i] = self.huge(text)
            elif text:
                held.append(i)
                size += len(text)
                if size > PORTION:
                    encode()
                    size = 0
        if held:
            encode()
        return out


@functools.lru_cache(4)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def count_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row."""

    def run(batches):
        model = counter(path or default_path(FILE), chunk, overlap)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(model.counts(texts), pa.int64())], ["key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
