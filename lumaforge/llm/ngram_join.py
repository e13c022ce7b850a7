"""N-gram Jaccard join: minhash candidates, Bayesian pruning, exact verification.

Texts are sets of five-word shingles; a text of one to four words is one shingle, a text without words has none
and is linked to nothing. Two texts are linked if their sets have a Jaccard similarity of 0.8 or more.

1. Texts with equal sets are copies of each other and go on as one, under a number of its own: ids play no part in
   what is compared, so different texts may share one, and it may be of any type.
2. ``HASHES`` minhash values per text; bands of ``ROWS`` values are candidate buckets. A pair of similarity
   0.8 shares no bucket with a probability of 3e-6.
3. Pairs in a bucket are compared by sixteen more values at a time. With a uniform prior, the posterior of the
   similarity after m matches in n is a beta law; a pair is dropped when the probability of 0.8 or more
   falls below ``TOLERANCE``. A pair in several buckets is compared in the first only.
4. Surviving pairs join texts to components, within which shingle sets are intersected exactly. Only counts and
   a spanning star leave a task, never a list of pairs.

Buckets and components above ``BLOCK`` texts are cut into blocks, and each pair of blocks is a group of its own,
so no task holds more than two blocks. Shingles are compared by 64-bit hashes.

Repeated rows are copies. A null text is a text without words. A row without an id is compared like any other; it gives
a class its name only if no member has an id, and that name is null. An empty table gives an empty result. Texts are used
whole; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaforge.llm.tables import WORD, release, stored

SHINGLE = 5
#: The similarity from which on texts are linked, as a fraction.
LIKE, OF = 4, 5
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512
#: Bits of the filter that spares texts outside all components, at most; 8 MB.
FILTER_BITS = 1 << 26
#: Pairs compared at once.
PAIRS = 1 << 17
#: A shingle in more texts of a group than this is counted by a matrix product, else by pairs.
DENSE = 16
#: Words whose hash a worker keeps; a full table is emptied.
TABLE_SIZE = 500_000
LONGEST_KEPT = 64

_WORD = re.compile(WORD)
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def needed() -> list[int]:
    """Fewest matches after each step with which a pair stays.

    P(similarity >= t | m of n) is the chance that n + 1 draws of probability t give at most m.
    """
    t = LIKE / OF
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < TOLERANCE:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONGEST_KEPT:
            self[word] = value
        return value


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = _WORD.findall(text or "")
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(hashes) > TABLE_SIZE:
        hashes.clear()
    size = min(SHINGLE, len(h))
    rolled = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * _MIX + h[k : len(h) - size + 1 + k]
    rolled = (rolled ^ (rolled >> np.uint64(32))) * _MIX
    return np.unique(rolled ^ (rolled >> np.uint64(29)))


def signature(found: np.ndarray) -> np.ndarray:
    """Sixteen bits of each minhash value. The minimum is over all 64 bits, so long texts do not crowd."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 512):
        least = np.minimum(least, (found[start : start + 512, None] * _FACTORS).min(0))
    return ((least * _MIX) >> np.uint64(48)).astype(np.uint16)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key per band, from the band's number and values."""
    bands = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2]).copy()
    for r in range(ROWS):
        keys = (keys ^ (keys >> np.uint64(31))) * _MIX + bands[:, :, r]
    keys = (keys ^ (keys >> np.uint64(32))) * _MIX
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def _columns(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, text, fp``; the fingerprint tells rows apart, and those that share one are told apart by their digest."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.withColumn("fp", _fingerprint(F.col("id"), F.col("text")))


def _fingerprint(key: Column, text: Column) -> Column:
    return F.xxhash64(key, key.isNull(), text)


def signed(rows: DataFrame) -> DataFrame:
    """``id, fp, same, size, sig``: a digest of the shingle set, its size, and the signature."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            same, sizes, sigs = [], [], []
            for value in batch.column(1):
                found = shingles(value.as_py(), hashes)
                same.append(_digest(found))
                sizes.append(len(found))
                sigs.append(signature(found).tobytes())
            columns = [batch.column(0), batch.column(2), pa.array(same, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "fp", "same", "size", "sig"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp long, same binary, size int, sig binary")


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from sorted batches, with the first row of each group; what is cut waits for more."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
        firsts = _firsts(table, keys)
        if firsts[-1]:
            yield table.slice(0, firsts[-1]), firsts[:-1]
        rest = table.slice(firsts[-1])
    if rest is not None:
        yield rest.combine_chunks(), np.zeros(1, np.int64)


def _firsts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def candidate_pairs(firsts: np.ndarray, n: int, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same group, in portions. Sides 0 and 1 meet each other only, side 2 meets itself."""
    ends = np.append(firsts[1:], n)
    end_of = np.repeat(ends, ends - firsts)
    rows = np.arange(n)
    left, right, held = [], [], 0
    for d in range(1, int((ends - firsts).max())):
        rows = rows[rows + d < end_of[rows]]
        other = rows + d
        fit = (side[rows] == 2) | (side[rows] != side[other])
        left.append(rows[fit])
        right.append(other[fit])
        held += int(fit.sum())
        if held > PAIRS:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def unpruned(a: np.ndarray, b: np.ndarray, sigs: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that share no earlier bucket and whose similarity may still reach the threshold."""
    matches = np.zeros(len(a), np.int64)
    later = np.ones(len(a), bool)
    for k in range(BANDS):
        part = slice(k * ROWS, (k + 1) * ROWS)
        ask = np.flatnonzero(later & (band[a] > k))
        if not len(ask):
            break
        later[ask[(sigs[a[ask], part] == sigs[b[ask], part]).all(1)]] = False
    a, b = a[later], b[later]
    matches = np.zeros(len(a), np.int64)
    for step, least in enumerate(needed()):
        part = slice(step * STEP, (step + 1) * STEP)
        matches += (sigs[a, part] == sigs[b, part]).sum(1)
        stay = matches >= least
        a, b, matches = a[stay], b[stay], matches[stay]
    return a, b


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of ``n`` nodes the smallest node of its component, given links and what is known so far."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def tiles(rows: DataFrame, group: str) -> DataFrame:
    """Adds ``lo, hi, side``: rows of a group of ``n`` in blocks, one copy for each pair of blocks it is in."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    spread = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("_mine") == F.col("_other"), 2).when(F.col("_mine") < F.col("_other"), 0).otherwise(1)
    out = spread.withColumns({
        "lo": F.least("_mine", "_other"), "hi": F.greatest("_mine", "_other"), "side": side.cast("int"),
    }).drop("_mine", "_other", "n")
    return out.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", "id")


def candidates(signs: DataFrame) -> DataFrame:
    """Edges ``a > b`` that connect the texts whose pairs survive the pruning, from ``id, sig``."""

    def keys(batches):
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            columns = [pa.array(np.repeat(batch.column("id").to_numpy(), BANDS)), pa.array(band_keys(sigs).ravel())]
            columns.append(pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sigs))))
            yield pa.RecordBatch.from_arrays(columns, ["id", "bucket", "band"])

    buckets = signs.mapInArrow(keys, "id long, bucket long, band int")
    shared = buckets.groupBy("bucket").agg(F.count("id").alias("n")).where("n > 1")
    crowded = buckets.join(shared, "bucket").join(signs, "id")

    def compare(batches):
        for table, firsts in whole_groups(batches, ["bucket", "lo", "hi"]):
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            ids, band, side = (table.column(c).to_numpy() for c in ("id", "band", "side"))
            label = np.arange(len(ids))
            for a, b in candidate_pairs(firsts, len(ids), side):
                a, b = unpruned(a, b, sigs, band)
                label = smallest_linked(len(ids), a, b, label)
            linked = np.flatnonzero(label != np.arange(len(ids)))
            x, y = ids[linked], ids[label[linked]]
            columns = [pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return tiles(crowded, "bucket").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id) for every id in edges ``a, b``.

    Each round takes the least label among neighbors and then the label's own label, until nothing changes; both
    are joins with minima, so a node with many neighbors is no special case.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other"))
    both = stored(both.union(both.select("other", "id")).distinct(), "links")
    labels = both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component"))
    labels = stored(labels, "labels")
    while True:
        named = labels.select(F.col("id").alias("other"), F.col("component").alias("near"))
        nearest = both.join(named, "other").groupBy("id").agg(F.min("near").alias("near"))
        hooked = labels.join(nearest, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        target = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        jumped = hooked.join(target, "component", "left")
        new = stored(jumped.select("id", "was", F.coalesce("further", "component").alias("component")), "labels")
        if new.where("was != component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def intersections(owner: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """How many cells each pair of ``n`` owners shares."""
    order = np.argsort(cell, kind="stable")
    cell, owner = cell[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    count = np.diff(np.append(first, len(cell)))
    each = np.repeat(count, count)
    out = np.zeros((n, n))
    rare = (each > 1) & (each <= DENSE)
    o, c = owner[rare], cell[rare]
    for d in range(1, DENSE):
        same = c[:-d] == c[d:]
        if not same.any():
            break
        x, y = np.minimum(o[:-d][same], o[d:][same]), np.maximum(o[:-d][same], o[d:][same])
        out += np.bincount(x * n + y, minlength=n * n).reshape(n, n)
    out += out.T
    dense = each > DENSE
    o = owner[dense]
    column = np.repeat(np.arange((count > DENSE).sum()), count[count > DENSE])
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        block = np.zeros((n, 4096), np.float32)
        block[o[a:b], column[a:b] - start] = 1
        out += block @ block.T
    return out


def verified(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Per text and task ``id, links, root``: verified links, and the smallest text they connect it to there.

    ``members`` has ``id`` (the text's number), ``fp`` (of a row that bears it), ``same``, ``component, n``. So that no other
    text moves, a Bloom filter of the fingerprints, of bounded size, picks the rows whose shingles are computed again, a
    repeated row once per task; the join that follows is exact.
    """
    bits = min(FILTER_BITS, max(1 << 10, 1 << (16 * members.count()).bit_length()))
    ways = [F.pmod(F.xxhash64("fp", F.lit(k)), F.lit(bits)) for k in range(2)]
    marks = members.select(F.explode(F.array(*ways)).alias("bit"))
    words = marks.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(bits >> 6, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    known = rows.sparkSession.sparkContext.broadcast(table)

    def sets(batches):
        hashes = WordHashes()
        seen: set[int] = set()
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for way in ("a", "b"):
                bit = batch.column(way).to_numpy().astype(np.uint64)
                hit &= (known.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            prints = batch.column("fp").to_numpy()
            for k in np.flatnonzero(hit).tolist():
                if int(prints[k]) in seen:
                    hit[k] = False
                elif len(seen) < TABLE_SIZE:
                    seen.add(int(prints[k]))
            batch = batch.filter(pa.array(hit))
            found = [shingles(t.as_py(), hashes) for t in batch.column("text")]
            columns = [batch.column("fp"), pa.array(map(_digest, found), pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["fp", "same", "found"])

    sought = rows.select("fp", "text", ways[0].alias("a"), ways[1].alias("b"))
    shingled = sought.mapInArrow(sets, "fp long, same binary, found binary").join(members, ["fp", "same"])

    def compare(batches):
        for table, firsts in whole_groups(batches, ["component", "lo", "hi"]):
            ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
            ends = np.append(firsts[1:], len(ids))
            roots, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            found = table.column("found")
            for start, end in zip(firsts.tolist(), ends.tolist()):
                m = end - start
                if m < 2:
                    continue
                parts = [np.frombuffer(x.as_py(), np.uint64) for x in found.slice(start, m)]
                size = np.array([len(p) for p in parts])
                owner = np.repeat(np.arange(m), size)
                both = intersections(owner, np.concatenate(parts), m)
                like = OF * both >= LIKE * (size[:, None] + size[None, :] - both)
                s = side[start:end]
                like &= (s[:, None] == 2) | (s[:, None] != s[None, :])
                own = ids[start:end]
                again = np.concatenate([[False], own[1:] == own[:-1]])  # a row that is repeated in several tasks
                like &= ~(again[:, None] | again[None, :])
                np.fill_diagonal(like, False)
                links[start:end] = like.sum(1)
                a, b = np.nonzero(np.triu(like))
                roots[start:end] = start + smallest_linked(m, a, b)
            # Whatever the order of rows, the root is the smallest id.
            least = ids.copy()
            np.minimum.at(least, roots, ids)
            columns = [pa.array(ids), pa.array(links), pa.array(least[roots])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "links", "root"])

    kept = shingled.select("id", "component", "n", "found")
    return tiles(kept, "component").mapInArrow(compare, "id long, links long, root long")


def classified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(signs, about)`` of ``id, text, fp``: the stored signatures of all rows, and what is known of each text with words.

    ``about`` has ``same, copy_of, n_copies, node, class, class_id, n_links``; ``class`` is a number, since two classes may bear
    the same smallest id.
    """
    signs = stored(signed(rows), "signatures")
    worded = signs.where("size > 0")
    # Copies of a text meet here; Spark puts them together within each task first.
    copies = worded.groupBy("same").agg(
        F.min("id").alias("copy_of"), F.count("fp").alias("n_copies"), F.min("fp").alias("fp"), F.any_value("sig").alias("sig")
    )
    nodes = stored(copies.withColumn("node", F.monotonically_increasing_id()), "texts")
    found = components(candidates(nodes.select(F.col("node").alias("id"), "sig")))
    sizes = found.groupBy("component").agg(F.count("id").alias("n"))
    members = found.join(sizes, "component").join(nodes.select(F.col("node").alias("id"), "fp", "same"), "id")
    members = stored(members, "members")
    links = stored(verified(members, rows), "verified")
    counts = links.groupBy("id").agg(F.sum("links").cast("long").alias("n_links"))
    linked = components(links.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    texts = nodes.select("same", "copy_of", "n_copies", F.col("node").alias("id"))
    about = texts.join(counts, "id", "left").join(linked, "id", "left")
    about = about.select(
        "same", "copy_of", "n_copies", F.col("id").alias("node"), F.coalesce("component", "id").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    # Most texts are a class of their own; only linked ones meet to find the smallest id.
    alone = about.join(linked.select(F.col("id").alias("node")), "node", "left_anti").withColumn("class_id", F.col("copy_of"))
    grouped = about.join(linked.select(F.col("id").alias("node")), "node", "left_semi")
    least = grouped.groupBy("class").agg(F.min("copy_of").alias("class_id"))
    about = stored(alone.unionByName(grouped.join(least, "class")), "classes")
    release(nodes, members, links)
    return signs, about


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, class_id, n_links, copy_of, n_copies`` of every row.

    ``copy_of`` is the smallest id with the same shingles and ``n_copies`` the number of rows with them;
    ``n_links`` counts the other texts it is linked to, copies of one text being one; ``class_id`` is the smallest
    id reached over links and copies. A text without words is a class of its own.
    """
    signs, about = classified(_columns(docs, key, text))
    known = about.withColumn("_worded", F.lit(True))
    out = signs.select("id", "same").join(known, "same", "left")
    own = F.col("_worded").isNull()
    return out.select(
        F.col("id").alias(key), F.when(own, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(own, F.col("id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest id, with its columns unchanged.

    Different texts under one id are different documents; where one belongs to the class and another does not, both are looked
    at alone. Of rows that repeat id and text one stays. Documents without words are linked to nothing and all stay.
    """
    signs, about = classified(_columns(docs, key, text))
    placed = signs.where("size > 0").join(about.select("same", "class"), "same")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "fp"))
    chosen = placed.groupBy("class").agg(first.alias("f")).select(F.col("f.id").alias("_id"), F.col("f.fp").alias("_fp"))
    printed = docs.withColumn("_fp", _fingerprint(F.col(key), F.col(text)))
    found = chosen.alias("c")
    same_row = (F.col("_doc._fp") == F.col("c._fp")) & F.col(f"_doc.{key}").eqNullSafe(F.col("c._id"))
    kept = printed.alias("_doc").join(found, same_row, "left_semi").where(_worded(F.col(text))).dropDuplicates([key, "_fp"]).drop("_fp")
    return kept.unionByName(docs.where(~_worded(F.col(text))))


def _worded(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(WORD)
