"""Packing, chat, near duplicates, nearest neighbours and the pipeline against brute force and edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyspark.sql.functions as F
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lumaforge.llm import chat, nearest, ngram_join, packing
from lumaforge.llm.queries import op8_chat_format
from lumaforge.llm.tables import WORD

SF_DIR = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "a", "one two three four", "one two three four five", "one two three four five six", "one two three four five", "x  \n y ", "a\n \nb ",
    "tail ", "end<|endoftext|>mid <|endoftext|>", "naïve 日本語 ẞ ɐ", "w " * 5_000, "long" * 9_000,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, i, "s") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], 1, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, length int, id string")


def check_sequences(rows, capacity=packing.CAPACITY):
    inside = collections.defaultdict(list)
    for r in rows:
        inside[r.sequence_id].append((r.offset, r.length))
    for parts in inside.values():
        parts.sort()
        at = 0
        for offset, length in parts:
            assert offset == at
            at += length
        assert at <= capacity
    return len(inside)


def test_packing_pieces_and_sequences(spark, odd):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000)
    frame = odd.select("doc_id", "text").unionByName(docs)
    rows = packing.pack(packing.pieces(frame)).collect()
    used = check_sequences(rows)
    assert used <= 1.02 * math.ceil(sum(r.length for r in rows) / packing.CAPACITY) + 1
    library = Tokenizer.from_file(public_tokenizers.path(packing.FILE))
    want = collections.Counter()
    for r in frame.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_packing_of_nothing(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 2049, 3000), np.minimum(2048, rng.lognormal(6, 1, 2000).astype(int) + 1), rng.integers(600, 700, 500),
               np.full(777, 683), np.array([2048] * 5 + [1] * 5), rng.integers(1, 50, 4000)][seed]
    counts = dict(collections.Counter(lengths.tolist()))
    plan = packing.make_plan(counts, groups=40)
    fill, seen = collections.defaultdict(list), collections.Counter()
    for length, rank, n, sequence, offset in plan.tolist():
        for i in range(n):
            fill[sequence + i].append((offset, length))
            seen[length, rank + i] += 1
    assert set(seen.values()) == {1} and len(seen) == len(lengths)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(fill) == max(fill) + 1
    bins = []
    for n in sorted(lengths.tolist(), reverse=True):  # first fit, falling
        k = next((k for k, room in enumerate(bins) if room >= n), None)
        if k is None:
            bins.append(2048 - n)
        else:
            bins[k] -= n
    assert len(fill) <= 1.06 * len(bins) + 2


def test_configurations_cover_and_fit():
    sizes, amounts = np.array([1500, 1100, 900, 700, 520]), np.array([10, 20, 35, 50, 11])
    found = packing.configurations(sizes, amounts, 2048)
    assert all(c @ sizes <= 2048 for c, _ in found)
    assert (sum(c * n for c, n in found) >= amounts).all()


CHAT = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo </s> [INST] \\[INST] <\\s> é日"), (1, 1, "assistant", "yo </s> [INST] \\[INST] <\\s> é日"), (1, None, "system", "<<SYS>>rules<</SYS>>"),
    (2, 0, None, None), (2, 1, "tool [/ROLE]\n<s>", "[TURN] [/TURN]<"), (2, 2, "assistant", ""), (3, 0, "assistant", "z" * 200_000),
    (None, 0, "user", "no id"), (None, 1, "assistant", "<"),
]


def test_chat_round_trip_and_digests(spark):
    rows = spark.createDataFrame([(*r, "x") for r in CHAT], "conv_id long, turn long, role string, text string, part string")
    formatted = chat.format_turns(rows).collect()
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(rows)).collect()}
    convs = collections.defaultdict(list)
    for c, turn, role, text in CHAT:
        convs[c].append((-1 if turn is None else turn, role or "", text or ""))
    for c, turns in convs.items():
        turns.sort()
        parts = sorted((r.part, r) for r in formatted if r.conv_id == c)
        assert [t for _, r in parts for t in chat.parse(r.formatted)] == [(role, text) for _, role, text in turns]
        learned = [chat.unescape(r.formatted[a:b]) for _, r in parts for a, b in zip(r.loss_starts, r.loss_ends)]
        assert learned == [text for _, role, text in turns if role == "assistant"]
        r = got[c]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(learned).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars) == (len(turns), sum(map(len, learned)))
        assert r.formatted_chars == sum(len(x.formatted) for _, x in parts)


def test_chat_escapes_are_reversible_and_leave_no_control_string():
    import itertools

    import pyarrow as pa

    controls = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]"]
    texts = ["".join(p) for p in itertools.product(["<", "\\", "/", "s>", "[", "INST]", "x"], repeat=4)] + controls
    for text, escaped in zip(texts, chat.escape(pa.array(texts)).to_pylist()):
        assert chat.unescape(escaped) == text and not any(c in escaped for c in controls)


def test_chat_query_adds_the_control_conversation(spark):
    rows = {r.conv_id: r for r in op8_chat_format(spark, SF_DIR).collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert rows[-7].loss_chars == len(said)


def shingle_set(text):
    words = re.findall(WORD, text or "")
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute_join(rows):
    """``doc_id -> (class_id, n_links, copy_of, n_copies)`` from all pairs."""
    sets, classes = {}, collections.defaultdict(list)
    for i, text in rows:
        sets[i] = shingle_set(text)
        classes[sets[i] or i].append(i)
    leaders = sorted({min(v) for v in classes.values()})
    parent, links = {i: i for i in leaders}, collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(leaders):
        for b in leaders[:k]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    out = {}
    for i in sets:
        members = classes[sets[i] or i]
        out[i] = find(min(members)), links[min(members)], min(members), len(members)
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates_equal_all_pairs(spark, odd, monkeypatch, block):
    """Two groups of near copies, one of them larger than a block."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    base = [f"w{k}" for k in range(120)]
    for i in range(40):
        words = list(base)
        for k in rng.choice(120, rng.integers(0, 5), replace=False):
            words[k] = f"v{rng.integers(3)}"
        rows.append((100 + i, " ".join(words)))
    for i in range(10):
        rows.append((200 + i, " ".join(f"u{k}" for k in range(i * 3, 100 + i * 3))))
    rows.append((5, TEXTS[5]))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string")
    got = ngram_join.join(frame).collect()
    assert len(got) == len(rows)
    want = brute_join(rows)
    for r in got:  # the row that is there twice is two copies
        assert (r.class_id, r.n_links, r.copy_of, r.n_copies) == want[r.doc_id]
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({v[0] for v in want.values()})


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_duplicates_with_shared_and_missing_ids(spark, kind):
    """Texts are compared whatever their ids: shared by several texts, null, or no numbers."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(60):
        words = list(base) if i % 3 else [f"z{i}_{k}" for k in range(30)]
        for k in rng.choice(len(words), rng.integers(0, 4), replace=False):
            words[k] = f"v{rng.integers(2)}"
        rows.append((None if i % 7 == 0 else int(i % 11), " ".join(words)))
    rows += [(1, "alpha beta gamma delta epsilon"), (1, "other text that is quite different here"), (2, "alpha beta gamma delta epsilon")]
    rows += [(None, "alpha beta gamma delta epsilon"), (None, "nobody else says these words"), (None, "nobody else says these words"), (None, None), (3, ""), (3, "")]
    if kind == "string":
        rows = [(None if i is None else f"id {i}", t) for i, t in rows]
    # By row number, as if each row had an id of its own; then by the smallest id in each class.
    plain = brute_join(list(enumerate(t for _, t in rows)))
    members = collections.defaultdict(list)
    for k, (c, *_) in plain.items():
        members[c].append(k)
    copies = collections.defaultdict(list)
    for k, v in plain.items():
        copies[v[2]].append(k)
    least = lambda ks: min((rows[k][0] for k in ks if rows[k][0] is not None), default=None)
    want = collections.Counter((rows[k][0], least(members[c]), n, least(copies[first]), m) for k, (c, n, first, m) in plain.items())
    frame = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    assert collections.Counter(map(tuple, ngram_join.join(frame).collect())) == want
    kept = ngram_join.keep_one(frame).collect()
    worded = [c for c in members if rows[c][1]]
    assert len(kept) == len(worded) + 3 and {(1, "other text that is quite different here"), ("id 1", "other text that is quite different here")} & set(map(tuple, kept))
    shown = collections.Counter(shingles_of(t) for _, t in map(tuple, kept) if t)
    for c in worded:
        assert sum(shown[shingles_of(rows[k][1])] for k in {j for j in members[c]}) >= 1
    assert collections.Counter((i, i is None) for i, t in map(tuple, kept) if t) == collections.Counter((least(members[c]), least(members[c]) is None) for c in worded)


def shingles_of(text):
    return frozenset(shingle_set(text))


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = brute_join([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: tuple(r)[1:] for r in ngram_join.join(docs).collect()} == want


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    need = ngram_join.needed()
    assert all(m < 0.8 * n for m, n in zip(need, range(16, 161, 16))) and need[-1] > 90
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(2000):
        matches = np.cumsum((rng.random(160) < 0.8).reshape(-1, 16).sum(1))
        lost += bool((matches < np.array(need)).any())
    assert lost == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(900, 500)], "a long, b long")
    got = {r.id: r.component for r in ngram_join.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 900: 500}


def brute_nearest(rows, divisor=20, k=20):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float)
    out = {}
    for i, q in ok.items():
        if i % divisor == 0:
            scores = sorted((-float((v * q).sum()), j) for j, v in ok.items() if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def test_nearest_verifies_a_part_of_the_vectors():
    """On all vectors of a table: the share that is verified, and the recall that is left."""
    import pyarrow.parquet as pq

    read = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, vectors = read["vec_id"].to_numpy(), np.array(read["embedding"].to_pylist(), float)
    asked = np.flatnonzero(ids % 20 == 0)
    cell = nearest.Cell(ids, vectors)
    hits = 0
    for i, (found, scores) in zip(asked, cell.search(ids[asked], vectors[asked], 20, np.full(len(asked), -np.inf))):
        exact = vectors @ vectors[i]
        exact[ids == ids[i]] = -np.inf
        hits += int((scores >= np.sort(exact)[-20] - 1e-12).sum())
    assert cell.verified <= 0.5 * len(asked) * len(ids)
    assert hits >= 0.93 * 20 * len(asked)


def test_nearest_prunes_data_with_structure():
    """Vectors near a plane: the tree alone spares most leaves, and nearly nothing is lost."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(6000, 2)) @ rng.normal(size=(2, 64)) + 0.01 * rng.normal(size=(6000, 64))
    vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
    ids = np.arange(6000)
    cell = nearest.Cell(ids, vectors)
    hits = 0
    for i, (found, scores) in zip(range(100), cell.search(ids[:100], vectors[:100], 20, np.full(100, -np.inf))):
        exact = vectors @ vectors[i]
        exact[i] = -np.inf
        hits += int((scores >= np.sort(exact)[-20] - 1e-12).sum())
    assert cell.verified < 0.1 * 100 * 6000 and hits > 0.9 * 2000


def test_nearest_refuses_ids_that_are_no_numbers(spark):
    with pytest.raises(ValueError):
        nearest.search(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"), F.lit(True))


def test_nearest_with_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [math.nan] + [1.0] * 7)]
    rows += [(2080, [None] + [1.0] * 7), (2100, [math.inf] * 8), (None, [1.0] * 8), (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), rows[3]]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, cell int")
    got = collections.defaultdict(list)
    for r in nearest.search(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    hits = total = 0
    for i, top in want.items():
        assert len(got[i]) == len(top)
        hits += len({j for j, _ in top} & {j for j, _ in got[i]})
        total += len(top)
        assert [s for _, s in got[i]] == sorted((s for _, s in got[i]), reverse=True)
    assert hits >= 0.95 * total


def test_nearest_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", 60)
    monkeypatch.setattr(nearest, "LEAF_ROWS", 8)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 10)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    rows += [(100_001 + i, rows[1][1]) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in nearest.search(frame, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    want = brute_nearest(rows)
    assert sum(len(got[i] & {j for j, _ in top}) for i, top in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_nearest_with_repeated_queries_and_shared_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    rows += [rows[20]] * 3 + [(40, rng.normal(size=8).tolist()), (7, rng.normal(size=8).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in nearest.search(frame, F.col("vec_id") % 20 == 0).collect():
        assert (r.rank, r.vec_id, round(r.score, 9)) not in got[r.query_id]
        got[r.query_id].add((r.rank, r.vec_id, round(r.score, 9)))
    once = [(i, np.array(v)) for i, v in {(i, tuple(v)) for i, v in rows}]
    want = collections.defaultdict(set)
    for i, q in once:
        if i % 20 == 0:
            scores = sorted((-float((v * q).sum()), j) for j, v in once if j != i)
            want[i] |= {(k + 1, j, round(-x, 9)) for k, (x, j) in enumerate(scores[:20])}
    assert len(got[20]) == 20 and len(got[40]) == 40 and {i: len(x) for i, x in got.items()} == {i: len(x) for i, x in want.items()}
    assert sum(len({x[1:] for x in got[i]} & {x[1:] for x in want[i]}) for i in want) >= 0.95 * sum(map(len, want.values()))


def test_nearest_of_nothing(spark):
    assert nearest.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_chi_square_quantile():
    assert abs(nearest.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = left
        left = corpus_pipeline.stored(stage(spark, left, SF_DIR), name)
        assert left.columns == docs.columns
        assert left.exceptAll(before).count() == 0
        if name == "ngram_jaccard":
            want = brute_join([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in left.collect()} == {v[0] for v in want.values()}
    rows = corpus_pipeline.STAGES[-1][1](spark, left, SF_DIR).collect()
    check_sequences(rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in left.collect()}
