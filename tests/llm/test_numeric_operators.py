"""Whitening, importance resampling and token counts against brute force, the library and edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyspark.sql.functions as F
import pytest
import sentencepiece

from check_queries import connect, rows_of
from lumaforge.llm import queries, resampling, token_counts, whitening
from lumaforge.llm.registry import ORACLES
from lumaforge.llm.tables import table

SF_DIR = "/root/testdata/sf0.001"
ODD_TEXTS = [
    None, "", " ", "a", "A b-c d_e", "x" * 90_000, "word " * 30_000, "naïve ÉA ñ ß İ ΣΑΣ 日本語", "\x00tab\t\n", "12 34 ab12", "<s> </s> <unk> ▁ ▁▁", "日" * 40_000,
    "Many words: " + " ".join(f"w{i}" for i in range(40)), "Many words: " + " ".join(f"w{i}" for i in range(40)), "a b " * 12,
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, equal texts, repeated rows, a null id, and extra columns with names used inside."""
    rows = [(i, t, 1, "k", 2.0) for i, t in enumerate(ODD_TEXTS)] + [(12, ODD_TEXTS[12], 1, "k", 2.0), (None, ODD_TEXTS[14], 1, "k", 2.0), (4, "other text of that id", 1, "k", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, rank int, key string, weight double")


# --- token counts -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_path(token_counts.FILE))


def test_token_counts_equal_library(spark, odd, library):
    docs = table(spark, SF_DIR, "documents")
    for frame in (odd, docs):
        texts = [(r.doc_id, r.text or "") for r in frame.collect()]
        counts = [(k, len(t.encode()), len(library.encode(t))) for k, t in texts]
        want = collections.Counter((k, b, n, n > 4096) for k, b, n in counts)
        assert collections.Counter(map(tuple, token_counts.count_tokens(frame).collect())) == want
        small = token_counts.count_tokens(frame, chunk=512, overlap=16)
        assert collections.Counter(map(tuple, small.collect())) == want


def test_token_counts_of_random_texts(library):
    rng = random.Random(1)
    parts = ["a", "x", "é", "日", "本", " ", "  ", "\n", "\t", "\x00", "　", "<s>", "▁", "𐍈", "the ", " of", "<0x0A>", "!", "??", "�"]
    for _ in range(1500):
        some = parts[: rng.randint(1, len(parts))]
        text = "".join(rng.choice(some) * rng.choice((1, 1, 1, 2, 9, 40)) for _ in range(rng.randint(8, 60))).encode()
        model = token_counts.counter(token_counts.default_path(token_counts.FILE), rng.choice((16, 32, 64)), rng.choice((4, 8)))
        assert model.huge(text) == len(library.encode(text)), text


def test_overlaps_widen_until_a_boundary_is_proven(library):
    model = token_counts.Counter(token_counts.default_path(token_counts.FILE), chunk=256, overlap=16)
    widths: list[int] = []
    text = (b"word " * 100) + b"x" * 2_000 + (b" word" * 100)
    assert model.huge(text, widths.append) == len(library.encode(text))
    assert max(widths) > 500 and min(widths) == 16
    assert " w" not in model.pairs and "▁w" in model.pairs and "x▁" not in model.pairs


def test_token_counts_of_empty_table(spark):
    out = token_counts.count_tokens(spark.createDataFrame([], "doc_id string, text string"))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == 0


# --- importance resampling ----------------------------------------------------------------------


def plain_resample(docs, target, words=(1, 1), buckets=10_000, least=20, percent=10, seed=2024):
    """Rows of (id, n_features, weight, score, rank), straight from the definition."""

    def features(text):
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        found = [" ".join(w[i : i + k]) for k in range(words[0], words[1] + 1) for i in range(len(w) - k + 1)]
        return len(w), [zlib.crc32(f.encode()) % buckets for f in found]

    of = [(k, *features(t)) for k, t in docs]
    s = collections.Counter(b for _, _, f in of for b in f)
    t = collections.Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    rows = []
    for k, n, f in of:
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((k, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = percent * len(order) // 100
    out = [(*r, i + 1 if i < drawn else None) for i, r in enumerate(order)] + [(*r, None) for r in rows if r[1] < least]
    return collections.Counter((k, f, w, score, rank) for k, _, f, w, score, rank in out)


@pytest.mark.parametrize("options", [{}, {"words": (1, 2), "buckets": 97, "percent": 50, "seed": 1}, {"words": (2, 3), "least_words": 1, "percent": 100}])
def test_resampling_equals_definition(spark, odd, options):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100)
    target = table(spark, SF_DIR, "benchmark")
    for frame in (odd, docs):
        got = resampling.resample(frame, target, **options).select("doc_id", "n_features", "weight", "score", "rank")
        plain = {"least" if k == "least_words" else k: v for k, v in options.items()}
        want = plain_resample([(r.doc_id, r.text) for r in frame.collect()], [r.text for r in target.collect()], **plain)
        assert collections.Counter(map(tuple, got.collect())) == want


def test_resampling_equals_sql(spark):
    got = queries.op12_importance_resampling(spark, SF_DIR)
    cur = connect(SF_DIR).execute(ORACLES["op12_importance_resampling"])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_crc_by_matrices_and_rows():
    rng = random.Random(2)
    features = [rng.randbytes(rng.choice((0, 1, 1, 1, 2, 3, 8, 8, 70))) for _ in range(300)]
    assert resampling.crcs(features).tolist() == [zlib.crc32(f) for f in features]


def test_words_and_runs_are_the_same_in_any_portions(monkeypatch):
    text = ("Ab c, 日本 d-e " * 50).encode()
    whole = [f for _, found in resampling.features_of(text, (1, 3)) for f in found]
    monkeypatch.setattr(resampling, "PORTION", 16)
    parts = [found for _, found in resampling.features_of(text, (1, 3))]
    assert len(parts) > 20 and collections.Counter(f for p in parts for f in p) == collections.Counter(whole)


def test_a_full_table_of_features_is_emptied(monkeypatch):
    monkeypatch.setattr(resampling, "TABLE_SIZE", 10)
    hashed = resampling.Buckets(1000)
    for start in range(0, 60, 7):
        features = [b"%d" % i for i in range(start, start + 9)] + [b"y" * 200]
        assert hashed.of(features).tolist() == [zlib.crc32(f) % 1000 for f in features]
        assert len(hashed.known) <= 10


def test_resampling_of_empty_tables(spark, odd):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, table(spark, SF_DIR, "benchmark")).count() == 0
    got = resampling.resample(odd, none).select("doc_id", "n_features", "weight", "score", "rank")
    assert collections.Counter(map(tuple, got.collect())) == plain_resample([(r.doc_id, r.text) for r in odd.collect()], [])


def test_drawn_documents_keep_their_columns(spark):
    docs, target = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "benchmark")
    drawn = resampling.drawn_only(docs, target)
    ids = {r.doc_id for r in resampling.resample(docs, target).where("rank IS NOT NULL").collect()}
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == ids and ids


# --- whitening ----------------------------------------------------------------------------------


def plain_whitening(rows, components=4):
    """By the library's own eigenvectors of the covariance."""
    x = np.floor(256 * np.array([v for _, v in rows], np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1][:, :components]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return n, deviation, values, (x - sums / n) @ vectors / np.sqrt(values[:components])


def test_whitening_equals_eigenvectors(spark):
    frame = table(spark, SF_DIR, "embeddings").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    n, deviation, values, whitened = plain_whitening(rows)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(frame).collect()}
    assert len(got) == 4 * len(rows)
    for k in range(4):
        mine = np.array([got[i, k + 1].whitened for i, _ in rows])
        sign = np.sign(mine @ whitened[:, k])
        np.testing.assert_allclose(sign * mine, whitened[:, k], atol=1e-9)
        first = got[rows[0][0], k + 1]
        assert first.explained == pytest.approx(values[k] / values.sum(), rel=1e-12)
        assert first.identity_error < 1e-10 and first.n == n
    assert [got[i, 1].deviation for i, _ in rows] == deviation


def test_whitening_of_odd_rows(spark):
    """Repeated vectors count once in the fit; null, empty and broken ones take no part; a null id is an id."""
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(40, 3)).round(3)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(50, vectors[0]), (50, vectors[0]), (None, vectors[1])]
    bad = [(60, None), (61, []), (62, [1.0, None, 2.0]), (63, [float("nan"), 0.0, 0.0]), (64, [float("inf"), 0.0, 0.0])]
    other = [(70, [1.0, 0.0]), (71, [0.0, 1.0]), (72, [3.0, 5.0]), (73, [9.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows + bad + other], "vec_id long, embedding array<double>, n int, component string")
    got = collections.defaultdict(list)
    for r in whitening.whiten(frame).collect():
        got[r.vec_id].append(r)
    n, deviation, values, whitened = plain_whitening(rows, 3)
    assert n == 40 and not {60, 61, 62, 63, 64, 73} & set(got)
    assert sorted(r.component for r in got[50]) == [1, 1, 2, 2, 3, 3] and sorted(r.component for r in got[70]) == [1, 2]
    for (key, _), d, w in zip(rows, deviation, whitened):
        for r in got[key]:
            assert r.deviation == d and abs(r.whitened) == pytest.approx(abs(w[r.component - 1]), abs=1e-9)
    assert all(r.n == 3 for r in got[70])


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whiten(spark.createDataFrame(rows, schema))
        assert out.count() == 0 and out.columns[0] == "vec_id"


def test_huge_entries_and_deviations():
    x = whitening.integers(np.array([[1e300, -1e300, 0.5, -0.001, 2.0**54]]))
    assert x.tolist() == [[2**63 - 1, -(2**63), 128, -1, 2**62]]
    model = whitening.Model(3, [10**18, 5], 1.0, np.ones(1), np.ones((2, 1)))
    assert model.deviations(np.array([[1, 2], [4 * 10**17, 2]])) == [None, None]
    model = whitening.Model(3, [3, 5], 1.0, np.ones(1), np.ones((2, 1)))
    assert model.deviations(np.array([[1, 2], [10**6, -2]])) == [1, (3 * 10**6 - 3) ** 2 + 121]
    for row in ([1, -128], [300], [-40_000, 7], [1 << 40]):
        assert whitening.unpacked(whitening.packed(np.array(row))).tolist() == row


def test_jacobi_on_the_pivoted_factor():
    """Small eigenvalues keep their relative precision; ranks below the size are found."""
    rng = np.random.default_rng(5)
    turn, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    for scale in (np.logspace(0, -4, 9), np.array([3.0, 3.0, 1, 1, 1, 0.5, 0, 0, 0])):
        scatter = (turn * scale**2) @ turn.T
        factor = whitening.pivoted_cholesky(scatter)
        assert factor.shape[1] == (scale > 0).sum()
        np.testing.assert_allclose(factor @ factor.T, scatter, atol=1e-14)
        values, columns = whitening.one_sided_jacobi(factor)
        np.testing.assert_allclose(values, scale[scale > 0] ** 2, rtol=1e-6)
        np.testing.assert_allclose(columns.T @ columns, np.eye(len(values)), atol=1e-12)


def test_merged_moments_equal_those_of_all_rows():
    rng = np.random.default_rng(6)
    rows = rng.integers(-1000, 1000, (500, 5)) + 10**6
    parts = [whitening.Moments.of(p) for p in np.array_split(rows, 7)]
    total = parts[0]
    for p in parts[1:]:
        total = total.add(p)
    centred = rows - rows.mean(0)
    assert total.n == 500 and total.sums == rows.sum(0).tolist()
    np.testing.assert_allclose(total.scatter, centred.T @ centred, rtol=1e-9)
