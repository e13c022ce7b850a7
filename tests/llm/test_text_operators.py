"""Tokens, quality rules, languages, toxicity, language model and HTML against brute force and edge cases."""

import collections
import hashlib
import math
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
from tokenizers import Tokenizer

from lumaforge.llm import bpe, html_text, language_id, lm_scoring, quality_rules, toxicity
from lumaforge.llm.queries import QUALITY_SQL, op6_lm_score, remainder
from lumaforge.llm.tables import WORD

SF_DIR = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None, "", "   ", " \n\t\x0b ", "a", "a b", "a a a a a a", "x" * 30_000, "word " * 6_000, "naïve Éa ñ ß İ ΣΑΣ", "日本語 テキスト", "12 34 . !",
    "same line\nsame line\nother", "a\x1cb \x85c\xa0d  e", "a<|endoftext|>b <|startoftext|>", "#$% &|<> ***", "it's I'LL don't", "tail ", "  lead",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns that clash with names used inside."""
    rows = [(i, t, "en", "x", 1, "y") for i, t in enumerate(ODD_TEXTS)] + [(5, "a b", "fr", "x", 1, "y"), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, n_words int, row string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_bpe_equals_library(odd, docs):
    library = Tokenizer.from_file(bpe.default_path(bpe.FILE))
    for frame in (odd, docs):
        texts = [(r.doc_id, r.text) for r in frame.collect()]
        want = collections.Counter()
        for key, text in texts:
            ids = library.encode(text or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            packed = np.array(ids, "<u4").tobytes()
            want[key, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
        assert collections.Counter(map(tuple, bpe.digests(frame).collect())) == want


def test_bpe_round_trip_through_columns(odd):
    encoder = bpe.Encoder(bpe.default_path(bpe.FILE))
    encoded = bpe.encode(odd)
    decoded = bpe.decode(encoded)
    got = collections.Counter(map(tuple, decoded.collect()))
    want = collections.Counter((r.doc_id, encoder.round_trip(r.text or "")[1].decode()) for r in odd.collect())
    assert got == want


def test_bpe_merge_takes_lowest_rank_then_leftmost():
    encoder = bpe.Encoder(bpe.default_path(bpe.FILE))
    library = Tokenizer.from_file(bpe.default_path(bpe.FILE))
    for word in ("a" * 999, "abab" * 200, "thethethe" * 50, "zzzzzzq"):
        assert list(np.frombuffer(encoder.encode(word), "<u4")) == library.encode(word, add_special_tokens=False).ids


def brute_quality(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [s for s in text.split("\n") if re.search(WORD, s)]
    windows = list(zip(words, words[1:], words[2:]))
    counts = collections.Counter(windows)
    hit = set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit |= {i, i + 1, i + 2}
    chars, symbols, dup = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    base = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    bad = base or 10 * symbols > len(words) or 2 * dup > len(lines) or chars < 2 * len(words) or chars > 15 * len(words)
    return len(words), chars, symbols, dup, len(hit), base, not bad


def test_quality_rules_equal_brute_force(odd, docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for frame in (odd, docs):
        got = collections.Counter((r.doc_id, *(r[n] for n in names)) for r in quality_rules.annotate(frame).collect())
        assert got == collections.Counter((r.doc_id, *brute_quality(r.text)) for r in frame.collect())


def test_quality_cascade_order_does_not_change_the_verdict(docs):
    kept = {r.doc_id for r in quality_rules.keep(docs).collect()}
    assert kept == {r.doc_id for r in docs.collect() if brute_quality(r.text)[-1]}
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        found = docs.where(quality_rules.rejected_by(docs["text"], list(rules)).isNull())
        assert {r.doc_id for r in found.collect()} == kept


def test_quality_plan_is_by_rejection_per_cost(docs, monkeypatch):
    rules = quality_rules.RULES[:3]
    costs = [quality_rules.Measured(r, s, n) for r, s, n in zip(rules, (1.0, 0.1, 2.0), (50, 50, 0))]
    monkeypatch.setattr(quality_rules, "measure", lambda *a: costs)
    assert [r.name for r in quality_rules.plan(docs)] == [rules[1].name, rules[0].name, rules[2].name]


def test_quality_is_native(docs):
    plan = quality_rules.annotate(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_sql_has_the_same_rules():
    for rule in ("n_words < 50", "10 * n_symbols > n_words", "2 * n_dup_lines > n_lines", "word_chars > 15 * n_words"):
        assert rule in QUALITY_SQL


def test_language_scores_equal_a_plain_classifier(docs):
    names, table = language_id.train(docs)
    assert names == sorted({r.lang for r in docs.collect()})

    def windows(text):
        plain = "".join(map(chr, language_id.letters(text)))
        return [plain[i : i + n] for n in language_id.ORDERS for i in range(len(plain) - n + 1)]

    cell = {}

    def cell_of(gram):
        if gram not in cell:
            codes = np.array([ord(c) for c in gram], np.uint32)
            cell[gram] = int(language_id.cells(codes, len(table) - 1)[-1])
        return cell[gram]

    rows = docs.collect()
    counts = {k: collections.Counter() for k in names}
    for r in rows:
        counts[r.lang].update(map(cell_of, windows(r.text)))
    size = len(table) - 1
    prior = collections.Counter(r.lang for r in rows)
    for r in rows[:40]:
        logs = []
        for k in names:
            total = sum(counts[k].values()) + size * language_id.SMOOTHING
            logs.append(math.log(prior[k] + 0.5) + sum(math.log((counts[k][c] + 0.5) / total) for c in map(cell_of, windows(r.text))))
        best, score = language_id.score([r.text], names, table)
        top = int(np.argmax(logs))
        assert best[0] == names[top]
        assert abs(score[0] - 1 / sum(math.exp(x - logs[top]) for x in logs)) < 1e-3


def test_language_held_out_accuracy_and_edges(docs, odd, spark):
    model = language_id.train(docs, where=remainder(4) != 2)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    test = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in test]) > 0.95
    for r in language_id.predict(odd, model).collect():
        text = ODD_TEXTS[r.doc_id] if r.doc_id is not None else "no id"
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or ""))) and 0 <= r.score <= 1
    empty = language_id.train(docs.limit(0))
    assert {tuple(r) for r in language_id.predict(docs.limit(3).select("doc_id", "text"), empty).select("lang_pred", "score").collect()} == {("und", 0.0)}


def test_language_chunks_lose_no_window(monkeypatch):
    codes = language_id.letters("abcdefgh " * 40)
    whole = np.bincount(language_id.cells(codes, 256), minlength=256)
    monkeypatch.setattr(language_id, "CHUNK", 50)
    parts = sum(np.bincount(language_id.cells(c, 256), minlength=256) for c in language_id._chunks(codes))
    assert (parts >= whole).all() and parts.sum() - whole.sum() < 0.1 * whole.sum()


def test_toxicity_learns_insults_and_their_misspellings():
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeinorst"), rng.integers(3, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, rng.integers(20, 200)))
        if i % 4 == 0:
            words[rng.integers(len(words))] = ["blockhead", "blockheads", "dumbwit"][i % 3]
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, np.array(labels))
    scorer = toxicity.Scorer(model)
    got = np.array(scorer.score(texts)) >= toxicity.THRESHOLD
    assert (got == np.array(labels, bool)).mean() > 0.98
    hidden = " ".join(plain[:300]) + " blokhead " + " ".join(plain[:300])
    clean = " ".join(plain[:300] * 2)
    assert scorer.score([hidden])[0] > 3 * scorer.score([clean])[0]
    once, repeated = (model.word_numbers(["blockhead"])[0] for _ in range(2))
    assert once == repeated


def test_toxicity_edges(spark, docs, odd):
    labels = spark.createDataFrame([(i, None if i == 3 else i % 2) for i in range(150)] + [(0, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, where=remainder(3) != 1, train_rows=30)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    twice = [r.score for r in rows if r.doc_id == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    kept = toxicity.keep(odd, model)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score < toxicity.THRESHOLD}
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r.score < 1e-9 for r in toxicity.score(odd, nothing).collect()} == {True}
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_sample_is_of_documents_that_are_there(spark, monkeypatch):
    rows = [(i, "you rotten idiot" if i % 2 else "a calm sunny day") for i in range(40)] + [(i, None) for i in range(40, 80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i < 40 else 1) for i in range(2_000)], "doc_id long, toxic int")
    want = toxicity.train(frame, labels.where("doc_id < 40"), train_rows=10)
    got = toxicity.train(frame, labels, train_rows=10)
    assert (got.empty, got.bias) == (want.empty, want.bias) and got.empty == 0.5 and np.array_equal(got.weight, want.weight)
    for label in (0, 1):
        one = toxicity.train(frame, labels.where(f"doc_id < 40 AND toxic = {label}"))
        assert {r.score < 1e-9 for r in toxicity.score(frame, one).collect()} == {True}


def brute_tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b""]


def test_lm_base_counts_and_likelihood(docs, odd, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", 300)
    frame = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = frame.collect()
    trained = [r for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    counts = collections.Counter(w for r in trained for w in brute_tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    got = lm_scoring.score(frame, remainder(7) != 2).collect()
    want = collections.Counter()
    for r in rows:
        words = brute_tokens(r.text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        want[r.doc_id, len(words), sum(w in counts for w in words), n, round(base, 6)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_lm_beats_the_base_on_held_out_documents(spark):
    rows = op6_lm_score(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > 0.98 * sum(r.base_score for r in rows)
    assert np.mean([r.score > r.base_score for r in rows]) > 0.8


def test_lm_probabilities_add_up_to_one_and_gradients_are_right():
    words = [w.encode() for w in ("", "the", "of", "cat", "dog", "sat", "mat")]
    counts = np.array([5, 9, 7, 3, 2, 2, 1])
    vocab = lm_scoring.Vocabulary(words, counts, int(counts.sum()), 7, np.zeros(lm_scoring.TAILS), np.zeros(lm_scoring.TAILS))
    net = lm_scoring.Network(vocab)
    rng = np.random.default_rng(0)
    for name in net.NAMES:
        setattr(net, name, (getattr(net, name) + rng.normal(0, 0.1, getattr(net, name).shape)).astype(np.float64))
    state = rng.normal(size=(1, lm_scoring.STATE))
    total = sum(np.exp(net.output(state, np.array([0]), np.array([k]))[0]) for k in range(7))
    total += sum(np.exp(net.output(state, np.array([vocab.classes + t]), np.array([0]))[0]) for t in range(lm_scoring.TAILS))
    assert abs(total - 1) < 1e-6  # the tail classes' own words add up to one by their counts
    x, kind, place = np.array([[1, 2], [3, 4], [5, 6]]), np.zeros((3, 2), int), np.array([[2, 3], [4, 5], [6, 1]])

    def loss():
        states = net.run(x, np.zeros((2, lm_scoring.STATE))).astype(np.float64)
        return -net.output(states.reshape(6, -1), kind.ravel(), place.ravel()).sum()

    keep = []
    states = net.run(x, np.zeros((2, lm_scoring.STATE)), keep)
    _, ds, grads = net.output(states.reshape(6, -1), kind.ravel(), place.ravel(), backward=True)
    grads |= net.back(x, keep, ds.reshape(3, 2, -1))
    for name in net.NAMES:
        values = getattr(net, name)
        at = tuple(rng.integers(0, s) if name != "X" else [3, 7][i] for i, s in enumerate(values.shape))
        before = values[at]
        values[at] = before + 1e-2
        up = loss()
        values[at] = before - 1e-2
        down = loss()
        values[at] = before
        assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-2 * max(1, abs(grads[name][at])), name


def test_lm_state_is_carried_over_windows(monkeypatch):
    words = [b"", b"a", b"b", b"c"]
    vocab = lm_scoring.Vocabulary(words, np.array([2, 5, 4, 3]), 14, 4, np.zeros(lm_scoring.TAILS), np.zeros(lm_scoring.TAILS))
    net = lm_scoring.Network(vocab)
    docs = []
    for text in ([b"a", b"b", b"c"] * 30, [b"a"], [], [b"zz", b"b"] * 25):
        at, kind = vocab.look_up(text)
        docs.append((net.inputs_of(at, kind, vocab.modeled), kind, at % lm_scoring.CLASS_WORDS))
    long = lm_scoring.log_likelihoods(net, docs)
    monkeypatch.setattr(lm_scoring, "STEPS", 1000)
    assert np.allclose(long, lm_scoring.log_likelihoods(net, docs), rtol=1e-4)
    assert np.allclose(long, [lm_scoring.log_likelihoods(net, [d])[0] for d in docs], rtol=1e-4)


def test_lm_learns_from_all_training_rows(spark, odd):
    frame = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text"))
    frame = frame.unionByName(spark.createDataFrame([(None, "no id"), (None, None)], "doc_id long, text string"))
    vocab = lm_scoring.vocabulary(lm_scoring.count_words(frame))
    assert lm_scoring.train(frame, vocab).tokens == vocab.tokens == sum(len(brute_tokens(r.text)) for r in frame.collect())


def test_lm_training_carries_the_state_through_whole_documents(monkeypatch):
    words = [b"", b"a", b"b", b"c"]
    vocab = lm_scoring.Vocabulary(words, np.array([2, 5, 4, 3]), 14, 4, np.zeros(lm_scoring.TAILS), np.zeros(lm_scoring.TAILS))
    net = lm_scoring.Network(vocab)
    net.C[:] = np.random.default_rng(1).normal(size=net.C.shape)
    docs = []
    for text in ([b"a", b"b", b"c"] * 500, [b"a"], [], [b"zz", b"b"] * 25, [b"c"] * 31, [b"b"] * 40):
        at, kind = vocab.look_up(text)
        docs.append((net.inputs_of(at, kind, vocab.modeled), kind, at % lm_scoring.CLASS_WORDS))
    want, found, output = lm_scoring.log_likelihoods(net, docs).sum(), [], net.output
    monkeypatch.setattr(lm_scoring, "TRAIN_LANES", 2)
    monkeypatch.setattr(lm_scoring.Trainer, "update", lambda self, grads: None)
    monkeypatch.setattr(net, "output", lambda *a, **b: (found.append(output(*a, **b)), found[-1])[1])
    trainer = lm_scoring.Trainer(net)
    trainer.learn(np.column_stack(d) for d in docs)
    assert trainer.tokens == sum(len(d[0]) for d in docs)
    assert np.isclose(sum(f[0].sum() for f in found), want, rtol=1e-4)


def test_lm_words_are_cut_by_the_column(monkeypatch):
    texts = [None, "", " ", "\x1c a\x85b  c\u00a0d", "A\tB\nC\vD\fE\rF  ", "\u0130 \u00c4x", "xxxxx ", "  Lead the", "\0 \0a", "the of " * 500]
    column, cut = pa.array(texts, pa.string()), []
    monkeypatch.setattr(lm_scoring, "PORTION_BYTES", 8)
    for start, stop in lm_scoring.portions(column):
        words, sizes = lm_scoring.words_of(column.slice(start, stop - start))
        ends = np.cumsum(sizes)
        cut += [words.to_pylist()[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist())]
    assert cut == [brute_tokens(t)[:-1] for t in texts]


def test_lm_looks_words_up_without_a_call_for_each(monkeypatch):
    known = [b"", b"the", b"of", b"a"]
    vocab = lm_scoring.Vocabulary(known, np.array([2, 5, 4, 3]), 14, 4, np.zeros(lm_scoring.TAILS), np.zeros(lm_scoring.TAILS))
    words = [b"w%d" % i for i in range(5_000)] + [b"the", b"x", b"\xff", b"of", b"\0\0"]
    want = [0 if w in known else vocab.classes + lm_scoring.tail_of(w) for w in words] + [0]
    vocab.look_up([b"rare"])
    calls, tail_of = [], lm_scoring.tail_of
    monkeypatch.setattr(lm_scoring, "tail_of", lambda w: (calls.append(w), tail_of(w))[1])
    at, kind = vocab.look_up(words)
    assert kind.tolist() == want and at.tolist() == [known.index(w) if w in known else -1 for w in words] + [0]
    assert len(calls) <= 1


def test_lm_counts_are_handed_on_in_parts(monkeypatch):
    texts = [None, "", "the cat", "The cat sat", " the\u00a0dog "] + [f"w{i} w{i + 1} the" for i in range(60)]
    monkeypatch.setattr(lm_scoring, "PORTION_BYTES", 16)
    batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["text"]) for part in (texts[:20], [], texts[20:])]
    want = collections.Counter(w for t in texts for w in brute_tokens(t))
    for held, most in ((10, 20), (500_000, 500_000)):
        monkeypatch.setattr(lm_scoring, "HELD_WORDS", held)
        got, parts = collections.Counter(), list(lm_scoring.counted(batches))
        for r in (r for part in parts for r in part.to_pylist()):
            assert r["tail"] == lm_scoring.tail_of(r["word"])
            got[r["word"]] += r["c"]
        assert got == want and max(map(len, parts)) <= most and (len(parts) > 5) == (held == 10)


def test_lm_long_texts_beside_short_ones(spark):
    texts = ["a b", None, f" the {'c' * 2_000}at" * 2_500, "the end", "", "the " * 3 + "rare"]
    assert len(texts[2]) > lm_scoring.PORTION_BYTES
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    trained = F.col("doc_id") != 5
    counts = collections.Counter(w for t in texts[:5] for w in brute_tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r in lm_scoring.score(frame, trained).collect():
        words = brute_tokens(texts[r.doc_id])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_lm_without_training_rows(docs):
    import pyspark.sql.functions as F

    rows = lm_scoring.score(docs.limit(5).select("doc_id", "text"), F.lit(False)).collect()
    assert len(rows) == 5 and {(r.train_tokens, r.n_known, r.score, r.base_score) for r in rows} == {(0, 0, 0.0, 0.0)}


@pytest.mark.parametrize(
    "markup,text",
    [
        (None, ""), ("", ""), ("plain  words\n here", "plain words here"), ("lost< a", "lost< a"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>x", "- a\n- b\n  - c\n- d\n\nx"),
        ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>z", "a     bbb\ncccc  d\n\nz"),
        ("<table><tr><th colspan=2>wide<tr><td rowspan=2>r<td>1<tr><td>2</table>", "wide\nr     1\n      2"),
        ("<p>a<p>b<div>c</div>d<br>e", "a\n\nb\n\nc\nd\ne"), ("<pre>\n  x\n y</pre>q", "  x\n y\n\nq"),
        ("<div hidden>no</div><span style='Display : none'>no</span>yes", "yes"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("<head><title>no</title></head><body>a<b>b</b> <i> c</i>&amp;&nbsp;d", "ab c& d"),
        ('<p>x <script>var a="</p>";</script> y<!-- no --> z', "x y z"), ("<a href='x>y'>t</a>", "t"),
        ("<h1>T</h1>para<h2>U</h2>", "T\n\npara\n\nU"), ("<dl><dt>t<dd>d<dd>e</dl>", "t\n    d\n    e"),
        ("</p></div></b>x", "x"), ("<style>p{}", ""), ("<p title=\"unclosed>x", "x"),
    ],
)
def test_html_layout(markup, text):
    assert html_text.extract(markup) == text


@pytest.mark.parametrize(
    "markup,text",
    [
        ("<table><tr><td>a</td></tr>stray <a href=x>More</a></table>z", "stray More\na\n\nz"),
        ("<table><tr><td>a</td></tr>left <b>open</b>", "left open\na"),
        ("x <math><mi>a</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><mspace/></math> y", "x a= 1 2 y"),
        ("<math><semantics><mi>a</mi><annotation>no</annotation></semantics></math>b", "ab"),
        ("a <svg><title>no</title><defs><text>no</text></defs><path d='x'/><g>no<text>Q1</text><text x=1>Q2<tspan dy=1>low</tspan></text></g></svg>b", "a Q1 Q2 low b"),
        ("<svg><foreignObject><p>in</p></foreignObject></svg><svg viewBox='0'><path><p>out", "in\n\nout"),
        ("<map name=m><a href=x>here</a><area alt=no></map> there", "here there"), ("<desc>d</desc> <text>t</text>", "d t"),
    ],
)
def test_html_text_outside_cells_in_formulas_drawings_and_maps(markup, text):
    assert html_text.extract(markup) == text


def test_html_keeps_all_visible_words_and_any_depth(spark):
    deep = "<div><p><table><tr><td>" * 3_000 + "core"
    assert html_text.extract(deep).split() == ["core"]
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_pages(pages.withColumnRenamed("url", "text")).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.sub(r"(?s)<head>.*?</head>|<(script|style|noscript|template|iframe)\b.*?</\1>|<!--.*?-->", " ", r.html or "")
        words = re.sub(r"<[a-zA-Z/!][^>]*>", " ", body)
        import html as h

        want = collections.Counter(h.unescape(words).replace("\xa0", " ").split())
        seen = collections.Counter(w for w in got[r.page_id].split() if not re.fullmatch(r"-|\d+\.", w))
        want = collections.Counter({w: n for w, n in want.items() if not re.fullmatch(r"-|\d+\.", w)})
        assert "".join(sorted("".join(want.elements()))) == "".join(sorted("".join(seen.elements())))
        if "<table" not in body:  # nothing stands beside something else, so the order is that of the page
            order = [w for w in h.unescape(words).replace("\xa0", " ").split() if not re.fullmatch(r"-|\d+\.", w)]
            assert "".join(order) == "".join(w for w in got[r.page_id].split() if not re.fullmatch(r"-|\d+\.", w))


@pytest.mark.parametrize(
    "page", ["<a " * 32_000, '<a href="' * 32_000, "<a b='" * 32_000 + ">", "<" + "a" * 300_000, '<a "' * 20_000 + "'" * 20_001, "<b>" + "< " * 50_000],
)
def test_html_broken_markup_takes_time_in_proportion(page):
    start = time.perf_counter()
    html_text.extract(page)
    assert time.perf_counter() - start < 2


@pytest.mark.parametrize(
    "markup,text",
    [
        ("a <b>c</b> <img alt=\"x", 'a c <img alt="x'), ('<a t="<b>bold</b>" x "<i>it</i>', "it"), ('<a t="<b>bold</b>" <i x', '<a t="bold" <i x'),
        ("x < y <b>z</b>", "x < y z"), ("<p>one<p class='a>two</p>three", "one\n\ntwo\n\nthree"),
    ],
)
def test_html_tags_that_do_not_end_are_text(markup, text):
    assert html_text.extract(markup) == text


def test_toxicity_scores_equal_a_plain_computation(spark, odd, monkeypatch):
    """Each score again, word by word and n-gram by n-gram, from the definition of the model."""
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = toxicity.train(docs, labels, where=remainder(3) != 1, train_rows=30)

    def number(word):
        marked = f"<{word.strip(toxicity._EDGES) or word}>"
        found = []
        for order in toxicity.ORDERS:
            for i in range(len(marked) - order + 1):
                h = 0
                for c in marked[i : i + order]:
                    h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
                h = ((h ^ (order * 0x1F123BB5 & 0xFFFFFFFF)) * 0x9E3779B1) & 0xFFFFFFFF
                found.append(model.weight[(h >> 15) & (toxicity.BUCKETS - 1)])
        return sum(found) / len(found) if found else 0.0

    def plain(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
        if not words:
            return model.empty
        n = max(1, (len(words) + toxicity.WINDOW // 2) // toxicity.WINDOW)
        cuts = [k * toxicity.WINDOW for k in range(n)] + [len(words)]
        best = max(sum(number(w) for w in set(words[a:b])) / (b - a) for a, b in zip(cuts, cuts[1:]))
        return 1 / (1 + math.exp(-(best + model.bias)))

    short = docs.where(F.length("text") < 1_500)
    for frame in (short, odd.where(F.coalesce(F.length("text"), F.lit(0)) < 1_500)):
        want = sorted(((r.doc_id is None, r.doc_id or 0, plain(r.text)) for r in frame.collect()))
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.score) for r in toxicity.score(frame, model).collect()))
        assert [w[:2] for w in want] == [g[:2] for g in got] and want
        np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-9)
    # Documents that do not fit into the bytes of a label's sample teach nothing.
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 400)
    small = toxicity.train(docs, labels, where=remainder(3) != 1)
    assert (small.weight != model.weight).any()


def test_html_empty_table(spark):
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_toxicity_fits_words_in_portions_within_memory(monkeypatch):
    """Sixty thousand different words: sorting all their n-grams at once took 82 MB, portions 38; the model is the same."""
    for name in ("WARM_EPOCHS", "ROUNDS", "ROUND_EPOCHS", "LEAST_STEPS"):
        monkeypatch.setattr(toxicity, name, 1)
    rng = np.random.default_rng(3)
    letters = rng.integers(97, 105, (60_000, 12), dtype=np.uint8).tobytes().decode()
    words = [letters[k : k + 12] for k in range(0, len(letters), 12)]
    texts = [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)]
    tracemalloc.start()
    model = toxicity.fit(texts, np.arange(len(texts)) % 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    small = texts[:40]
    whole = toxicity.fit(small, np.arange(40) % 2)
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    portions = toxicity.fit(small, np.arange(40) % 2)
    assert (whole.weight == portions.weight).all() and whole.bias == portions.bias and model.weight.any()
