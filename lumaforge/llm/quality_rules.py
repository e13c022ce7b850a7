"""Quality rules as a short-circuit cascade of Column expressions.

Each rule rejects a document by a predicate over text features. ``plan`` measures on a sample how long each
rule takes and how much it rejects, and orders the rules by rejection per cost; ``rejected`` nests them in
that order, so that an expensive feature is computed only for what the cheaper rules have let through. The
order never changes a verdict, since a document is rejected if any rule rejects it.

Everything is a built-in function. The higher-order functions bind shared values by ``_let``.

Nulls: a null text has no words and is handled as an empty one. Very long texts are processed whole. Repeated
rows are judged one by one, alike. An empty table gives an empty result. Extra columns are passed on; names
that clash with a feature or verdict column are an error of ``annotate`` only if the caller keeps them, so it
drops the older ones.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaforge.llm.tables import SPACE_CLASS, release, stored

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SEED = 2


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long")


def n_lines(text: Column) -> Column:
    return F.size(_worded_lines(text)).cast("long")


def _worded_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.filter(lines, lambda s: F.btrim(s, F.lit(SPACES)) != "")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return _let(_worded_lines(text), lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text, each word counted once.

    Windows are hashed. Texts whose hashes are all distinct are done. Otherwise the hashes are sorted with their
    positions, neighbors that are equal give the repeated positions, and gaps between those say how
    many words they cover: three, or the distance to the next. Should two different windows have one hash, the text is
    gone through once more with the windows themselves.
    """

    def positions(w: Column) -> Column:
        return F.sequence(F.lit(0), F.size(w) - 3)

    def hashed(w: Column) -> Column:
        return F.transform(positions(w), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def spelled(w: Column) -> Column:
        return F.transform(positions(w), lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2]))

    def equal_neighbors(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("p"))))

        def paired(s: Column) -> Column:
            n = F.size(s) - 1
            twice = F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.when(a["w"] == b["w"], F.struct(a["p"].alias("a"), b["p"].alias("b"))))
            return F.filter(twice, lambda x: x.isNotNull())

        return _let(placed, paired)

    def covered(pairs: Column) -> Column:
        def steps(p: Column) -> Column:
            gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
            return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

        return _let(F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda x: F.array(x["a"], x["b"]))))), steps)

    def counted(w: Column, windows: Column) -> Column:
        def differ(x: Column) -> Column:
            a, b = x["a"], x["b"]
            return (w[a] != w[b]) | (w[a + 1] != w[b + 1]) | (w[a + 2] != w[b + 2])

        exact = _let(equal_neighbors(windows), lambda pairs: F.when(F.exists(pairs, differ), F.lit(None)).otherwise(covered(pairs)))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(exact)

    def repeats(w: Column) -> Column:
        return F.coalesce(_let(hashed(w), lambda h: counted(w, h)), _let(spelled(w), lambda s: covered(equal_neighbors(s))))

    return _let(words_of(text), lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(repeats(w))).cast("long")


FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_lines": n_lines,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """``reject`` gets the columns of ``features`` in that order and says true for a document to drop."""

    name: str
    features: tuple[str, ...]
    reject: Callable[..., Column]

    def on_text(self, text: Column) -> Column:
        return self.reject(*(FEATURES[f](text) for f in self.features))

    def on_features(self) -> Column:
        return self.reject(*(F.col(f) for f in self.features))


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n),
)

#: Thresholds as the published filter sets for web text have them; word lengths are wider, since short function
#: words and long compounds both are ordinary in some languages.
EXTRA_RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 15 * n)),
)

RULES = BASE_RULES + EXTRA_RULES

#: Rows in the sample that only decides the order of the rules, at most, and the bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 1 << 21
#: Times that a rule runs over the sample once it is warm; the fastest counts.
RUNS = 3


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: int

    @property
    def gain(self) -> float:
        return self.rejected / self.seconds


def sampled(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """``text`` of the documents with the smallest hashes, stored; of those, as many as ``size`` bytes hold, one at least.

    All of the table takes part in the choice, and no text reaches the driver.
    """
    drawn = docs.select(F.col(text).alias("text")).withColumn("hash", F.xxhash64(F.lit(SEED), "text"))
    kept = stored(drawn.orderBy("hash").limit(rows), "sample")
    # A table of ``rows`` rows at most.
    before = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy("hash").rowsBetween(Window.unboundedPreceding, -1))
    return kept.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < size).select("text")


def measure(docs: DataFrame, text: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> list[Measured]:
    """Seconds and rejected rows of each rule over a sample.

    A rule runs once to be compiled, and then several times, of which the fastest counts: what disturbs a run only
    adds to it. Each run goes over the sample in one task.
    """
    sample = stored(sampled(docs, text, sample_rows, sample_bytes).coalesce(1), "measured")

    def timed(rule: Rule) -> Measured:
        counted = sample.coalesce(1).select(F.count_if(F.coalesce(rule.on_text(F.col("text")), F.lit(False))))
        found = counted.first()[0]
        seconds = []
        for _ in range(RUNS):
            start = time.perf_counter()
            counted.collect()
            seconds.append(time.perf_counter() - start)
        return Measured(rule, min(seconds), found)

    out = [timed(rule) for rule in rules]
    release(sample)
    return out


def plan(docs: DataFrame, text: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> list[Rule]:
    """The rules by falling rejection per cost; rules that reject nothing in the sample by rising cost."""
    measured = measure(docs, text, rules, sample_rows, sample_bytes)
    return [m.rule for m in sorted(measured, key=lambda m: (-m.gain, m.seconds, m.rule.name))]


def cascade(verdicts: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that rejects, in the given order; null if none does. Later ones are not evaluated."""
    out = F.lit(None).cast("string")
    for name, reject in reversed(verdicts):
        out = F.when(reject, F.lit(name)).otherwise(out)
    return out


def rejected_by(text: Column, rules: list[Rule]) -> Column:
    return cascade([(r.name, r.on_text(text)) for r in rules])


def keep(docs: DataFrame, text: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their columns unchanged."""
    ordered = plan(docs, text, rules, sample_rows)
    return docs.where(rejected_by(F.col(text), ordered).isNull())


def annotate(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All features, ``base_failed``, ``kept`` and ``rejected_by`` beside the document's other columns.

    Base rules come first, then the others in the order ``plan`` found. Features that every row must report
    are columns; the rules read those.
    """
    ordered = plan(docs, text, EXTRA_RULES, sample_rows)
    out_names = {*FEATURES, "base_failed", "kept", "rejected_by"}
    plain = docs.drop(*(c for c in docs.columns if c.lower() in out_names and c != text))
    features = plain.withColumns({name: f(F.col(text)) for name, f in FEATURES.items()})
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | rule.on_features()
    verdict = cascade([(r.name, r.on_features()) for r in (*BASE_RULES, *ordered)])
    return features.withColumns({"base_failed": base, "rejected_by": verdict}).withColumn("kept", F.col("rejected_by").isNull())
