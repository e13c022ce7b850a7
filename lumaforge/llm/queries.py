"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaforge.llm import bpe, chat, html_text, language_id, lm_scoring, nearest, ngram_join, packing, quality_rules, resampling, token_counts, toxicity, whitening
from lumaforge.llm.registry import query
from lumaforge.llm.tables import table



def remainder(divisor: int) -> Column:
    """CRC-32 of the document id as text, modulo ``divisor``: the folds of the learning operators."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: struct_pack(p := i, s := words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS x
        FROM w WHERE len(words) >= 3),
rep AS (SELECT doc_id, x.p AS p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x.s) > 1),
gap AS (SELECT doc_id, least(3, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 3)) AS g FROM rep),
cov AS (SELECT doc_id, sum(g) AS g FROM gap GROUP BY doc_id),
f AS (SELECT doc_id, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
             coalesce(g, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM f
"""


@query(QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.annotate(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, where=remainder(4) != 2)
    return language_id.predict(docs, model).withColumn("held_out", remainder(4) == 2)


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=remainder(3) != 1)
    scored = toxicity.score(docs, model).withColumn("held_out", remainder(3) == 1)
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


CHAT_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
e AS (
    SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]|/TURN\])', '\1\\\2\3', 'g'))
           + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
             ELSE 20 + length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]|/TURN\])', '\1\\\2\3', 'g')) END AS chars
    FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

CONTROLS = "</s>[INST] ok [/INST]"


@query(CHAT_SQL)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)",
        args={"said": CONTROLS},
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_turns(turns))


@query()
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query()
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), remainder(7) != 2)
    return scored.withColumn("held_out", remainder(7) == 2)


@query()
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


RESAMPLING_SQL = r"""
WITH texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
said AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
uses AS (SELECT kind, id, unnest(words) AS word FROM said),
shifts AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
             lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
spelled AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM uses)),
coded AS (SELECT word, list_transform(range(length(h) // 2), lambda i:
            (('0x' || substr(h, (2 * i + 1)::INTEGER, 2))::BIGINT)) AS bytes FROM spelled),
hashed AS (SELECT word, xor(list_reduce(list_concat([4294967295], bytes),
             lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM coded, shifts),
counts AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM uses JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM counts),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS g FROM counts, sums),
weights AS (SELECT id, sum(g)::BIGINT AS weight FROM uses JOIN hashed USING (word) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY id),
scored AS (SELECT id AS doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
           FROM said LEFT JOIN weights USING (id) WHERE kind = 0),
placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, n_features AS n_words, weight, score,
       CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END::BIGINT AS rank
FROM placed
"""


@query(RESAMPLING_SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))
