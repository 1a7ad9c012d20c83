"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, conversation_repair, decontaminate, fill_middle, line_dedup, ngram_join, packing, pii, quality_model, quality_rules, secret_scan, sharding, token_store
from .common import read_table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), _tokenizer(), capacity=2048, end_id=0)


#: A key for tests and examples; a deployment passes its own secret.
PII_KEY = "example-key"


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.remove_spread_lines(docs, min_sites=10).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"), n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(read_table(spark, sf_dir, "conversations"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    digest = docs.select("doc_id", "lang", "source", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    dims = [F.col("lang"), F.col("source"), F.col("size")]
    rows = sharding.shard_by_curve(digest, dims, n_shards=8, tie=F.struct("doc_id", "text_crc32"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "lang", "source")


def op9_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(read_table(spark, sf_dir, "documents"), _tokenizer(), end_id=0)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_copies(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("tie")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(read_table(spark, sf_dir, "conversations")), copies_col="copies")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))
    base = secret_scan.of_kinds(F.col("spans"), secret_scan.BASE)
    counts = [F.size(secret_scan.of_kinds(F.col("spans"), (k,))).cast("long").alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(read_table(spark, sf_dir, "documents"), seed=42, percent=50, percent_spm=80, texts=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_best_fit_packing, op2_pii_pseudonyms, op3_line_dedup, op4_quality_rules, op5_quality_classifier, op6_ngram_join, op7_chat_perspectives, op8_hilbert_shards, op9_token_tables, op10_decontamination)
    every += (op11_conversation_repair, op12_secret_scan, op13_fill_in_middle)
    return {f.__name__: f for f in every}


_ASCII_LINE = r"translate(regexp_replace({x}, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, x, pos, {_ASCII_LINE.format(x="x")} AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), spread AS (
  SELECT line, min(doc_id) AS first_id FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.doc_id, l.pos, l.x, l.line, s.first_id IS NOT NULL AND s.first_id <> l.doc_id AS gone
  FROM lines l LEFT JOIN spread s ON l.line = s.line AND l.line <> ''
), cut AS (
  SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, length(text)::BIGINT AS n_chars_left, md5(text) AS text_md5 FROM cut
"""

OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS words FROM documents
), lines AS (
  SELECT doc_id, source, text, x, {_ASCII_LINE.format(x="x")} AS line FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS x FROM d)
), dup AS (
  SELECT doc_id, (count(*) - count(DISTINCT x))::BIGINT AS n_dup_lines FROM lines WHERE line <> '' GROUP BY doc_id
), frequent AS (
  SELECT source, line FROM lines WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT doc_id) > 5
), lost AS (
  SELECT doc_id, sum(len(regexp_extract_all(line, '[^ \\t-\\r]+')))::BIGINT AS lost_words FROM lines JOIN frequent USING (source, line) GROUP BY doc_id
), win AS (
  SELECT doc_id, i, words[i:i + 7] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 9)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n >= 2
), repeats AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id
), base AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[ \\t-\\r]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_words, 0) AS lost_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, NOT base_failed AND 100 * lost_words <= 30 * n_words AS kept FROM judged
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS words FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM g
), x AS (SELECT doc_id, unnest(s) AS e FROM g
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM x a JOIN x b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM pairs JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 85 * (a.n + b.n - shared)
), reach AS (
  SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, v FROM reach r JOIN links ON u = r.other
)
SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id FROM reach JOIN n USING (doc_id) GROUP BY doc_id
"""

OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role AS speaker,
         replace(replace(text, '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') AS text
  FROM conversations
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), s AS (
  SELECT t.conv_id, perspective, turn, speaker, speaker = perspective AS masked, t.text AS body,
         '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM t JOIN p USING (conv_id)
), g AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM s
), w AS (
  SELECT *, row_number() OVER o - 1 AS position, coalesce(sum(length(segment)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM g WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, body)
)
SELECT conv_id, perspective, turn, position, speaker, segment, start, (start + length(segment))::BIGINT AS "end",
       (start + length(head))::BIGINT AS content_start, (start + length(segment) - 1)::BIGINT AS content_end, masked
FROM w
"""


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ \t-\r]*[^ \t-\r]+|[ \t-\r]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), h AS (
  SELECT *, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_fill_in_middle": OP13_SQL, "op3_line_dedup": OP3_SQL, "op4_quality_rules": OP4_SQL, "op6_ngram_join": OP6_SQL, "op7_chat_perspectives": OP7_SQL}
