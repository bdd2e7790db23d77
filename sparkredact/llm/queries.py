"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from sparkredact.llm import (elias_fano, entropy_mix, host_rules, importance_resampling, jaccard_join, language_bitmask, line_templates, pivot_index,
                             secret_forest, sos_packing, spelling_trie, toxicity, url_templates)
from sparkredact.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(table(spark, sf_dir, "documents"))


def op9_elias_fano_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elias_fano.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "spans")


# Fixed values of the contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_pivot_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="dropped_lines")


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op7_sos_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sos_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep_ids=False).drop("ids")


def op10_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return language_bitmask.identify(docs, language_bitmask.train(docs.where(~held_out))).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_trie.variants(table(spark, sf_dir, "documents"))


# Words by their code points, windows by their words: nothing of the Spark side is used here.
OP10_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT r, doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM texts
), places AS (
  SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM words WHERE len(ws) >= 5
), windows AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS w FROM places
), repeated AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1
), covered AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM repeated) GROUP BY r
), counts AS (
  SELECT w.doc_id, w.source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM words w LEFT JOIN covered c USING (r)
), rules AS (
  SELECT *, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule,
         unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > n_words, 100 * n_dup_lines > 30 * n_lines]) AS failed FROM counts
), hosts AS (
  SELECT source, rule, count(*) AS n, sum(failed::INT)::DOUBLE AS f FROM rules GROUP BY ALL
), moments AS (
  SELECT rule, sum(n)::DOUBLE AS n, count(*) AS h, sum(n * n)::DOUBLE AS nn, sum(f) / sum(n) AS m, sum(f * f / n) AS q FROM hosts GROUP BY rule
), rho AS (
  SELECT rule, m, h, CASE WHEN h > 1 AND m > 0 AND m < 1 THEN
    least(greatest(((q - n * m * m) / (m * (1 - m)) - (h - 1)) / greatest(n - nn / n - (h - 1), 1e-9), 0), 0.999) ELSE 0.5 END AS rho FROM moments
), verdicts AS (
  SELECT source, bool_or(CASE WHEN rho = 0 THEN m ELSE (f + (1 - rho) / rho * m) / (hosts.n + (1 - rho) / rho) END > 0.5) AS rejected
  FROM hosts JOIN rho USING (rule) GROUP BY source
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT rejected) AS kept
FROM counts JOIN verdicts ON counts.source IS NOT DISTINCT FROM verdicts.source
"""

# DuckDB has no crc32: the table of its polynomial, and a fold over the bytes of x.
_CRC_TABLE = """crc AS (
  SELECT list(c ORDER BY i) AS crc_table FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) b(i))
)"""
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode({x}))),
    lambda k: ('0x' || substr(hex(encode({x})), 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8)))"""
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH {_CRC_TABLE}, texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT -row_number() OVER (), NULL, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), feats AS (
  SELECT r, unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM texts
), named AS (
  SELECT f, {_CRC.format(x="f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM feats), crc
), counts AS (
  SELECT r, bucket, count(*) AS n FROM feats JOIN named USING (f) GROUP BY ALL
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (r > 0), 0) AS s, coalesce(sum(n) FILTER (r < 0), 0) AS t FROM counts GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS gain FROM totals
), weights AS (
  SELECT r, floor(sum(gain * n) / sum(n))::BIGINT AS weight FROM counts JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(ws) AS n_words, len(ws) + greatest(len(ws) - 1, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (r) WHERE texts.r > 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) AS place,
         25 * count(*) OVER (PARTITION BY n_words >= 20 AND score IS NOT NULL) // 100 AS k FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND score IS NOT NULL AND place <= k THEN place END AS rank FROM placed
"""

# Near words by brute equality: of a longer word with one letter dropped, and of two words without the same place.
OP13_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format(x="text")}, '[a-z\x{{00C0}}-\x{{00FF}}]{{7,}}')) AS run FROM documents
), hashed AS (
  SELECT run, n, {_CRC.format(x="key")} AS h FROM (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS key, count(*) AS n FROM runs GROUP BY ALL), crc
), altered AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM altered WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), dropped AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM places
), pairs AS (
  SELECT DISTINCT d.word AS a, w.word AS b, d.n AS n_a, w.n AS n_b FROM dropped d JOIN words w ON d.rest = w.word
  UNION ALL
  SELECT x.word, y.word, x.n, y.n FROM dropped x JOIN dropped y ON x.rest = y.rest AND x.i = y.i AND x.word < y.word
), near AS (
  SELECT a AS word, b AS near, n_b AS m FROM pairs UNION ALL SELECT b, a, n_a FROM pairs
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM near GROUP BY word
), known AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN near END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at, form AS next FROM known
  UNION ALL
  SELECT c.word, k.word, k.form FROM chain c JOIN known k ON c.next = k.word
)
SELECT k.word, k.form, c.at AS root, k.n, k.n_near, k.form_n FROM known k JOIN chain c ON c.word = k.word AND c.next IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_crf_toxicity": op1_crf_toxicity,
        "op2_url_templates": op2_url_templates,
        "op3_pivot_near_duplicates": op3_pivot_near_duplicates,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_line_templates": op5_line_templates,
        "op6_entropy_mix": op6_entropy_mix,
        "op7_sos_packing": op7_sos_packing,
        "op8_secret_forest": op8_secret_forest,
        "op9_elias_fano_token_files": op9_elias_fano_token_files,
        "op10_host_quality_rules": op10_host_quality_rules,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_language_bitmask": op12_language_bitmask,
        "op13_spelling_trie": op13_spelling_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_host_quality_rules": OP10_SQL,
        "op11_importance_resampling": OP11_SQL,
        "op13_spelling_trie": OP13_SQL,
    }
