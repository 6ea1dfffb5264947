"""Query op11: quality figures and verdicts of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import read
from tidemark.llm.quality import cascade, plan


def op11_short_circuit_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    # Which rule rejects a text first depends on measured times; whether one does, doesn't.
    return cascade(docs, [e.rule for e in plan(docs)]).drop("rejected_by")


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), f AS (
  SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), p AS (
  SELECT row, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM f
), l AS (
  SELECT *, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM p WINDOW s AS (PARTITION BY row ORDER BY i)
), c AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, w, w2, w3) AS n FROM l WHERE w3 IS NOT NULL
), r AS (
  SELECT row, count(DISTINCT j) AS n_repeat_words FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY row
), o AS (
  SELECT row, max(n) AS most FROM (SELECT row, count(*) AS n FROM p GROUP BY row, w) GROUP BY row
), m AS (
  SELECT doc_id, text, words, lines, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(most, 0) AS most
  FROM f LEFT JOIN r USING (row) LEFT JOIN o USING (row)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > len(lines)
            OR length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]', '', 'g')) < length(regexp_replace(text, '[a-zß-öø-ÿ]', '', 'g'))
            OR 10 * len(list_filter(words, lambda x: regexp_full_match(x, '[!-@\[-`{-~]+'))) > 3 * n_words OR 10 * most > 3 * n_words
            OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•‣]'))) > 9 * len(lines)
            OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * len(lines)
            OR contains(lower(text), 'lorem ipsum')) AS kept
FROM v
"""
