"""Queries of the text statistics over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.quality import function_weights, text_kinds
from cuemill.session import read


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_kinds(read(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_statistics(spark, sf_dir).where(F.col("kind") != "prose").select("doc_id", "kind")


def p8_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was learned about each labelling function, and how many blocks come out otherwise than by plain votes."""
    return function_weights(read(spark, sf_dir, "documents"), "doc_id", "text")


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain statistics of every document, without its words and kind."""
    return p8_statistics(spark, sf_dir).select("doc_id", "n_chars", "n_words", "n_lines", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("end_punctuation", 6).alias("end_punctuation"))


QUERIES = {"p8_found": p8_found, "p8_statistics": p8_statistics, "p8_functions": p8_functions, "p8_counts": p8_counts}
_SPACE = r"\s\x0b\x0c\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SQL = {
    "p8_counts": rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT *, list_filter(regexp_split_to_array(text, '[{_SPACE}]+'), lambda x: x <> '') AS ws,
  list_filter(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS ls FROM t)
SELECT doc_id, length(text) AS n_chars, CAST(len(ws) AS DOUBLE) AS n_words, CAST(len(ls) AS DOUBLE) AS n_lines, round(coalesce(list_sum(list_transform(ws, lambda x: length(x))) / nullif(len(ws), 0), 0), 6) AS mean_word_length,
  round(coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '[.!?…。！？][{_SPACE}"''”’»)\]]*$') )) / nullif(len(ls), 0), 0), 6) AS end_punctuation FROM w""",
}
