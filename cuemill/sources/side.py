"""Side inputs: glossaries, word timings and profiles."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("source", "target", "note")


def first_of_each(rows: DataFrame) -> DataFrame:
    """The first row of every source, in file order."""
    order = Window.partitionBy("source").orderBy("pos")
    return rows.where("source <> ''").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def read_csv_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(pos, source, target, note, line) of a CSV glossary; it must have the three columns. Rows without source or target are left out."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    named = raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])
    if not set(COLUMNS) <= set(named.columns):
        raise ValueError(f"a glossary needs the columns {', '.join(COLUMNS)}")
    tidy = [F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")).alias(c) for c in COLUMNS]
    rows = named.withColumn("pos", F.monotonically_increasing_id()).select("pos", *tidy).where("target <> ''")
    line = F.concat("source", F.lit(" = "), "target", F.when(F.col("note") == "", "").otherwise(F.concat(F.lit("（"), "note", F.lit("）"))))
    return first_of_each(rows).withColumn("line", line)


# What the header of a Markdown glossary says.
TARGET_HEADERS, SOURCE_HEADER = ("中文译名", "中文"), "原名"


def read_table_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(pos, source, target, line) of a Markdown table of translation and original.

    Originals parted by a slash are rows of their own; a remark in parentheses
    is left out, and the form with it added after the one without. Originals of
    ideographs only are none.
    """
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).withColumn("value", F.trim("value")).where(F.col("value").startswith("|") & ~F.col("value").rlike(r"^\|[\s:|-]+\|\z"))
    cells = F.transform(F.split(F.regexp_replace("value", r"^\|+|\|+\z", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.select("n", cells.alias("c")).where(F.size("c") >= 2).select("n", F.get("c", F.lit(0)).alias("target"), F.get("c", F.lit(1)).alias("names"))
    body = rows.where(~F.col("target").isin(*TARGET_HEADERS) & ~F.col("names").contains(SOURCE_HEADER) & (F.col("target") != "") & (F.col("names") != ""))
    each = body.select("n", "target", F.posexplode(F.split("names", "[/／]")).alias("k", "raw")).withColumn("raw", F.trim("raw"))
    clean = each.withColumn("source", F.trim(F.regexp_replace("raw", r"\s*\([^)]*\)\s*", " "))).withColumn("pos", F.struct("n", "k"))
    kept = first_of_each(clean.where(~F.col("source").rlike("^[一-鿿·]+\\z")))
    both = kept.select("n", "k", "target", F.posexplode(F.array("source", "raw")).alias("v", "source")).withColumn("pos", F.struct("n", "k", "v"))
    return first_of_each(both).withColumn("line", F.concat("source", F.lit(" = "), "target")).select("pos", "source", "target", "line")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(pos, text, start_s, end_s) of a JSON list; values above 10000 are milliseconds, unreadable ones 0."""
    seconds = lambda c: F.coalesce(F.when(F.expr(f"try_cast({c} AS double)") > 10000, F.expr(f"try_cast({c} AS double)") / 1000).otherwise(F.expr(f"try_cast({c} AS double)")), F.lit(0.0))
    raw = spark.read.json(path, schema="text string, start string, end string", multiLine=True)
    return raw.select(F.monotonically_increasing_id().alias("pos"), F.coalesce("text", F.lit("")).alias("text"), seconds("start").alias("start_s"), seconds("`end`").alias("end_s"))


LEDGER = "anonymous_id string, candidate_id string, sample_id string, dimension string, evaluator_run_id string, score int, hard_failures array<string>, rationale string, confidence double, scored_by string, refusal_detected boolean, raw_response_hash string, raw_response_path string, valid boolean, retry_index int, run_index int"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSONL ledger, each once; a line that can't be read is an error, as a ledger is only ever appended to."""
    return spark.read.json(path, schema=LEDGER, mode="FAILFAST").dropDuplicates(["anonymous_id", "run_index", "evaluator_run_id", "retry_index"])


def write_ledger(records: DataFrame, path: str) -> None:
    """Appends records as canonical JSON lines, keys sorted; their keys must not be in the ledger yet (see bench.open_runs)."""
    names = sorted(records.columns)
    records.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)
