"""SRT files as tables and tables as SRT texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.functions.text import trimmed
from cuemill.functions.timecode import format_ms, strict_ms

_TOLERANT = r"^\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})"
_STRICT = r"^\s*(\d{2}:\d{2}:\d{2},\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2},\d{3})"

# Encodings tried in this order when none is given.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk", "cp936", "utf-16", "utf-16-le", "utf-16-be")


def _levelled(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^﻿+", ""), "\r\n?", "\n")


def decode(data: bytes, encoding: str | None = None, detect: Callable[[bytes], str | None] | None = None) -> tuple[str, str]:
    """(text, encoding): the first that reads the bytes of a given one, that of a byte order mark, a detector's, and the list's."""
    first = [encoding, "utf-8-sig" if data.startswith(b"\xef\xbb\xbf") else None, detect(data) if detect and not encoding else None]
    for name in dict.fromkeys(n for n in (*first, *ENCODINGS) if n):
        try:
            return data.decode(name), name
        except (UnicodeError, LookupError):
            continue
    return data.decode("utf-8", "replace"), "replaced"


def read_files(spark: SparkSession, path: str, encoding: str | None = None, detect: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """(path, text, encoding) of whole files in any of the known encodings; ``detect`` may name one from the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [decode(bytes(c), encoding, detect) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([e for _, e in done], pa.string())], names=["path", "text", "encoding"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, text string, encoding string")


def parse_tolerant(files: DataFrame, entity: str = "path") -> DataFrame:
    """(entity, pos, seq, start_ms, end_ms, text): blocks between blank lines; what is no cue is left out silently."""
    blocks = files.select(entity, F.posexplode(F.split(_levelled(F.col("text")), r"\n\s*\n")).alias("pos", "block"))
    lines = F.split(F.regexp_replace("block", r"^(\s*\n)+|(\n\s*)+$", ""), "\n")
    parts = blocks.withColumn("l", lines).where((F.size("l") >= 2) & F.trim(F.get("l", F.lit(0))).rlike(r"^\d+$") & F.get("l", F.lit(1)).rlike(_TOLERANT))
    at = lambda g: strict_ms(F.replace(F.regexp_extract(F.get("l", F.lit(1)), _TOLERANT, g), F.lit("."), F.lit(",")))
    text = F.regexp_replace(F.array_join(F.slice("l", 3, 1 << 30), "\n"), r"^\n+|\n+$", "")
    return parts.select(entity, "pos", F.trim(F.get("l", F.lit(0))).cast("int").alias("seq"), at(1).alias("start_ms"), at(2).alias("end_ms"), text.alias("text"))


_BREAKS = r"[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _flagged(files: DataFrame, entity: str) -> DataFrame:
    lines = files.select(entity, F.posexplode(F.split(_levelled(F.col("text")), _BREAKS)).alias("n", "line"))
    order = Window.partitionBy(entity).orderBy("n")
    head = F.trim("line").rlike(r"^\d+$") & F.coalesce(F.lead("line").over(order).rlike(_STRICT), F.lit(False))
    return lines.withColumn("head", head).withColumn("cue", F.sum(F.col("head").cast("int")).over(order))


def strict_errors(files: DataFrame, entity: str = "path") -> DataFrame:
    """(entity, line, found): the first line that is no cue's number with a time line behind it, of files that begin with none."""
    before = _flagged(files, entity).where((F.col("cue") == 0) & F.col("line").rlike(r"\S"))
    return before.groupBy(entity).agg(F.min("n").alias("n"), F.min_by("line", "n").alias("found")).select(entity, (F.col("n") + 1).alias("line"), "found")


def parse_strict(files: DataFrame, entity: str = "path", fail: bool = True) -> DataFrame:
    """(entity, pos, seq, start_ms, end_ms, text): a cue runs to the next number line that a time line follows.

    Blank lines inside a text stay, those at its end go, and cues without text
    are left out. pos is the cue's place in the file. A file that doesn't begin
    with a cue fails the query with the line, or with ``fail`` off is left to
    ``strict_errors``.
    """
    flagged = _flagged(files, entity)
    stop = F.raise_error(F.concat(F.lit("no cue in "), F.col(entity).cast("string"), F.lit(" at line "), (F.col("n") + 1).cast("string"), F.lit(": "), F.col("line"))).cast("boolean")
    runs = flagged.where(F.when((F.col("cue") == 0) & F.col("line").rlike(r"\S"), stop if fail else F.lit(False)).otherwise(F.col("cue") > 0))
    grouped = runs.groupBy(entity, "cue").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.regexp_replace(x["line"], r"\s+$", "")).alias("l"))
    at = lambda g: strict_ms(F.regexp_extract(F.get("l", F.lit(1)), _STRICT, g))
    text = F.regexp_replace(F.array_join(F.slice("l", 3, 1 << 30), "\n"), r"\s+$", "")
    out = grouped.select(entity, (F.col("cue") - 1).cast("int").alias("pos"), F.trim(F.get("l", F.lit(0))).cast("int").alias("seq"), at(1).alias("start_ms"), at(2).alias("end_ms"), text.alias("text"))
    return out.where(F.col("text") != "")


def as_cues(parsed: DataFrame, entity: str = "path") -> DataFrame:
    """(episode_id, id, seq, start_ms, end_ms, text) of parsed files: ids from 0 in the order of the file, its numbers as seq."""
    order = Window.partitionBy(entity).orderBy("pos")
    return parsed.select(F.col(entity).alias("episode_id"), (F.row_number().over(order) - 1).cast("int").alias("id"), "seq", "start_ms", "end_ms", "text")


def to_srt(cues: DataFrame, entity: str = "episode_id", order: str = "id") -> DataFrame:
    """(entity, srt): the cues numbered from 1, each with a blank line behind it.

    A cue without a time can't be written and is left out; ``where("start_ms IS
    NULL OR end_ms IS NULL")`` tells which. One row holds an entity's whole
    file, as the file does.
    """
    n = F.row_number().over(Window.partitionBy(entity).orderBy(order))
    block = F.concat(n.cast("string"), F.lit("\n"), format_ms(F.col("start_ms")), F.lit(" --> "), format_ms(F.col("end_ms")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = cues.where("start_ms IS NOT NULL AND end_ms IS NOT NULL").select(entity, F.col(order).alias("o"), block.alias("b"))
    return rows.groupBy(entity).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "b"))), lambda x: x["b"]), "\n").alias("srt"))


def bilingual(cues: DataFrame, entity: str = "episode_id", order: str = "id") -> DataFrame:
    """(entity, srt): cues numbered from 1, the stripped translation (column tr, empty if null) above the text.

    A text that is empty adds no line. One row holds an episode's whole file,
    as the file does.
    """
    tr, text = trimmed(F.coalesce("tr", F.lit(""))), F.coalesce("text", F.lit(""))
    return to_srt(cues.withColumn("text", F.when(text == "", tr).otherwise(F.concat(tr, F.lit("\n"), text))), entity, order)
