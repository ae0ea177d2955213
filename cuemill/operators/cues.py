"""Cue tables: keys, batches, overlaps, quality and languages.

A cue table has episode_id, id, start_ms, end_ms and text, one row per cue;
cues are ordered by id within an episode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cuemill.functions import text as fx
from cuemill.functions.timecode import lenient_ms



def order() -> WindowSpec:
    return Window.partitionBy("episode_id").orderBy("id")

MIN_OVERLAP_MS = 50


def distinct_cues(raw: DataFrame) -> DataFrame:
    """One row per cue; repeated rows of a cue differ in nothing but their arrival.

    The rows are brought together by episode, which also serves the windows
    that follow: one shuffle for both.
    """
    cues = raw.select("episode_id", "id", "seq", lenient_ms(F.col("start_tc")).alias("start_ms"), lenient_ms(F.col("end_tc")).alias("end_ms"), "text")
    return cues.repartition("episode_id").distinct()


def reindex(cues: DataFrame) -> DataFrame:
    """id := 0..n-1 within the episode."""
    return cues.withColumn("id", (F.row_number().over(order()) - 1).cast("int"))


def slice_cues(cues: DataFrame, offset: int = 0, most: int | None = None) -> DataFrame:
    """Cues offset..offset+most-1 of each episode, re-indexed."""
    at = F.row_number().over(order()) - 1
    keep = (F.col("__at") >= offset) & (F.lit(True) if most is None else F.col("__at") < offset + most)
    return reindex(cues.withColumn("__at", at).where(keep).drop("__at"))


def batches(cues: DataFrame, size: int | None) -> DataFrame:
    """Adds batch: consecutive runs of ``size`` cues; no size, or one not below n, is a single batch."""
    at = F.row_number().over(order()) - 1
    n = F.count("*").over(Window.partitionBy("episode_id"))
    if not size or size <= 0:
        return cues.withColumn("batch", F.lit(0))
    return cues.withColumn("batch", F.when(n <= size, 0).otherwise((at / size).cast("int")))


def batch_plan(batched: DataFrame) -> DataFrame:
    return batched.groupBy("episode_id", "batch").agg(F.count("*").alias("n"), F.min("id").alias("id_from"), F.max("id").alias("id_to"))


def overlap_stats(cues: DataFrame, least_ms: int = MIN_OVERLAP_MS) -> DataFrame:
    """Pairs of neighbours, overlaps of at least ``least_ms``, the longest, and their share."""
    over = F.col("end_ms") - F.lead("start_ms").over(order())
    hit = F.col("over") >= least_ms
    counted = cues.withColumn("over", over).groupBy("episode_id").agg(
        (F.count("*") - 1).alias("pair_count"), F.count_if(hit).alias("overlap_count"), F.coalesce(F.max(F.when(hit, F.col("over"))), F.lit(0)).alias("max_overlap_ms")
    )
    return counted.withColumn("overlap_ratio", F.round(F.when(F.col("pair_count") > 0, F.col("overlap_count") / F.col("pair_count")).otherwise(0.0), 6))


def clip_overlaps(cues: DataFrame, mode: str = "auto", renumber: bool = True) -> DataFrame:
    """end := min(end, next start); then cues without text go and ids run from 0.

    mode on clips always, off never, auto in the episodes that have an overlap.
    """
    nxt = F.lead("start_ms").over(order())
    over = F.max(F.coalesce((F.col("end_ms") - F.col("__next")) >= MIN_OVERLAP_MS, F.lit(False))).over(Window.partitionBy("episode_id"))
    gate = {"on": F.lit(True), "off": F.lit(False), "auto": over}[mode]
    clipped = cues.withColumn("__next", nxt).withColumn("__gate", gate)
    clipped = clipped.withColumn("end_ms", F.when(F.col("__gate") & (F.col("__next") < F.col("end_ms")), F.col("__next")).otherwise(F.col("end_ms")))
    kept = clipped.where(~F.col("__gate") | F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).drop("__next", "__gate")
    return reindex(kept) if renumber else kept


def quality(cues: DataFrame, tr: str = "text") -> DataFrame:
    """Reading speed, line lengths and issues of each cue's text."""
    parts = fx.lines(F.col(tr))
    seconds = F.round((F.col("end_ms") - F.col("start_ms")) / 1000, 3)
    bad = F.coalesce(F.col("seconds") <= 0, F.lit(True))
    base = cues.select("episode_id", "id", seconds.alias("seconds"), parts.alias("__l")).withColumns(
        {"n_lines": F.size("__l"), "chars": F.aggregate("__l", F.lit(0), lambda a, x: a + F.length(x)), "max_line_chars": F.coalesce(F.array_max(F.transform("__l", F.length)), F.lit(0))}
    )
    base = base.withColumn("missing", F.col("n_lines") == 0).withColumn("cps", F.when(~bad & ~F.col("missing"), F.round(F.col("chars") / F.col("seconds"), 2)))
    told = ~F.col("missing")
    checks = [
        (F.col("missing"), "missing"), (told & bad, "bad_duration"), (told & ~bad & (F.col("seconds") < fx.MIN_SECONDS), "too_short"),
        (told & ~bad & (F.col("seconds") > fx.MAX_SECONDS), "too_long"), (F.col("cps") > fx.MAX_CPS, "cps"),
        (told & (F.col("max_line_chars") > fx.MAX_LINE), "line"), (told & (F.col("n_lines") > fx.MAX_LINES), "lines"),
    ]
    issues = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
    return base.select("episode_id", "id", F.when(told, F.col("seconds")).alias("seconds"), "chars", "cps", "n_lines", "max_line_chars", issues.alias("issues"))


def quality_summary(per_cue: DataFrame) -> DataFrame:
    """Counts of issues, the highest speed and its 95th percentile, ties up whatever their binary form."""
    has = lambda *names: F.count_if(F.arrays_overlap("issues", F.array(*map(F.lit, names))))
    return per_cue.groupBy("episode_id").agg(
        F.count("*").alias("n"), has("missing").alias("n_missing"), has("cps").alias("n_cps_over"), has("line").alias("n_line_over"), has("lines").alias("n_lines_over"),
        has("bad_duration", "too_short").alias("n_bad_duration"), F.round(F.max("cps"), 2).alias("max_cps"), (F.floor(F.round(F.percentile("cps", F.lit(0.95)) * 100, 6) + 0.5) / 100).alias("p95_cps"),
    )


def with_speed(cues: DataFrame, audience: str = "adult", sdh: bool = False) -> DataFrame:
    """Language, characters a second and whether that is within the language's limit for the audience."""
    text = F.coalesce("text", F.lit(""))
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
    chars = F.length(F.regexp_replace(text, "\n", ""))
    return (
        cues.withColumn("language", fx.language(text))
        .withColumn("speed", F.round(F.when(seconds > 0, chars / seconds).otherwise(0.0), 4))
        .withColumn("readable", F.col("speed") <= fx.speed_limit(F.col("language"), audience, sdh))
        .select("episode_id", "id", "language", "speed", "readable")
    )


def needs_split(cues: DataFrame) -> DataFrame:
    """Cues with more than two lines, a line over its language's limit, or too fast for the default speed."""
    parts = fx.lines(F.col("text"))
    long = F.exists(parts, lambda x: F.length(x) > fx.line_limit(fx.language(x)))
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
    chars = F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))
    fast = F.coalesce((seconds > 0) & (chars / seconds > fx.DEFAULT_SPEED), F.lit(False))
    return cues.select("episode_id", "id", (F.size(parts) > 2).alias("many_lines"), long.alias("long_line"), fast.alias("too_fast"), ((F.size(parts) > 2) | long | fast).alias("split"))


def needs_resplit(cues: DataFrame, limit: int = 42, most_lines: int = 2) -> DataFrame:
    parts = fx.lines(F.col("text"))
    return cues.groupBy("episode_id").agg(F.coalesce(F.bool_or((F.size(parts) > most_lines) | F.exists(parts, lambda x: F.length(x) > limit)), F.lit(False)).alias("resplit"))


def document_language(cues: DataFrame) -> DataFrame:
    """Counts are additive, so each episode's language needs one aggregate."""
    n = fx.counts(F.coalesce("text", F.lit("")))
    summed = cues.groupBy("episode_id").agg(*[F.sum(c).alias(k) for k, c in n.items()])
    s = fx.scores({k: F.col(k) for k in n})
    return summed.select("episode_id", *[F.round(v, 6).alias(f"score_{k}") for k, v in s.items()], F.when(F.col("total") == 0, "en").otherwise(fx.best(s)).alias("language"))


def _with_text(cues: DataFrame, parts: Column) -> DataFrame:
    """The lines as the cue's text; cues left without any go. The text is computed once, not again for the test."""
    others = [c for c in cues.columns if c != "text"]
    told = F.filter(F.array(F.array_join(parts, "\n")), lambda t: t != "")
    return cues.select(*others, F.explode(told).alias("text")).select(*cues.columns)


def clean_sdh(cues: DataFrame, renumber: bool = True) -> DataFrame:
    """Drops cues of sound descriptions, strips them elsewhere, drops what is left empty, re-indexes."""
    kept = cues.where(F.coalesce(~fx.sdh_only(F.col("text")), F.lit(False)))
    out = _with_text(kept, fx.sdh_strip(F.transform(F.split("text", "\n"), fx.trimmed)))
    return reindex(out) if renumber else out


def clean_disfluency(cues: DataFrame, renumber: bool = True) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), fx.fluent), lambda x: x != "")
    out = _with_text(cues, parts)
    return reindex(out) if renumber else out


def fragment(text: Column) -> Column:
    """Empty, under 15 characters or under three words."""
    whole = fx.trimmed(text)
    return (F.length(whole) < 15) | (F.size(F.filter(F.split(whole, r"\s+"), lambda w: w != "")) < 3)


def merge_fragments(pieces: DataFrame) -> DataFrame:
    """A fragment made by a split joins the cue before it: (episode_id, id, is_split, start_ms, end_ms, text)."""
    head = (~(F.col("is_split") & fragment(F.col("text")))) | (F.row_number().over(order()) == 1)
    runs = pieces.withColumn("run", F.sum(head.cast("int")).over(order()))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"])
    merged = runs.groupBy("episode_id", "run").agg(F.min("id").alias("first_id"), F.min_by("is_split", "id").alias("is_split"), F.min_by("start_ms", "id").alias("start_ms"), F.max_by("end_ms", "id").alias("end_ms"), fx.flatten(F.filter(parts, lambda x: x != "")).alias("text"), F.count("*").alias("n"))
    return merged.select("episode_id", (F.col("run") - 1).cast("int").alias("id"), "first_id", "is_split", "start_ms", "end_ms", "text", "n")


def context(cues: DataFrame, width: int = 5, *keep: str) -> DataFrame:
    """The texts of up to ``width`` cues before and after each cue, beside the kept columns."""
    text = F.coalesce("text", F.lit(""))
    return cues.select(
        "episode_id", "id", *keep,
        F.array_join(F.collect_list(text).over(order().rowsBetween(-width, -1)), "|").alias("before"),
        F.array_join(F.collect_list(text).over(order().rowsBetween(1, width)), "|").alias("after"),
    )


def bilingual(cues: DataFrame) -> DataFrame:
    languages = F.array_distinct(F.transform(fx.lines(F.col("text")), fx.language))
    return cues.select("episode_id", "id", F.size(languages).alias("n_languages"), (F.size(languages) > 1).alias("bilingual"), fx.dialogue(F.col("text")).alias("dialogue"))
