"""Runs over tables: frozen inputs, repair windows, overlays, blinded items, word streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PACK, OVERSHOOT, LEAST_SECONDS = 18, 40, 0.3
PRIVATE = frozenset({"case_id", "candidate_id", "model_alias", "model_id", "temperature", "top_p", "lane", "status"})  # must not reach evaluators


def frozen(cues: DataFrame) -> DataFrame:
    """Hash and number of cues of each episode's source; a changed hash means a changed input."""
    line = F.concat_ws("\t", F.col("id").cast("string"), F.coalesce("start_ms", F.lit(-1)).cast("string"), F.coalesce("text", F.lit("")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"])
    return cues.groupBy("episode_id").agg(F.sha2(F.array_join(rows, "\n"), 256).alias("sha256"), F.count("*").alias("n_cues"))


def find_window(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where each episode's wanted texts lie in a row in its source: (episode_id, n_starts, first_start).

    A repair must stop unless n_starts is 1. Both have episode_id, pos and text.
    """
    length = wanted.groupBy("episode_id").agg(F.count("*").alias("n"))
    pairs = source.select("episode_id", F.col("pos").alias("at"), "text").join(wanted.select("episode_id", F.col("pos").alias("k"), "text"), ["episode_id", "text"])
    starts = pairs.groupBy("episode_id", (F.col("at") - F.col("k")).alias("start")).agg(F.count("*").alias("hits"))
    full = starts.join(length, "episode_id").where("hits = n")
    return full.groupBy("episode_id").agg(F.count("*").alias("n_starts"), F.min("start").alias("first_start"))


def positions_equal(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(episode_id, n, differing): position by position, whether the wanted texts are those of the selected source.

    A repair must stop where differing isn't 0; positions that only one side has differ.
    """
    a = source.select("episode_id", "pos", F.struct("text").alias("a"))
    b = wanted.select("episode_id", "pos", F.struct("text").alias("b"))
    both = a.join(b, ["episode_id", "pos"], "full")
    return both.groupBy("episode_id").agg(F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"))


def drifted(frozen_then: DataFrame, frozen_now: DataFrame, key: str = "episode_id") -> DataFrame:
    """(key, now): inputs whose hash is another than in the manifest, or that are gone (now is null)."""
    then = frozen_then.select(key, F.col("sha256").alias("was")).distinct()
    both = then.join(frozen_now.select(key, F.col("sha256").alias("now")), key, "left")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select(key, "now")


def key_sets(want: DataFrame, have: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, missing, unexpected, subset, same): how the keys of each group of ``want`` relate to those it has."""
    both = want.select(*by, key, F.lit(True).alias("w")).distinct().join(have.select(*by, key, F.lit(True).alias("h")).distinct(), [*by, key], "full")
    out = both.groupBy(*by).agg(F.count_if(F.col("h").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("unexpected"))
    return out.select("*", (F.col("missing") == 0).alias("subset"), ((F.col("missing") == 0) & (F.col("unexpected") == 0)).alias("same"))


def overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and the old ones whose key is not among them."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def beside(cues: DataFrame, translations: DataFrame) -> DataFrame:
    """(episode_id, id, text, tr): every cue once with its translation, null if there is none.

    ``cues`` may repeat rows. Both tables are brought together by episode, which
    also serves windows over the result: one shuffle of either, and none behind.
    """
    left = cues.select("episode_id", "id", "text", F.lit(None).cast("string").alias("tr"), F.lit(1).alias("is_cue"))
    right = translations.select("episode_id", "id", F.lit(None).cast("string").alias("text"), "tr", F.lit(0).alias("is_cue"))
    both = left.unionByName(right).repartition("episode_id").groupBy("episode_id", "id")
    return both.agg(F.max("text").alias("text"), F.max("tr").alias("tr"), F.max("is_cue").alias("is_cue")).where("is_cue = 1").drop("is_cue")


def blinded(rows: DataFrame, secret: str) -> DataFrame:
    """Replaces the keys by a keyed hash and drops what would tell who made it; fails if something is left."""
    open_ = [c for c in rows.columns if c not in PRIVATE and c not in ("episode_id", "id")]
    out = rows.select(F.concat(F.lit("anon-"), F.substring(F.sha2(F.concat_ws(":", F.lit(secret), "episode_id", F.col("id").cast("string")), 256), 1, 16)).alias("anonymous_id"), *open_)
    left = PRIVATE & set(out.columns)
    if left:
        raise ValueError(f"private columns: {sorted(left)}")
    return out


def pack_words(texts: DataFrame, key: str, text: str, size: int = PACK) -> DataFrame:
    """(key, pack, words): the words of each text in packs of ``size``, without a shuffle."""
    found = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1, F.lit(size)))
    packs = texts.select(key, found.alias("w")).select(key, F.posexplode(F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, size), " "))).alias("pack", "words"))
    return packs


def align_words(table: DataFrame, key: str) -> DataFrame:
    """(key, sentence, start_s, end_s): greedy timing of ``sentences`` by ``words`` (text, start_s, end_s).

    From the next unused word on, words are taken until what was taken contains
    the sentence, is part of it, or is longer by OVERSHOOT; the sentence starts
    with the first word taken and ends with the last, at least LEAST_SECONDS
    later. Sentences beyond the last word come out without times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, sentences, words in zip(*(c.to_pylist() for c in batch.columns)):
                at = 0
                for n, sentence in enumerate(sentences or []):
                    goal, taken, first = sentence.lower(), "", at
                    while at < len(words or []):
                        taken += (words[at]["text"] or "").lower()
                        at += 1
                        if goal in taken or taken in goal or len(taken) > len(goal) + OVERSHOOT:
                            break
                    if at == first:
                        rows.append((k, n, sentence, None, None))
                        continue
                    start, end = words[first]["start_s"], words[at - 1]["end_s"]
                    rows.append((k, n, sentence, start, end if end > start else start + LEAST_SECONDS))
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.float64(), pa.float64())
            names = (key, "n", "sentence", "start_s", "end_s")
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(names, kinds))})

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, "sentences", "words").mapInArrow(run, f"`{key}` {kind}, n int, sentence string, start_s double, end_s double")


def cues_from_words(words: DataFrame, size: int = PACK) -> DataFrame:
    """(episode_id, id, is_split, start_ms, end_ms, text): cues of ``size`` words each, timed by their words.

    ``words`` has episode_id, pos, text, start_s and end_s; blank words fill no
    place. Each pack is timed by the greedy alignment of align_words, which by
    its rule mostly takes one word a pack; episodes with more packs than words
    come out with none.
    """
    spoken = words.where(F.coalesce(F.trim("text"), F.lit("")) != "")
    place = F.floor((F.row_number().over(Window.partitionBy("episode_id").orderBy("pos")) - 1) / size)
    packs = spoken.withColumn("pack", place).groupBy("episode_id", "pack").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("sentence"))
    sentences = packs.groupBy("episode_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pack", "sentence"))), lambda x: x["sentence"]).alias("sentences"))
    timed = words.groupBy("episode_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text", "start_s", "end_s"))), lambda w: F.struct(w["text"].alias("text"), w["start_s"].alias("start_s"), w["end_s"].alias("end_s"))).alias("words"))
    out = align_words(sentences.join(timed, "episode_id"), "episode_id")
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return out.where("start_s IS NOT NULL").select("episode_id", F.col("n").alias("id"), F.lit(True).alias("is_split"), ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), F.col("sentence").alias("text"))
