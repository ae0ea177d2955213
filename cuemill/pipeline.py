"""The preparation chain, and runs of a translation over tables of cues: summaries, calls, repair and delivery."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill import provider as pv
from cuemill.functions import text as fx
from cuemill.operators import cues as cue_op
from cuemill.operators import responses, runs
from cuemill.operators.wrap import wrap_and_split
from cuemill.session import materialize
from cuemill.sources.srt import bilingual, to_srt

BATCH, OPTIMIZE_BATCH, SUB_BATCHES = 50, 100, (10, 5, 2, 1)


def check_options(preprocess: bool, overlap: str = "auto", resplit: str = "auto", sdh: bool = False, disfluency: bool = False, optimize: bool = False, model: str | None = None, words: str | None = None) -> None:
    """Rejects options of the preparation without the preparation, modes that don't exist, missing files and models."""
    if not preprocess and (overlap != "auto" or resplit != "auto" or sdh or disfluency or optimize or words):
        raise ValueError("options of the preparation need the preparation itself")
    if overlap not in ("on", "off", "auto") or resplit not in ("on", "off", "auto"):
        raise ValueError("modes are on, off and auto")
    if optimize and not model:
        raise ValueError("optimizing needs a model")
    if words and not os.path.isfile(words):
        raise ValueError(f"no such file: {words}")


def stage_a(cues: DataFrame, overlap: str = "auto", sdh: bool = False, disfluency: bool = False, resplit: str = "auto", words: DataFrame | None = None) -> DataFrame:
    """Steps in their order: (episode_id, id, is_split, start_ms, end_ms, text).

    resplit on and off hold for all episodes; auto splits those that have a line
    or a cue too long, or word timings. ``words`` has episode_id, pos, text,
    start_s and end_s; the cues of episodes with words come from the words
    alone, unless there are more sentences than words.
    """
    out = cue_op.clip_overlaps(cues, overlap, renumber=False)
    if sdh:
        out = cue_op.clean_sdh(out, renumber=False)
    if disfluency:
        out = cue_op.clean_disfluency(out, renumber=False)
    if resplit == "off":
        return cue_op.reindex(out).select("episode_id", "id", F.lit(False).alias("is_split"), "start_ms", "end_ms", "text")
    timed = None
    if words is not None:
        timed = materialize(runs.cues_from_words(words))
        out = out.join(timed.select("episode_id").distinct(), "episode_id", "left_anti")
    split = wrap_and_split(out, gate="on" if resplit == "on" else "auto")
    return split if timed is None else split.unionByName(timed)


def input_json(cues: DataFrame) -> DataFrame:
    """(episode_id, batch, input_map, input): what is asked of a model, keys in numeric order, and its JSON text."""
    in_order = F.array_sort(F.collect_list(F.struct("id", F.coalesce("text", F.lit("")).alias("text"))))
    pairs = F.transform(in_order, lambda c: F.struct(c["id"].cast("string"), c["text"]))
    asked = cues.groupBy("episode_id", "batch").agg(F.map_from_entries(pairs).alias("input_map"))
    return asked.withColumn("input", F.to_json("input_map"))


CALLED = "episode_id string, batch_index int, input_map map<string,string>, raw_text string, status string, incomplete_reason string, usage struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>, attempts int, notes array<string>"
_USAGE = pa.struct([(n, pa.int64()) for n in ("input_tokens", "output_tokens", "total_tokens")])


def _called(asked: DataFrame, instructions: str, provider: pv.Provider, retries: int, backoff: float) -> DataFrame:
    """Calls the provider once a row of (episode_id, batch, input_map, input, summary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for pairs, text, summary in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                told = instructions if not summary else f"{instructions.rstrip()}\n\n{pv.SUMMARY_HEADING}\n{summary.strip()}\n"
                reply, tries, notes = pv.call(provider, text, told, dict(pairs), retries, backoff)
                used = {"input_tokens": reply.input_tokens, "output_tokens": reply.output_tokens, "total_tokens": reply.total_tokens}
                done.append((reply.text, reply.status, reply.incomplete_reason, used, tries, notes))
            kinds = (pa.string(), pa.string(), pa.string(), _USAGE, pa.int32(), pa.list_(pa.string()))
            made = [pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["episode_id", "batch_index", "input_map", "raw_text", "status", "incomplete_reason", "usage", "attempts", "notes"])

    return asked.select("episode_id", "batch", "input_map", "input", "summary").mapInArrow(run, CALLED)


def translate(cues: DataFrame, instructions: str, provider: pv.Provider = pv.stub_provider, size: int = BATCH, done: DataFrame | None = None, summaries: DataFrame | None = None, retries: int = 2, backoff: float = 3.0) -> DataFrame:
    """One row per batch of cues: what was asked, the last reply, its status, tokens, tries and notes.

    ``done`` holds the batches of earlier runs, which are not called again;
    ``summaries`` (episode_id, summary) are added to the instructions. The
    result should be written before use: a provider is not deterministic.
    """
    asked = input_json(cue_op.batches(cues.where(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))), size))
    if done is not None:
        asked = asked.join(done.select("episode_id", F.col("batch_index").alias("batch")).distinct(), ["episode_id", "batch"], "left_anti")
    told = asked.withColumn("summary", F.lit(None).cast("string")) if summaries is None else asked.join(summaries.select("episode_id", "summary"), "episode_id", "left")
    return _called(told, instructions, provider, retries, backoff)


def answers(called: DataFrame) -> DataFrame:
    """(episode_id, id, tr) of the calls' responses, mended where that is possible."""
    got = responses.entries(responses.checked(called, "episode_id"), "episode_id").where(responses.accepted())
    return got.select("episode_id", F.expr("try_cast(key AS int)").alias("id"), "tr")


def repair(called: DataFrame, instructions: str, provider: pv.Provider = pv.stub_provider, chosen: list[int] | None = None, sizes: tuple[int, ...] = SUB_BATCHES, retries: int = 1, backoff: float = 3.0) -> DataFrame:
    """(episode_id, key, tr): the accepted entries of a run after its failed batches were asked again.

    A failed batch is asked again whole, then what it still lacks in smaller and
    smaller parts; only parts that hold as a whole are taken. Each size is one
    distributed pass over what is still missing, written before the next.
    """
    keep = ("episode_id", "batch_index", "status", "incomplete_reason", "input_map")
    checks = materialize(responses.checked(called, *keep))
    good = responses.entries(checks, "episode_id", "batch_index").where(responses.accepted()).select("episode_id", "batch_index", "key", "tr")
    reports = checks.select("episode_id", "batch_index", responses.fine().alias("ok"))
    failed = responses.choose_batches(reports, chosen)
    redo = materialize(checks.join(failed, ["episode_id", "batch_index"], "left_semi").select("episode_id", F.col("batch_index").alias("batch"), "input_map"))
    kept = good.join(failed, ["episode_id", "batch_index"], "left_anti").select("episode_id", "key", "tr")
    found = [kept]
    asked = redo
    wanted = redo.select("episode_id", "batch", F.explode("input_map").alias("key", "text"))
    for size in (None, *sizes):
        if size is not None:
            number = F.coalesce(F.expr("try_cast(key AS int)"), F.lit(2**31 - 1))
            part = F.floor((F.row_number().over(Window.partitionBy("episode_id", "batch").orderBy(number, "key")) - 1) / size)
            grouped = wanted.withColumn("part", part).groupBy("episode_id", "batch", "part")
            asked = grouped.agg(F.map_from_entries(F.collect_list(F.struct("key", "text"))).alias("input_map")).drop("part")
        calls = _called(asked.select("episode_id", "batch", "input_map", F.to_json("input_map").alias("input"), F.lit(None).cast("string").alias("summary")), instructions, provider, retries, backoff)
        again = materialize(responses.checked(materialize(calls), "episode_id", "batch_index", "status", "incomplete_reason"))
        got = responses.entries(again.where(responses.fine()), "episode_id", "batch_index").select("episode_id", F.col("batch_index").alias("batch"), "key", "tr")
        found.append(got.select("episode_id", "key", "tr"))
        wanted = materialize(wanted.join(got.select("episode_id", "batch", "key"), ["episode_id", "batch", "key"], "left_anti"))
        if wanted.isEmpty():
            break
    rest = good.withColumnRenamed("batch_index", "batch").join(wanted.select("episode_id", "batch", "key"), ["episode_id", "batch", "key"], "left_semi")
    out = rest.select("episode_id", "key", "tr")  # what an earlier try had, where no later one held
    for part in found:
        out = out.unionByName(part)
    return out


def summaries(cues: DataFrame, models: DataFrame, instructions: str, provider: pv.Provider, retries: int = 2, backoff: float = 3.0) -> DataFrame:
    """(episode_id, model, summary, status): one reading of each episode by each model, to be joined to all its arms.

    One row holds an episode's whole text, as one call does.
    """
    line = F.concat(F.col("id").cast("string"), F.lit("\t"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" / ")))
    texts = cues.groupBy("episode_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]), "\n").alias("payload"))
    names = [r[0] for r in models.select("model").distinct().collect()]  # the models of a profile
    rows = texts.select("episode_id", F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("model"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [pv.call(provider, text, instructions, None, retries, backoff)[0] for text in batch.column(2).to_pylist()]
            texts_ = [d.text.strip() if d.status == "completed" and not d.incomplete_reason else None for d in done]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts_, pa.string()), pa.array([d.status for d in done], pa.string())], names=["episode_id", "model", "summary", "status"])

    return rows.mapInArrow(run, "episode_id string, model string, summary string, status string")


def optimize(cues: DataFrame, instructions: str, provider: pv.Provider, size: int = OPTIMIZE_BATCH) -> DataFrame:
    """The cues with texts improved by a model, one to one.

    Cues of sound descriptions are not sent. A call that isn't completed or
    whose keys aren't just those asked fails the step. Answers that are blank or
    no text leave the cue as it was.
    """
    sent = cues.where(~F.coalesce(fx.sdh_only(F.col("text")), F.lit(False)))
    asked = input_json(cue_op.batches(sent, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for episode, pairs, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                reply = provider(text, instructions)
                if reply.status != "completed":
                    raise RuntimeError(f"optimizing {episode} failed: {reply.status}, {reply.incomplete_reason}")
                rows += [(episode, int(k), v) for k, v in pv.same_keys(reply.text, dict(pairs)).items() if isinstance(v, str) and v.strip()]
            kinds = (pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["episode_id", "id", "better"])

    better = asked.select("episode_id", "input_map", "input").mapInArrow(run, "episode_id string, id int, better string")
    return cues.join(materialize(better), ["episode_id", "id"], "left").withColumn("text", F.coalesce("better", "text")).drop("better")


def sentences(packs: DataFrame, key: str, words: str, instructions: str | None = None, provider: pv.Provider | None = None) -> DataFrame:
    """(key, sentences): a model's cut of a text at <br>, or without a model the packs themselves."""
    if provider is None:
        return packs.select(key, F.array(words).alias("sentences"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = []
            for text in batch.column(1).to_pylist():
                reply = provider(text, instructions or "")
                parts = [p.strip() for p in re.split(r"<br\s*/?>", reply.text) if p.strip()] if reply.status == "completed" else []
                cut.append(parts or [text])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.list_(pa.string()))], names=[key, "sentences"])

    return packs.select(key, words).mapInArrow(run, f"`{key}` {packs.schema[key].dataType.simpleString()}, sentences array<string>")


def delivery_path(source: str, output: str | None = None, model: str | None = None, n_models: int = 1) -> str:
    """Where a finished file goes: ``output`` for a single model, else beside the source, with the model's name if there are several."""
    if output and n_models == 1:
        return output
    stem = os.path.splitext(os.path.basename(source))[0]
    name = f"{stem}_zh.srt" if n_models == 1 or model is None else f"{stem}_{model.replace('/', '_')}_zh.srt"
    return os.path.join(os.path.dirname(source), name)


def run_report(called: DataFrame, *by: str) -> DataFrame:
    """One row per run: batches, those that hold, whether all do, the first three errors of each batch, tokens."""
    by = by or ("episode_id",)
    checks = responses.checked(called, *dict.fromkeys((*by, "batch_index", "status", "incomplete_reason", "usage")))
    per_batch = checks.select(*by, "batch_index", responses.fine().alias("ok"), F.slice(responses.messages(), 1, 3).alias("errors"), "usage")
    tokens = [F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")]
    errors = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("batch_index", "errors"))), lambda x: x["errors"]))
    return per_batch.groupBy(*by).agg(F.count("*").alias("n_batches"), F.count_if("ok").alias("n_batches_ok"), F.bool_and("ok").alias("ok"), errors.alias("errors"), *tokens)


def write_run(called: DataFrame, cues: DataFrame, folder: str) -> None:
    """The artefacts of a run, each a table by episode: calls, checks, reports, parsed entries, and SRT texts.

    An episode with a batch that doesn't hold has no SRT, only a row in the
    table ``partial``. Tables are replaced as a whole by the commit protocol of
    the writer, so a run that dies leaves the former ones.
    """
    out = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}")
    out(called, "calls")
    called = called.sparkSession.read.parquet(f"{folder}/calls")
    checks = responses.checked(called, "episode_id", "batch_index", "status", "incomplete_reason")
    out(checks, "checks")
    report = run_report(called)
    out(report, "reports")
    tr = answers(called)
    out(tr, "parsed")
    spark = called.sparkSession
    ok = spark.read.parquet(f"{folder}/reports").select("episode_id", "ok")
    whole = cues.join(ok.where("ok"), "episode_id", "left_semi").join(spark.read.parquet(f"{folder}/parsed"), ["episode_id", "id"], "left")
    out(bilingual(whole), "srt")
    out(ok.where("NOT ok").select("episode_id"), "partial")


def write_files(texts: DataFrame, path: Column | str, text: str) -> int:
    """Writes each row's text to its path, on a file system all machines share; every file appears whole or not at all."""

    def run(rows: Iterator) -> Iterator[int]:
        n = 0
        for row in rows:
            os.makedirs(os.path.dirname(row[0]) or ".", exist_ok=True)
            with open(f"{row[0]}.tmp", "w", encoding="utf-8") as f:
                f.write(row[1] or "")
            os.replace(f"{row[0]}.tmp", row[0])
            n += 1
        yield n

    return sum(texts.select(path, text).rdd.mapPartitions(run).collect())  # one number a task


def write_private(path: str, value: object) -> None:
    """A JSON file only its owner may read, replaced as a whole; for the blind map of a bench."""
    handle = os.open(f"{path}.tmp", os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        os.fchmod(f.fileno(), 0o600)
        f.write(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    os.replace(f"{path}.tmp", path)


def freeze(folder: str, hashes: dict[str, str]) -> bool:
    """Locks a folder to the hashes of its inputs; true if it was free. Another set of hashes is an error."""
    path = os.path.join(folder, "lock.json")
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        changed = sorted(k for k in {*held, *hashes} if held.get(k) != hashes.get(k))
        if changed:
            raise ValueError(f"{folder} is frozen by other inputs: {', '.join(changed)}")
        return False
    os.makedirs(folder, exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(hashes, f, sort_keys=True)
    os.replace(f"{path}.tmp", path)
    return True


def prepare_and_write(cues: DataFrame, folder: str, **options) -> DataFrame:
    """stage_a with its audit trail: the cues before and after, the clean SRT texts, and a report by episode."""
    out = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}")
    out(cues, "input")
    before = cues.sparkSession.read.parquet(f"{folder}/input")
    out(stage_a(before, **options), "clean")
    after = cues.sparkSession.read.parquet(f"{folder}/clean")
    out(to_srt(after), "srt")
    from cuemill.operators.wrap import compliance

    counts = before.groupBy("episode_id").agg(F.count("*").alias("n_in"))
    report = counts.join(cue_op.overlap_stats(before), "episode_id").join(cue_op.needs_resplit(before), "episode_id").join(compliance(after), "episode_id", "left").withColumnRenamed("total", "n_out")
    out(report, "report")
    return after


def self_check(cues: DataFrame, template: str = "${sourceLanguage} ${targetLanguage}", most: int = 8, size: int = BATCH) -> DataFrame:
    """(episode_id, check, ok): what must hold for any table of cues, without a model."""
    n = cues.groupBy("episode_id").agg(F.count("*").alias("n"))
    sliced = cue_op.slice_cues(cues, 0, most)
    parts = sliced.groupBy("episode_id").agg(F.count("*").alias("k"), F.min("id").alias("low"), F.max("id").alias("high"))
    plan = cue_op.batch_plan(cue_op.batches(cue_op.reindex(cues), size)).groupBy("episode_id").agg(F.count("*").alias("b"), F.sum("n").alias("s"), F.min("id_from").alias("first"))
    asked = input_json(sliced.withColumn("batch", F.lit(0)))
    good = F.to_json(F.transform_values("input_map", lambda k, v: F.struct(v.alias("src"), F.lit("ok").alias("tr"))))
    fenced = F.concat(F.lit("```json\n"), good, F.lit("\n```"))
    short = F.to_json(F.map_filter(F.transform_values("input_map", lambda k, v: F.struct(v.alias("src"), F.lit("ok").alias("tr"))), lambda k, v: k != "0"))
    trial = lambda raw, name: responses.checked(asked.select("episode_id", "input_map", raw.alias("raw_text")), "episode_id").select("episode_id", F.col("ok").alias(name))
    srt = bilingual(sliced.withColumn("tr", F.lit("one line"))).select("episode_id", F.col("srt").contains("one line").alias("srt"))
    row = n.join(parts, "episode_id").join(plan, "episode_id").join(srt, "episode_id", "left")
    for raw, name in ((good, "whole"), (fenced, "fenced"), (short, "short")):
        row = row.join(trial(raw, name), "episode_id", "left")
    told = pv.instructions(template, "a", "b", ["x = y"])
    checks = {
        "sliced": (F.col("k") == F.least("n", F.lit(most))) & (F.col("low") == 0) & (F.col("high") == F.col("k") - 1), "batches": F.col("b") == F.greatest(F.ceil(F.col("n") / size), F.lit(1)),
        "batches_cover": (F.col("s") == F.col("n")) & (F.col("first") == 0), "whole_response_holds": F.col("whole"), "fenced_response_holds": F.col("fenced"), "missing_key_fails": ~F.col("short"),
        "bilingual": F.coalesce("srt", F.lit(True)), "instructions_filled": F.lit("${" not in told and pv.GLOSSARY_HEADING in told),
    }
    stacked = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in checks.items()])
    return row.select("episode_id", F.inline(stacked))
