"""Defective prompt and response pairs.

Openings of the responses are clustered by MinHash, every link verified by the
Jaccard similarity of character shingles. A cluster that recurs over unrelated
prompts, and a good part of whose responses bring no answer at all, is a refusal
template; a response that has it declines, whatever else it says. Copy,
language and termination checks label the remaining defects. The first defect
that holds, in the order of DEFECTS, is the pair's defect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.answers import blank, openings, plain, read_answer
from cuemill.llm.language import NAMES, Languages
from cuemill.llm.measures import Hashes, _mix
from cuemill.session import materialize

DEFECTS = ("refusal", "empty", "truncated", "copied", "wrong_language")

# What a refusing provider writes into status or incomplete_reason.
REFUSAL_MARKERS = ("refusal", "safety", "content policy", "content_filter", "content filter", "blocked")

SAMPLE_ROWS = 4000  # labelled answers the language classifier is fitted on
SHINGLE, BANDS, ROWS = 5, 20, 4
LEAST_SIMILARITY = 0.8
ANSWERLESS_SHARE = 0.2
SLOTS, UNRELATED = 8, 4  # MinHash values of a prompt, and how many of them must differ in a cluster
SALT_ROWS = 100_000  # members of a band that one task compares with its leaders

_RND = np.random.default_rng(20240601)
_A = _RND.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RND.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str) -> set[str]:
    return {text[i : i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1))}


def similar(a: set[str], b: set[str]) -> bool:
    return len(a & b) >= LEAST_SIMILARITY * len(a | b)


def band_hashes(texts: list[str]) -> np.ndarray:
    """[text, band] of the MinHash signatures of all texts at once; every text must have a character."""
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    count = np.maximum(sizes - SHINGLE + 1, 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.arange(count.sum()) - np.repeat(first - starts, count)
    base = Hashes(code).of(at, np.minimum(at + SHINGLE, np.repeat(starts + sizes, count)))
    bands = np.empty((len(texts), BANDS), np.int64)
    for b in range(BANDS):
        key = np.full(len(texts), b + 1, np.uint64)
        for r in range(b * ROWS, (b + 1) * ROWS):
            key = _mix(key + np.minimum.reduceat(_mix(base * _A[r] + _B[r]), first))
        bands[:, b] = (key >> np.uint64(1)).astype(np.int64)
    return bands


_ASKED = re.compile(r"(?i)\b(" + "|".join(NAMES) + r")\b")


def _target(code: str | None, instructions: str | None) -> str | None:
    if code:
        return code.lower().split("-")[0]
    named = _ASKED.findall(instructions or "")
    return NAMES[named[-1].lower()] if named else None


def _keys(asked: list[tuple[str, str]]) -> list[str]:
    keys = [k for k, _ in asked]
    return sorted(keys, key=int) if all(k.isdigit() for k in keys) else keys


def prompt_slots(prompts: list[str]) -> np.ndarray:
    """[prompt, slot]: MinHash of the words that were asked to be translated, for all prompts at once."""
    words = [set(p.lower().split()) or {""} for p in prompts]
    base = np.array([xxhash.xxh64_intdigest(w) for ws in words for w in ws], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(ws) for ws in words])[:-1]]).astype(np.int64)
    out = np.empty((len(prompts), SLOTS), np.int64)
    for i in range(SLOTS if prompts else 0):
        out[:, i] = (np.minimum.reduceat(_mix(base * _A[i] + _B[i]), first) >> np.uint64(1)).astype(np.int64)
    return out


_PARSED = "id bigint, at bigint, bare boolean, declined boolean, empty boolean, truncated boolean, copied boolean, target string, answers array<string>, openings array<string>, prompt array<bigint>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per record: its entries, openings and what can be told from the record alone."""
    names = [part.split()[0] for part in _PARSED.split(", ")]
    for batch in batches:
        out: dict[str, list] = {n: [] for n in names}
        for id_, at, code, asks, keys, texts, raw, status, reason in zip(*(c.to_pylist() for c in batch.columns)):
            asked = [(k, t or "") for k, t in zip(keys or (), texts or ())]
            sources = dict(asked)
            answer = read_answer(raw)
            entries = answer.entries
            told = [e for e in entries if not blank(e.tr)]
            missing_last = bool(entries) and bool(asked) and _keys(asked)[-1] not in {e.key for e in entries}
            same, answers = 0, []
            for e in told:
                mine, own = plain(e.tr), sources.get(e.key, e.src or "")
                echo = {own, e.src if e.src is not None else sources.get(e.key, "")}
                hit = any(mine == plain(s) if mine else (e.tr or "").strip() == s.strip() for s in echo)
                same += hit
                if mine != plain(own):
                    answers.append(e.tr)
            said = [c for text in answer.said for c in openings(text)]
            said += [c for e in told for c in openings(e.tr)]
            word = f"{status or ''} {reason or ''}".lower()
            out["id"].append(id_)
            out["at"].append(at)
            out["bare"].append(not told)
            out["declined"].append(any(m in word for m in REFUSAL_MARKERS))
            out["empty"].append(not told or 2 * (len(entries) - len(told)) > len(entries))
            out["truncated"].append(answer.cut or missing_last)
            out["copied"].append(bool(entries) and 2 * same > len(entries))
            out["target"].append(_target(code, asks))
            out["answers"].append(answers)
            out["openings"].append(sorted({c.encode("utf-8", "replace").decode() for c in said}))
            out["prompt"].append("\n".join(v for _, v in asked))
        out["prompt"] = prompt_slots(out["prompt"]).tolist()
        kinds = (pa.int64(), pa.int64(), *[pa.bool_()] * 5, pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict({n: pa.array(out[n], k) for n, k in zip(names, kinds)})


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            texts = part.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(texts)), BANDS))), pa.array(band_hashes(texts).ravel())], names=["clause", "band"])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leader, clause): members of a band in their order; one that resembles no leader so far becomes one."""
    band, leaders = None, []
    for batch in batches:
        out: list[str] = []
        for b, clause in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if b != band:
                band, leaders = b, []
            mine = shingles(clause)
            found = next((text for text, s in leaders if similar(mine, s)), None)
            if found is None:
                leaders.append((clause, mine))
            out.append(found or clause)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1)], names=["leader", "clause"])


def clusters(clauses: DataFrame, seeds: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(clause, cluster): clauses that share a verified link, directly or over others, with a seed's cluster.

    Within a band every clause is compared with the leaders so far, never with
    all others, so links grow with the clauses. A band of very many clauses is
    cut by salt; its leaders, few as they are unlike each other, are compared
    once more. Clusters are the connected parts of the links over all bands.
    Both tables have the column clause, each clause once.
    """
    signed = clauses.mapInArrow(_sign, "clause string, band bigint")
    of_seeds = seeds.mapInArrow(_sign, "clause string, band bigint").select("band").distinct()
    banded = materialize(signed.join(of_seeds, "band", "left_semi"))
    size = banded.groupBy("band").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("clause"), F.ceil(F.col("n") / salt_rows))
    salted = banded.join(size.where("n > 1"), "band").select("band", "clause", salt.alias("salt"))

    def led(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition("band", "salt").sortWithinPartitions("band", "salt", "clause")
        return ordered.select(F.xxhash64("band", "salt"), "clause").mapInArrow(_follow, "leader string, clause string")

    links = materialize(led(salted).select("leader", "clause").distinct())
    cut = salted.where("salt > 0").select("band").distinct()
    again = salted.join(cut, "band", "left_semi").join(links.where("leader = clause").select("clause"), "clause", "left_semi").withColumn("salt", F.lit(0).cast("bigint"))
    if not cut.isEmpty():
        links = materialize(links.unionByName(led(again.select("band", "clause", "salt")).select("leader", "clause")).distinct())
    edges = links.where("leader <> clause")
    both = materialize(edges.select(F.col("leader").alias("a"), F.col("clause").alias("b")).unionByName(edges.select(F.col("clause").alias("a"), F.col("leader").alias("b"))).distinct())
    # The smallest clause of a connected part is its name; each round also takes what the named one has been given.
    names = materialize(links.select(F.col("clause").alias("a")).distinct().withColumn("name", F.col("a")))
    while True:
        near = both.join(names.select(F.col("a").alias("b"), "name"), "b").groupBy("a").agg(F.min("name").alias("near"))
        moved = names.join(near, "a", "left").select("a", F.col("name").alias("was"), F.least("name", F.coalesce("near", "name")).alias("name"))
        hop = names.select(F.col("a").alias("name"), F.col("name").alias("further"))
        fresh = materialize(moved.join(hop, "name", "left").select("a", "was", F.least("name", F.coalesce("further", "name")).alias("name")))
        done = fresh.where("name < was").isEmpty()
        names = fresh.select("a", "name")
        if done:
            break
    alone = seeds.join(names.select(F.col("a").alias("clause")), "clause", "left_anti").select("clause", F.col("clause").alias("cluster"))
    return names.select(F.col("a").alias("clause"), F.col("name").alias("cluster")).unionByName(alone)


def refusal_templates(parsed: DataFrame) -> DataFrame:
    """(clause) of refusal templates.

    Openings said where no answer came are the seeds; the clusters that hold one
    are counted over all records. A cluster is a template if it recurs over
    prompts that have little in common and enough of its responses are without
    answer: with v values of the prompts' MinHash, prompts of similarity s agree
    in about v * s of them.
    """
    said = parsed.select("prompt", "bare", F.explode("openings").alias("clause"))
    slots = [f(F.col("prompt")[i]).alias(f"{f.__name__}{i}") for i in range(SLOTS) for f in (F.min, F.max)]
    counted = materialize(said.groupBy("clause").agg(F.count("*").alias("n"), F.count_if("bare").alias("n_bare"), *slots))
    grouped = materialize(clusters(counted.select("clause"), counted.where("n_bare > 0").select("clause")))
    merged = [f(f"{f.__name__}{i}").alias(f"{f.__name__}{i}") for i in range(SLOTS) for f in (F.min, F.max)]
    differing = reduce(lambda a, b: a + b, [(F.col(f"min{i}") != F.col(f"max{i}")).cast("int") for i in range(SLOTS)])
    found = (
        grouped.join(counted, "clause")
        .groupBy("cluster")
        .agg(F.sum("n").alias("n"), F.sum("n_bare").alias("n_bare"), *merged)
        .where((F.col("n_bare") >= ANSWERLESS_SHARE * F.col("n")) & (F.col("n_bare") > 0) & (differing >= UNRELATED))
    )
    return grouped.join(found.select("cluster"), "cluster", "left_semi").select("clause").distinct()


def find_defects(df: DataFrame, key: str) -> DataFrame:
    """(key, defect) of the defective records; the latest of the rows of a key counts.

    Needs the columns target_lang, instructions, input_map, raw_text, status,
    incomplete_reason and created_at; others are ignored. A null input_map asks
    for nothing, a null raw_text is an empty answer; entries whose language
    can't be told say nothing about it. A reply without any entry whose openings
    no answered record has counts as a refusal even if it occurs once.
    """
    micros = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0))
    rows = df.select(F.col(key).cast("bigint"), micros, "target_lang", "instructions", F.map_keys("input_map"), F.map_values("input_map"), "raw_text", "status", "incomplete_reason")
    parsed = rows.mapInArrow(_parse, _PARSED)
    latest = parsed.groupBy("id").agg(F.max_by(F.struct(*[c for c in parsed.columns if c != "id"]), "at").alias("r"))
    parsed = materialize(latest.select("id", "r.*"))
    templates = refusal_templates(parsed)
    refused = parsed.select("id", F.explode("openings").alias("clause")).join(templates, "clause", "left_semi").select("id").distinct().withColumn("said_no", F.lit(True))
    labelled = parsed.where(F.col("target").isNotNull() & (F.size("answers") > 0) & ~F.col("copied") & ~F.col("declined"))
    sample = labelled.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).select("target", "answers").collect()  # bounded by SAMPLE_ROWS
    languages = df.sparkSession.sparkContext.broadcast(Languages([(t, r.target) for r in sample for t in r.answers]))

    def other_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = languages.value.other
        for batch in batches:
            wrong = []
            for target, answers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                told = [c for c in (other(a, target) for a in answers or []) if c is not None] if target else []
                wrong.append(2 * sum(told) > len(told))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wrong, pa.bool_())], names=["id", "wrong"])

    wrong = parsed.where("NOT (declined OR empty OR truncated OR copied)").select("id", "target", "answers").mapInArrow(other_language, "id bigint, wrong boolean").where("wrong")
    free = F.col("bare") & (F.size("openings") > 0)
    defect = (
        F.when(F.col("declined") | F.col("said_no"), DEFECTS[0])
        .when(F.col("empty"), F.when(free & ~F.col("only_common"), DEFECTS[0]).otherwise(DEFECTS[1]))
        .when(F.col("truncated"), DEFECTS[2])
        .when(F.col("copied"), DEFECTS[3])
        .when(F.col("wrong"), DEFECTS[4])
    )
    answered = parsed.where("NOT bare").select(F.explode("openings").alias("clause")).distinct()
    uncommon = parsed.where(free).select("id", F.explode("openings").alias("clause")).join(answered, "clause", "left_anti").select("id").distinct().withColumn("only_common", F.lit(False))
    return (
        parsed.join(refused, "id", "left")
        .join(wrong, "id", "left")
        .join(uncommon, "id", "left")
        .withColumns({"said_no": F.coalesce("said_no", F.lit(False)), "wrong": F.coalesce("wrong", F.lit(False)), "only_common": F.coalesce("only_common", F.lit(True))})
        .select(F.col("id").alias(key), defect.alias("defect"))
        .where("defect IS NOT NULL")
    )

