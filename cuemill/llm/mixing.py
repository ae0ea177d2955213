"""Mixing sources to target shares of the tokens, with capped repeats.

A naive Bayes classifier, fitted on the counts of all labelled documents and
applied to each with its own counts taken off, gives every document a posterior
over the sources (its soft membership). Documents of one source with about the
same membership form a group, however many sources there are; the groups' tokens
and expected tokens by source are summed over all documents. Sums are of whole
or binary fractions, so they don't depend on how the rows lie in partitions.
Projected gradient steps on those sums fit rates
between 0 and the source's cap: the least squares distance of the expected
token totals from their targets falls, while the projection holds the totals by
source label, which the targets are about, exactly on theirs. The rates are
rounded to whole repeats by systematic sampling in the order of size, which
keeps the totals within a document or so. That order is cut into parts only for
the work: they follow each other in it, so their number changes no repeat.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cuemill.llm.measures import document_words
from cuemill.llm.quality import _chunks
from cuemill.llm.tokens import TOKENIZER, encoder
from cuemill.session import materialize

FEATURES = 1 << 13  # word features
CHUNK_CELLS = 1 << 20  # numbers that are worked on, or held back in sums, at once
SMOOTHING = 0.2
EVIDENCE = 12.0  # words' worth of likelihood a document may show, however long it is
LEVELS = 8  # steps of certainty that groups tell apart
UNIT = 1 / (1 << 20)  # expected tokens are summed in these: exact to 2^33 tokens of a group and source, whatever the order
WHOLE = 1 << 30  # rests of rates are summed in parts of this many to a repeat, exactly
STEPS, ENOUGH = 500, 1e-8  # most steps, and the relative gain of a step that ends them
GROUP_ROWS = 100_000


class Mix(NamedTuple):
    documents: DataFrame  # key, source, tokens, rate, repeats
    shares: DataFrame  # source, target_share, fitted_share, actual_share, expected_share, documents, repeats, tokens, max_repeats, steps, distance


class Fit(NamedTuple):
    rates: np.ndarray
    expected: np.ndarray  # token totals by membership
    steps: int
    distance: float  # of the expected shares from their targets, root of the summed squares


class Classifier:
    """Naive Bayes over word features; holds the cells of its table that aren't 0, which are at most as many as the words read."""

    def __init__(self, counts: np.ndarray) -> None:  # [source, feature]
        source, feature = np.nonzero(counts)
        self._fill(source, feature, counts[source, feature], *counts.shape)

    @classmethod
    def of_cells(cls, source: np.ndarray, feature: np.ndarray, count: np.ndarray, n: int, features: int) -> Classifier:
        made = cls.__new__(cls)
        made._fill(source, feature, count, n, features)
        return made

    def _fill(self, source: np.ndarray, feature: np.ndarray, count: np.ndarray, n: int, features: int) -> None:
        order = np.lexsort((source, feature))
        self.n, self.features = n, features
        self.first = np.concatenate([[0], np.cumsum(np.bincount(feature, minlength=features))])  # of a feature's cells
        self.source, count = source[order].astype(np.int32), count[order].astype(float)
        self.more = np.log(count + SMOOTHING) - math.log(SMOOTHING)  # what a word adds to a source that has it
        self.less = np.log(np.maximum(count + SMOOTHING - 1, SMOOTHING)) - np.log(count + SMOOTHING)  # without the document's own word
        self.size = np.bincount(self.source, count, n)
        self.log_size = np.log(self.size + SMOOTHING * features)
        self.log_prior = np.log((self.size + 1) / (self.size.sum() + max(n, 1)))

    def memberships(self, source: np.ndarray, lengths: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Posterior [document, source]; every document's own words are taken off the counts of its source."""
        doc = np.repeat(np.arange(len(source)), lengths)
        log = np.zeros(len(source) * self.n)
        upto = np.cumsum(self.first[features + 1] - self.first[features])
        cuts = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, CHUNK_CELLS), side="right")
        for at, end in zip(cuts, [*cuts[1:], len(features)]):
            start = self.first[features[at:end]]
            have = self.first[features[at:end] + 1] - start
            cell = np.repeat(start - np.cumsum(have) + have, have) + np.arange(have.sum())
            row, column = np.repeat(doc[at:end], have), self.source[cell]
            log += np.bincount(row * self.n + column, self.more[cell] + np.where(column == source[row], self.less[cell], 0), len(log))
        log = log.reshape(len(source), self.n) + lengths[:, None] * (math.log(SMOOTHING) - self.log_size[None, :])
        rows = np.arange(len(source))
        log[rows, source] += lengths * (self.log_size[source] - np.log(np.maximum(self.size[source] - lengths, 0) + SMOOTHING * self.features))
        log = self.log_prior + log * (np.minimum(lengths, EVIDENCE) / np.maximum(lengths, 1))[:, None]
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit_rates(tokens: np.ndarray, source: np.ndarray, expected: np.ndarray, goal: np.ndarray, caps: np.ndarray) -> Fit:
    """Rates of groups with these tokens, sources and expected tokens by source [group, source].

    Steps go down the squared distance of the expected totals from ``goal``;
    every step is projected on the rates within 0 and the cap under which each
    source's own total is its goal.
    """
    rates = np.zeros(len(tokens))
    total = max(goal.sum(), 1e-12)
    use = tokens > 0
    if not use.any() or not goal.any():
        return Fit(rates, np.zeros(len(goal)), 0, 0.0)
    expected = expected if use.all() else expected[use]  # may be a file's; not copied then
    rate_cap, at, weight = caps[source[use]], source[use], tokens[use]

    def project(r: np.ndarray) -> np.ndarray:
        widest = caps.max() + np.abs(r).max()
        low, high = np.full(len(goal), -widest), np.full(len(goal), widest)
        for _ in range(60):
            shift = (low + high) / 2
            over = np.bincount(at, weight * np.clip(r - shift[at], 0, rate_cap), len(goal)) > goal
            low, high = np.where(over, shift, low), np.where(over, high, shift)
        return np.clip(r - high[at], 0, rate_cap)

    square = np.zeros((len(goal), len(goal)))
    step = max(1, CHUNK_CELLS // len(goal))
    for i in range(0, len(weight), step):
        part = expected[i : i + step] / np.sqrt(weight[i : i + step, None])
        square += part.T @ part
    stride = 1 / max(np.linalg.eigvalsh(square)[-1], 1e-12)
    r = project(goal[at] / np.maximum(np.bincount(at, weight, len(goal))[at], 1e-12))
    off = r @ expected - goal
    best, ahead, pace = off @ off, r, 1.0
    for steps in range(1, STEPS + 1):  # with momentum, dropped where a step doesn't gain
        gradient = expected @ (ahead @ expected - goal) / weight
        fresh = project(ahead - stride * gradient)
        off = fresh @ expected - goal
        gain, now = best - off @ off, off @ off
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = fresh + (pace - 1) / faster * (fresh - r) if gain > 0 else fresh
        pace = faster if gain > 0 else 1.0
        r, best = fresh, now
        if abs(gain) <= ENOUGH * max(now, 1e-12 * total * total):
            break
    rates[use] = r
    return Fit(rates, off + goal, steps, float(np.linalg.norm(off) / total))


def _settle(chosen: DataFrame, key: str, goals: DataFrame) -> DataFrame:
    """Takes the rest a source is off its goal from one document of about that size; goals: source, goal, cap."""
    used = chosen.groupBy("source").agg(F.sum(F.col("repeats") * F.col("tokens")).alias("used"))
    off = goals.join(used, "source", "left").select("source", "cap", (F.col("goal") - F.coalesce("used", F.lit(0))).alias("off"))
    near = chosen.join(off, "source").withColumn("fit", F.abs(F.col("tokens") - F.abs("off")))
    usable = F.when(F.col("off") > 0, F.col("repeats") < F.col("cap")).otherwise(F.col("repeats") > 0) & (F.col("fit") < F.abs("off"))
    best = near.where(usable).groupBy("source").agg(F.min_by(F.struct(F.col(key).alias("k"), F.col("tokens").alias("t"), F.col("row").alias("r"), F.signum("off").cast("int").alias("by")), F.struct("fit", F.col(key), "rate", "repeats", "row")).alias("p"))
    moves = best.select("source", F.col("p.k").alias(key), F.col("p.t").alias("tokens"), F.col("p.r").alias("row"), F.col("p.by").alias("by"))
    joined = chosen.join(moves.select("row", "by"), "row", "left")
    return joined.withColumn("repeats", F.col("repeats") + F.coalesce("by", F.lit(0))).drop("by", "row")


def mix(df: DataFrame, targets: DataFrame, key: str, text: str, source: str, tokenizer: str = TOKENIZER) -> Mix:
    """Documents with their repeats, and the shares reached.

    ``targets`` has source, target_share and max_repeats; it is read by the
    driver. Documents of other sources or of none are not used, nor are empty
    ones. Shares of sources without documents, and null or zero shares, fall
    away and the others are scaled up; the total is the largest at which every
    share can be met. A null max_repeats is 1. A repeated row is a document of
    its own.
    """
    spark = df.sparkSession
    wanted = targets.select(F.col("source").cast("string"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("source IS NOT NULL").collect()
    names = sorted({r.source for r in wanted})
    n = len(names)
    index = {s: i for i, s in enumerate(names)}
    share, caps = np.zeros(n), np.zeros(n)
    for r in wanted:
        share[index[r.source]] += r.target_share or 0
        caps[index[r.source]] = max(caps[index[r.source]], 1 if r.max_repeats is None else r.max_repeats)
    known = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "source string, src int")
    docs = df.select(key, F.col(source).cast("string").alias("source"), F.col(text).alias("text")).join(known, "source").select(key, "src", "text")
    schema = T.StructType([df.schema[key], T.StructField("src", T.IntegerType()), T.StructField("tokens", T.LongType()), T.StructField("words", T.ArrayType(T.IntegerType()))])

    def read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            texts = batch.column(2).dictionary_encode()
            sizes = [len(encode(t)) for t in texts.dictionary.to_pylist()]
            for at, part in _chunks(batch.column(2).to_pylist()):
                word, doc = document_words(part)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(part)))]).astype(np.int32)
                hashed = pa.array((word.view(np.uint64) % np.uint64(FEATURES)).astype(np.int32))
                tokens = [0 if i is None else sizes[i] for i in texts.indices.slice(at, len(part)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(part)) for i in (0, 1)), pa.array(tokens, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), hashed)], names=schema.names
                )

    measured = materialize(docs.mapInArrow(read_texts, schema).where("tokens > 0"))

    def arrays(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        src, tokens = (batch.column(at + i).to_numpy(zero_copy_only=False) for i in (0, 1))
        lists = batch.column(at + 2)
        return src.astype(np.int64), tokens, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, tokens, lengths, words = arrays(batch, 0)
            code, found = np.unique(np.repeat(src, lengths) * FEATURES + words, return_counts=True)
            use, have, rows = n * FEATURES, np.bincount(src, tokens, n), np.bincount(src, minlength=n)
            some = np.flatnonzero(rows)
            yield pa.RecordBatch.from_pydict({"code": np.concatenate([code, use + some, use + n + some]), "n": np.concatenate([found, have[some], rows[some]]).astype(float)})

    sums = measured.select("src", "tokens", "words").mapInArrow(count_words, "code bigint, n double").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, found = sums["code"].to_numpy(), sums["n"].to_numpy()
    cells, last = code < n * FEATURES, np.zeros(2 * n)
    last[code[~cells] - n * FEATURES] = found[~cells]
    have, rows = last[:n], int(last[n:].sum())
    model = spark.sparkContext.broadcast(Classifier.of_cells(code[cells] // FEATURES, code[cells] % FEATURES, found[cells], n, FEATURES))
    live = (have > 0) & (share > 0) & (caps > 0)
    fitted = np.where(live, share, 0) / max(share[live].sum(), 1e-12)
    total = min((have[i] * caps[i] / fitted[i] for i in range(n) if live[i]), default=0.0)
    goal, caps = fitted * total, np.where(live, caps, 0)
    numbers = n + 1  # of a group: its tokens by membership, then all of them
    key_field, group_fields = T.StructField(key, df.schema[key].dataType), [T.StructField("grp", T.LongType()), T.StructField("sums", T.BinaryType())]
    placed_schema = T.StructType([key_field, T.StructField("src", T.IntegerType()), T.StructField("tokens", T.LongType()), *group_fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with their group; among them, without a document, sums of the groups."""
        sums: dict[int, np.ndarray] = {}

        def flush(like: pa.DataType) -> pa.RecordBatch:
            size = len(sums)
            columns = [pa.nulls(size, like), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()), pa.array(list(sums), pa.int64()), pa.array([f.tobytes() for f in sums.values()], pa.binary())]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, names=placed_schema.names)

        like = pa.null()
        for batch in batches:
            src, tokens, lengths, words = arrays(batch, 1)
            like, ends, group = batch.column(0).type, np.concatenate([[0], np.cumsum(lengths)]), np.zeros(len(src), np.int64)
            step = max(1, CHUNK_CELLS // numbers)
            for i in range(0, len(src), step):
                j = min(i + step, len(src))
                p = model.value.memberships(src[i:j], lengths[i:j], words[ends[i] : ends[j]])
                top = p.argmax(1)
                level = np.minimum((p[np.arange(j - i), top] * LEVELS).astype(np.int64), LEVELS - 1)
                group[i:j] = (src[i:j] * n + top) * LEVELS + level
                order = np.argsort(group[i:j], kind="stable")
                codes, at = np.unique(group[i:j][order], return_index=True)
                found = np.concatenate([np.round(p * (tokens[i:j, None] / UNIT)) * UNIT, tokens[i:j, None]], axis=1)
                for g, f in zip(codes.tolist(), np.add.reduceat(found[order], at)):
                    sums[g] = sums[g] + f if g in sums else f.copy()
                if len(sums) * numbers > CHUNK_CELLS:
                    yield flush(like)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(group), pa.nulls(len(src), pa.binary())], names=placed_schema.names)
        if sums:
            yield flush(like)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[g] = sums[g] + np.frombuffer(f) if g in sums else np.frombuffer(f)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([f.tobytes() for f in sums.values()], pa.binary())], names=["grp", "sums"])

    placed = materialize(measured.mapInArrow(place, placed_schema))
    grouped = placed.where("sums IS NOT NULL").select("grp", "sums").repartition("grp").mapInArrow(add_up, T.StructType(group_fields)).orderBy("grp")
    codes, group_tokens = [], []
    with tempfile.TemporaryFile() as file:  # as many groups as sources, likeliest sources and levels occur together: they aren't held in memory
        for r in grouped.toLocalIterator():
            codes.append(r.grp)
            group_tokens.append(np.frombuffer(r.sums)[n])
            file.write(r.sums[:-8])
        file.flush()
        codes = np.array(codes, np.int64)
        expected = np.asarray(np.memmap(file, float, "r", shape=(len(codes), n))) if len(codes) else np.zeros((0, n))
        fit = fit_rates(np.array(group_tokens, float), codes // max(n * LEVELS, 1), expected, goal, caps)
    group_rates = spark.sparkContext.broadcast((codes, fit.rates))  # one number a group
    out_schema = T.StructType([key_field, T.StructField("src", T.IntegerType()), T.StructField("tokens", T.LongType()), T.StructField("rate", T.DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, rates = group_rates.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rates[np.searchsorted(codes, batch.column(3).to_numpy())])], names=out_schema.names)

    goals = spark.createDataFrame([(s, i, float(share[i]), float(fitted[i]), float(goal[i]), int(caps[i])) for i, s in enumerate(names)], "source string, src int, target_share double, fitted_share double, goal double, cap int")
    groups = max(1, math.ceil(rows / GROUP_ROWS))
    order = F.xxhash64(key, "tokens")
    docs = placed.where("sums IS NULL").select(key, "src", "tokens", "grp")
    parts = docs.mapInArrow(rate, out_schema).select(  # a part is a range of the order, so their number doesn't change it
        "*", (F.floor(F.log2("tokens") * 8)).cast("int").alias("octave"), F.floor((order / F.lit(2.0**64) + 0.5) * groups).cast("int").alias("part"),
        F.round((F.col("rate") - F.floor("rate")) * WHOLE).cast("bigint").alias("rest"),
    )
    by_part = ["src", "octave", "part"]
    sizes = parts.groupBy(by_part).agg(F.sum("rest").alias("rest_sum"))
    before = Window.partitionBy("src").orderBy("octave", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by_part, F.coalesce(F.sum("rest_sum").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(by_part).orderBy(order, key, "rate").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.col("offset") + F.sum("rest").over(within) + WHOLE // 2
    extra = F.shiftright(run, 30) - F.shiftright(run - F.col("rest"), 30)
    chosen = materialize(
        parts.join(offsets, by_part)
        .withColumn("whole", F.floor("rate") + extra)
        .join(goals.select("src", "source", "cap"), "src")
        .select(key, "source", "tokens", "rate", F.least("whole", F.col("cap").cast("bigint")).cast("int").alias("repeats"), F.monotonically_increasing_id().alias("row"))
    )
    chosen = _settle(chosen, key, goals.select("source", "goal", "cap"))
    got = chosen.groupBy("source").agg(F.count_if(F.col("repeats") > 0).alias("documents"), F.sum("repeats").alias("repeats"), F.sum(F.col("repeats") * F.col("tokens")).alias("tokens"))
    reached = spark.createDataFrame([(s, float(fit.expected[i] / max(fit.expected.sum(), 1e-12))) for i, s in enumerate(names)], "source string, expected_share double")
    joined = goals.join(reached, "source").join(got, "source", "left").na.fill(0, ["documents", "repeats", "tokens"])
    used = joined.agg(F.sum("tokens").alias("all"))
    shares = joined.join(used).select(  # a single row
        "source", "target_share", "fitted_share", F.try_divide(F.col("tokens"), F.col("all")).alias("actual_share"), "expected_share", "documents", "repeats", "tokens", F.col("cap").alias("max_repeats"),
        F.lit(fit.steps).alias("steps"), F.lit(fit.distance).alias("distance"),
    )
    return Mix(chosen.where("repeats > 0"), shares)
