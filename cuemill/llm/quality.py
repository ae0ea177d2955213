"""Text statistics per document and the kind of text they point to.

Statistics of each block (blank lines part blocks) are compared with
thresholds; every comparison is a noisy labelling function that votes for one
kind or abstains. How often each function fires for its own kind and for the
others, and so how much its vote and its silence weigh, is learned by
expectation-maximization from the agreements in all blocks, without labels. A
document's kind is the one whose blocks, weighted by their posterior, hold the
most characters.

Agreements are counted per pattern of votes; the number of patterns does not
grow with the documents but with the functions (at most 2 ** len(FUNCTIONS)).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.llm.measures import document_words, measure
from cuemill.session import materialize

KINDS = ("prose", "list", "table", "junk")
COMMON_WORDS = 5000
MIN_DOCUMENTS = 3
MIN_SHARE = 0.003
CHUNK = 2_000_000  # characters laid out at once

Blocks = dict[str, np.ndarray]
_flat: Callable[[Blocks], np.ndarray] = lambda b: (b["fields"] < 3) & (np.maximum(np.maximum(b["pipes"], b["tabs"]), b["aligned"]) < 0.5)
_varied: Callable[[Blocks], np.ndarray] = lambda b: np.minimum(b["distinct_grams"], b["distinct_grams_of_document"]) >= 0.25
_readable: Callable[[Blocks], np.ndarray] = lambda b: (b["common_words"] >= 0.5) & (b["letters_in_words"] > 0.3) & ((b["units_per_item"] >= 2.6) | (b["items"] < 4)) & _varied(b)
_clean: Callable[[Blocks], np.ndarray] = lambda b: (b["broken"] < 0.2) & (b["mojibake"] < 0.2) & (b["symbol_ratio"] < 0.9)

# (name, kind it votes for, where it fires)
FUNCTIONS: tuple[tuple[str, str, Callable[[Blocks], np.ndarray]], ...] = (
    ("long_lines", "prose", lambda b: _readable(b) & (b["units_per_line"] >= 6.5) & (b["pairs"] < 0.6)),
    ("long_sentences", "prose", lambda b: _readable(b) & (b["units_per_sentence"] >= 5) & (b["fields"] < 3) & (b["pairs"] < 0.6)),
    ("full_stops", "prose", lambda b: _varied(b) & (b["end_punctuation"] >= 0.6) & (b["units_per_line"] >= 3.4) & (b["common_words"] > 0.4) & (b["pairs"] < 0.6) & _flat(b)),
    ("fluent", "prose", lambda b: _varied(b) & (b["common_words"] >= 0.7) & (b["symbol_ratio"] < 0.12) & (b["units_per_line"] >= 5.6) & (b["digit_ratio"] < 0.1) & (b["pairs"] < 0.6)),
    ("a_long_line", "prose", lambda b: _readable(b) & (b["longest_line"] >= 8.5) & (b["fields"] < 3) & (b["pairs"] < 0.6)),
    ("long_clauses", "prose", lambda b: _readable(b) & (b["units_per_item"] >= 3.2) & (b["fields"] < 3)),
    ("bullets", "list", lambda b: (b["bullets"] >= 0.6) & (b["units_per_line"] < 5.6) & (b["end_punctuation"] < 0.6)),
    ("short_items", "list", lambda b: (b["n_lines"] >= 2) & (b["units_per_line"] < 5.2) & (b["longest_line"] < 8) & ((b["end_punctuation"] < 0.6) | (b["units_per_line"] < 3)) & _flat(b) & (b["common_words"] > 0.3)),
    ("pairs", "list", lambda b: (b["n_lines"] >= 2) & (b["pairs"] >= 0.7) & (b["units_per_line"] < 7.5) & _flat(b)),
    ("bulleted_pairs", "list", lambda b: (b["bullets"] >= 0.6) & (b["pairs"] >= 0.6)),
    ("tiny_items", "list", lambda b: (b["n_lines"] >= 2) & (b["units_per_line"] < 3.4) & _flat(b) & (b["letters_in_words"] > 0.35)),
    ("inline_items", "list", lambda b: b["inline_bullets"] >= 2),
    ("short_clauses", "list", lambda b: (b["items"] >= 4) & (b["units_per_item"] < 2.9) & (b["units_per_item"] >= 0.6) & (b["end_punctuation"] < 0.6) & (b["fields"] < 3) & (b["common_words"] > 0.3)),
    ("pipes", "table", lambda b: (b["n_lines"] >= 2) & (b["pipes"] >= 0.7) & (b["symbol_ratio"] < 0.9)),
    ("tabs", "table", lambda b: (b["n_lines"] >= 2) & (b["tabs"] >= 0.7) & _clean(b)),
    ("aligned", "table", lambda b: (b["n_lines"] >= 2) & (b["aligned"] >= 0.6) & _clean(b)),
    ("records", "table", lambda b: (b["fields"] >= 3) & (b["regular_fields"] >= 0.7) & (b["n_lines"] >= 2) & _clean(b)),
    ("wide_records", "table", lambda b: (b["fields"] >= 4) & (b["regular_fields"] >= 0.6) & (b["n_lines"] >= 2) & _clean(b)),
    ("unknown_words", "junk", lambda b: (b["common_words"] < 0.35) & (b["fields"] < 3)),
    ("few_words", "junk", lambda b: (b["letters_in_words"] < 0.3) & (b["fields"] < 3) & (b["bullets"] < 0.5)),
    ("symbols", "junk", lambda b: (b["symbol_ratio"] > 0.4) & (b["pipes"] < 0.5) & (b["bullets"] < 0.5) & (b["fields"] < 3)),
    ("broken", "junk", lambda b: (b["broken"] > 0.15) & (b["letters_in_words"] < 0.5)),
    ("mojibake", "junk", lambda b: b["mojibake"] > 0.2),
    ("markup", "junk", lambda b: b["markup"] > 0.5),
    ("tags", "junk", lambda b: b["tagged"] > 0.5),
    ("codes", "junk", lambda b: (b["hex"] > 0.5) | (b["blob"] > 0.5)),
    ("repeats", "junk", lambda b: ~_varied(b) & (b["fields"] < 3)),
)
_VOTES = np.array([KINDS.index(kind) for _, kind, _ in FUNCTIONS])


class Learned(NamedTuple):
    posterior: np.ndarray  # [pattern, kind]
    fires: np.ndarray  # [function, 2]: how often for its own kind, how often for the others
    share: np.ndarray  # [kind]: of all blocks
    damping: np.ndarray  # [kind]: weight of a vote among the functions of that kind


def learn(patterns: np.ndarray, counts: np.ndarray, votes: np.ndarray = _VOTES, n_kinds: int = len(KINDS), rounds: int = 100) -> Learned:
    """EM over vote patterns.

    A function has one rate for its own kind and one for all others; both are
    learned, with the weight of one block each way as prior, which fades as
    blocks are added. A vote weighs by their ratio, silence by nothing.
    Functions of one kind measure related things: how much their votes agree
    beyond what the kinds explain is learned too, and damps them as m votes with
    correlation r count as m / (1 + (m - 1) r). It starts from the votes
    themselves.
    """
    m = len(votes)
    if not len(patterns):
        return Learned(np.zeros((0, n_kinds)), np.full((m, 2), 0.5), np.full(n_kinds, 1 / n_kinds), np.ones(n_kinds))
    fired = ((patterns[:, None] >> np.arange(m)) & 1).astype(float)
    own = np.eye(n_kinds)[votes]
    weight = counts.astype(float)
    tally = fired @ own / np.maximum(own.sum(0), 1) + 1e-3
    posterior = tally / tally.sum(1, keepdims=True)
    damping = 1 / np.maximum(own.sum(0), 1)
    for _ in range(rounds):
        mass = posterior * weight[:, None]
        total = mass.sum(0)
        share = (total + 1) / (total.sum() + n_kinds)
        hits = fired.T @ mass  # [function, kind]
        mine = hits[np.arange(m), votes]
        rate_own = (mine + 0.5) / (total[votes] + 1)
        rate_other = (hits.sum(1) - mine + 0.5) / (total.sum() - total[votes] + 1)
        # Agreement beyond the kinds: correlation of what is left when the expected votes are taken off.
        left = fired - (posterior[:, votes] * rate_own + (1 - posterior[:, votes]) * rate_other)
        spread = (left * weight[:, None]).T @ left
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
        correlation = np.clip(spread / scale[:, None] / scale[None, :], 0, 1)
        for k in range(n_kinds):
            of = np.flatnonzero(votes == k)
            if len(of) > 1:
                r = (correlation[np.ix_(of, of)].sum() - len(of)) / (len(of) * (len(of) - 1))
                damping[k] = 1 / (1 + (len(of) - 1) * r)
        says = np.log(rate_own / rate_other) * fired
        log = np.log(share) + says @ own * damping
        log -= log.max(1, keepdims=True)
        fresh = np.exp(log)
        fresh /= fresh.sum(1, keepdims=True)
        done = (np.abs(fresh - posterior).max(1) * weight).sum() < 1e-9 * weight.sum()
        posterior = fresh
        if done:
            break
    return Learned(posterior, np.stack([rate_own, rate_other], 1), share, damping)


def patterns_of(blocks: Blocks) -> np.ndarray:
    out = np.zeros(len(blocks["doc"]), np.int64)
    for i, (_, _, fires) in enumerate(FUNCTIONS):
        out |= fires(blocks).astype(np.int64) << i
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of together about CHUNK characters, and the number of the first."""
    at, part, size = 0, [], 0
    for i, text in enumerate(texts):
        part.append(text or "")
        size += len(part[-1])
        if size >= CHUNK:
            yield at, part
            at, part, size = i + 1, [], 0
    if part:
        yield at, part


def common_words(df: DataFrame, text: str, top: int = COMMON_WORDS, least: int = MIN_DOCUMENTS, share: float = MIN_SHARE) -> np.ndarray:
    """Sorted hashes of the ``top`` words by number of documents, over all documents; at most ``top`` rows reach the driver.

    A word must be in ``share`` of the documents that aren't blank, so that
    rare noise doesn't become common as documents are added, in ``least`` of
    them however few there are, and in two different texts, so that copies of
    one text don't make its words common.
    """
    least = max(least, math.ceil(share * df.where(F.col(text).rlike(r"\S")).count()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(1).to_numpy(zero_copy_only=False)
            for at, part in _chunks(batch.column(0).to_pylist()):
                word, doc = document_words(part)
                of = hashes[at : at + len(part)][doc]
                order = np.lexsort((of, word))
                word, of = word[order], of[order]
                head = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, int)
                n = np.diff(np.append(head, len(word)))
                low, high = (of[head], of[head + n - 1]) if len(word) else (of, of)
                yield pa.RecordBatch.from_pydict({"word": word[head], "n": n, "low": low, "high": high})

    counted = (
        df.select(F.col(text), F.xxhash64(text))
        .mapInArrow(each, "word bigint, n bigint, low bigint, high bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where((F.col("n") >= least) & (F.col("low") != F.col("high")))
    )
    return np.sort(np.array([r.word for r in counted.orderBy(F.desc("n"), "word").limit(top).select("word").collect()], np.int64))


_STATS = ("n_words", "n_lines", "mean_word_length", "symbol_ratio", "end_punctuation", "common_words")


def _measured(df: DataFrame, key: str, text: str, top: int) -> tuple[DataFrame, T.StructType]:
    """(key, n_chars, statistics, blocks with characters and pattern), written once."""
    vocabulary = df.sparkSession.sparkContext.broadcast(common_words(df, text, top))  # at most ``top`` numbers
    schema = T.StructType(
        [df.schema[key], T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in _STATS),
         T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("chars", T.LongType()), T.StructField("pattern", T.LongType())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in _chunks(batch.column(1).to_pylist()):
                docs, blocks = measure(part, vocabulary.value)
                struct = pa.StructArray.from_arrays([pa.array(blocks["chars"].astype(np.int64)), pa.array(patterns_of(blocks))], names=["chars", "pattern"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(blocks["doc"], minlength=len(part)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array([len(t) for t in part], pa.int64()), *(pa.array(docs[n].astype(float)) for n in _STATS), pa.ListArray.from_arrays(pa.array(offsets), struct)],
                    names=schema.names,
                )

    return materialize(df.select(key, text).mapInArrow(run, schema)), schema


def _learned(docs: DataFrame) -> tuple[np.ndarray, Learned]:
    counts = docs.select(F.explode("blocks").alias("b")).groupBy("b.pattern").count().collect()  # patterns, not documents
    patterns = np.array([r[0] for r in counts], np.int64)
    return patterns, learn(patterns, np.array([r[1] for r in counts], np.int64))


def text_kinds(df: DataFrame, key: str, text: str, top: int = COMMON_WORDS) -> DataFrame:
    """(key, n_chars, statistics, kind, share per kind): one row per row of the table.

    Null and blank texts have kind null and zero statistics. Shares are the
    posterior-weighted part of a document's characters that is of each kind;
    the largest decides, ties in the order of KINDS.
    """
    docs, schema = _measured(df, key, text, top)
    patterns, learned = _learned(docs)
    order = np.argsort(patterns)
    table = df.sparkSession.sparkContext.broadcast((patterns[order], learned.posterior[order]))
    out = T.StructType([*(f for f in schema.fields if f.name != "blocks"), T.StructField("kind", T.StringType()), *(T.StructField(k, T.DoubleType()) for k in KINDS)])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, posterior = table.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            doc = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
            blocks = column.flatten()
            chars = blocks.field("chars").to_numpy(zero_copy_only=False).astype(float)
            at = np.searchsorted(known, blocks.field("pattern").to_numpy(zero_copy_only=False))
            total = np.zeros((batch.num_rows, len(KINDS)))
            np.add.at(total, doc, chars[:, None] * posterior[at] if len(at) else np.zeros((0, len(KINDS))))
            whole = total.sum(1)
            share = total / np.where(whole > 0, whole, 1)[:, None]
            kind = pa.DictionaryArray.from_arrays(pa.array(share.argmax(1), mask=whole == 0), pa.array(KINDS)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], kind, *(pa.array(share[:, i]) for i in range(len(KINDS)))], names=out.names)

    return docs.mapInArrow(decide, out)


def function_weights(df: DataFrame, key: str, text: str, top: int = COMMON_WORDS) -> DataFrame:
    """(name, kind, fires_own, fires_other, log_odds, changed): what was learned about each labelling function.

    ``log_odds`` is the weight of its vote. ``changed`` counts the blocks whose
    kind is another than most votes say, the same in every row.
    """
    docs, _ = _measured(df, key, text, top)
    counts = docs.select(F.explode("blocks").alias("b")).groupBy("b.pattern").count().collect()
    patterns, n = np.array([r[0] for r in counts], np.int64), np.array([r[1] for r in counts], np.int64)
    learned = learn(patterns, n)
    changed = int(n[learned.posterior.argmax(1) != plain_votes(patterns)].sum()) if len(patterns) else 0
    weight = np.log(learned.fires[:, 0] / learned.fires[:, 1]) * learned.damping[_VOTES]
    rows = [(name, kind, float(learned.fires[i, 0]), float(learned.fires[i, 1]), float(weight[i]), changed) for i, (name, kind, _) in enumerate(FUNCTIONS)]
    return df.sparkSession.createDataFrame(rows, "name string, kind string, fires_own double, fires_other double, log_odds double, changed bigint")


def plain_votes(patterns: np.ndarray) -> np.ndarray:
    """The kind with most votes; ties in the order of KINDS."""
    fired = (patterns[:, None] >> np.arange(len(FUNCTIONS))) & 1
    return (fired @ np.eye(len(KINDS))[_VOTES]).argmax(1)
