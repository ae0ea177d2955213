"""Continuous periods and gaps of an entity's intervals.

The aggregate's state is a sorted list of disjoint intervals. States combine by
a linear merge, so partial lists made anywhere can be reduced in a tree:

* a row's interval is cut at the borders of fixed blocks of time, which bounds
  every list by the block's length, however many rows an entity has;
* each map task folds its rows into one list per (entity, block), merging batch
  lists in a binary tree (map-side combine, before any shuffle);
* lists are merged per (entity, block), over one more level of the tree when
  there are many map tasks, so no task receives a list from every map task;
* a block emits its inner periods and its complement at once; only the first
  and last interval of a block are stitched over the entity's blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuemill.session import estimated_bytes

BLOCK_MS = 600_000
FAN_IN = 64
FLUSH = 1_000_000
_SHIFT = 31  # an offset within a block needs fewer bits

Runs = tuple[np.ndarray, np.ndarray]


def coalesce_sorted(start: np.ndarray, end: np.ndarray) -> Runs:
    """Join what overlaps or touches; both arrays carry the key in the high bits."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    head = np.ones(len(start), bool)
    head[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(start)) - 1
    return start[first], reach[last]


def merge_runs(a: Runs, b: Runs) -> Runs:
    """Linear merge of two sorted disjoint lists."""
    at = np.searchsorted(a[0], b[0], side="right") + np.arange(len(b[0]))
    size = len(a[0]) + len(b[0])
    from_a = np.ones(size, bool)
    from_a[at] = False
    start, end = np.empty(size, np.int64), np.empty(size, np.int64)
    start[at], end[at] = b
    start[from_a], end[from_a] = a
    return coalesce_sorted(start, end)


class RunTree:
    """Lists of equal rank merge like the digits of a binary counter."""

    def __init__(self) -> None:
        self.code: dict = {}
        self.ranks: list[Runs | None] = []

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        entity = batch.column(0).dictionary_encode(null_encoding="encode")
        values = entity.dictionary.to_pylist()
        index = entity.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        block = batch.column(1).to_numpy(zero_copy_only=False)
        low = int(block.min())
        span = int(block.max()) - low + 1
        pairs, inverse = np.unique(index * span + (block - low), return_inverse=True)
        codes = np.array(
            [self.code.setdefault((values[p // span], p % span + low), len(self.code)) for p in pairs.tolist()],
            np.int64,
        )
        key = codes[inverse] << _SHIFT
        start = key | batch.column(2).to_numpy(zero_copy_only=False)
        end = key | batch.column(3).to_numpy(zero_copy_only=False)
        order = np.argsort(start, kind="stable")
        self._push(coalesce_sorted(start[order], end[order]))

    def _push(self, runs: Runs) -> None:
        rank = 0
        while rank < len(self.ranks) and self.ranks[rank] is not None:
            runs = merge_runs(self.ranks[rank], runs)
            self.ranks[rank] = None
            rank += 1
        if rank == len(self.ranks):
            self.ranks.append(None)
        self.ranks[rank] = runs

    def size(self) -> int:
        return sum(len(r[0]) for r in self.ranks if r is not None)

    def result(self) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Keys by code, then code, start and end of every interval."""
        total: Runs = (np.empty(0, np.int64), np.empty(0, np.int64))
        for runs in self.ranks:
            if runs is not None:
                total = merge_runs(runs, total)
        mask = (1 << _SHIFT) - 1
        return list(self.code), total[0] >> _SHIFT, total[0] & mask, total[1] & mask


def _batches(keys: list, code: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    blocks = np.array([k[1] for k in keys], np.int64)
    names = pa.array([k[0] for k in keys], pa.string())
    for at in range(0, len(code), 50_000):
        part = slice(at, at + 50_000)
        cols = {"entity": names.take(pa.array(code[part])), "block": pa.array(blocks[code[part]])}
        cols |= {n: pa.array(v[part]) for n, v in columns.items()}
        yield pa.RecordBatch.from_pydict(cols)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(tree: RunTree) -> Iterator[pa.RecordBatch]:
        keys, code, start, end = tree.result()
        return _batches(keys, code, {"s": start, "e": end})

    tree = RunTree()
    for batch in batches:
        tree.add(batch)
        if tree.size() > FLUSH:
            yield from flush(tree)
            tree = RunTree()
    yield from flush(tree)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: inner periods (kind 0), the gaps between intervals (1), first and last interval (2).

    The rows are sorted by entity and block, so no more than one batch and one
    block's lists are held.
    """
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if rest is None else pa.concat_batches([rest, batch])
        last = whole.num_rows - 1
        entity, block = whole.column(0), whole.column(1)
        same = pc.equal(block, block[last]).to_numpy(zero_copy_only=False)
        same &= (pc.is_null(entity) if entity[last].as_py() is None else pc.fill_null(pc.equal(entity, entity[last]), False)).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        yield from _finished(whole.slice(0, cut))
        rest = whole.slice(cut)
    if rest is not None:
        yield from _finished(rest)


def _finished(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    tree = RunTree()
    tree.add(batch)
    keys, code, start, end = tree.result()
    if not len(code):
        return
    same = code[1:] == code[:-1]
    edge = np.ones(len(code), bool)
    edge[1:-1] = ~(same[:-1] & same[1:])
    kind = np.where(edge, 2, 0).astype(np.int32)
    yield from _batches(keys, code, {"kind": kind, "s": start, "e": end})
    before = np.flatnonzero(same)
    gap = np.ones(len(before), np.int32)
    yield from _batches(keys, code[before], {"kind": gap, "s": end[before], "e": start[before + 1]})


def periods_and_gaps(
    df: DataFrame, entity: str, start: str, end: str, block_ms: int = BLOCK_MS, fan_in: int = FAN_IN
) -> DataFrame:
    """(entity, kind, start, end): maximal covered stretches and the holes between them.

    ``start`` and ``end`` are BIGINT; a row with a null bound or end <= start
    covers nothing; intervals that touch form one period; repeated rows change
    nothing; a null entity is an entity of its own; an empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    lo, hi = F.col("s"), F.col("e")
    cut = (
        df.select(F.col(entity).cast("string").alias("entity"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
        .where(hi > lo)
        .withColumn("block", F.explode(F.expr(f"sequence((s - pmod(s, {block_ms})) div {block_ms}, (e - 1 - pmod(e - 1, {block_ms})) div {block_ms})")))
        .select(
            "entity",
            "block",
            (F.greatest(lo, F.col("block") * block_ms) - F.col("block") * block_ms).alias("s"),
            (F.least(hi, (F.col("block") + 1) * block_ms) - F.col("block") * block_ms).alias("e"),
        )
    )
    schema = "entity string, block bigint, s bigint, e bigint"
    runs = cut.mapInArrow(_partial, schema)
    per_task = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    salts = math.ceil(estimated_bytes(df) / max(per_task, 1) / fan_in)
    if salts > 1:
        salted = runs.withColumn("salt", F.spark_partition_id() % salts).repartition("entity", "block", "salt")
        runs = salted.drop("salt").mapInArrow(_partial, schema)
    parts = (
        runs.repartition("entity", "block")
        .sortWithinPartitions("entity", "block")
        .mapInArrow(_emit, "entity string, block bigint, kind int, s bigint, e bigint")
        .select("entity", "block", "kind", (F.col("block") * block_ms + F.col("s")).alias("s"), (F.col("block") * block_ms + F.col("e")).alias("e"))
    )
    inner = parts.where("kind < 2").select(
        "entity", F.when(F.col("kind") == 0, "period").otherwise("gap").alias("kind"), "s", "e"
    )
    by_time = Window.partitionBy("entity").orderBy("s")
    edges = (
        parts.where("kind = 2")
        .withColumn("prev_e", F.lag("e").over(by_time))
        .withColumn("prev_block", F.lag("block").over(by_time))
        .withColumn("head", F.coalesce(F.col("s") > F.col("prev_e"), F.lit(True)))
        .withColumn("run", F.sum(F.col("head").cast("int")).over(by_time))
        .withColumn("hole", F.col("head") & (F.col("block") != F.col("prev_block")))
    )
    stitched = edges.groupBy("entity", "run").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.when(F.col("hole"), F.struct("prev_e", "s"))).alias("hole")
    )
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("s"), F.col("e").alias("e")),
        F.struct(F.lit("gap").alias("kind"), F.col("hole.prev_e").alias("s"), F.col("hole.s").alias("e")),
    )
    outer = stitched.select("entity", F.inline(rows)).where(F.col("s").isNotNull())
    return inner.unionByName(outer).select(
        F.col("entity").alias(entity), "kind", F.col("s").alias("start_ms"), F.col("e").alias("end_ms")
    )
