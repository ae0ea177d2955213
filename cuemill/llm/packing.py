"""Harmonic packing of items into containers of fixed capacity.

Lengths fall into reciprocal classes: class k holds (C/(k+1), C/k], and a bin
of class k takes exactly k items, so bins are filled by arithmetic on an item's
number, independently on every worker. Plain harmonic bins leave much room
unused; it is topped up with shorter items by the same rule, a fixed count for
a whole run of equal bins. The plan is made on the histogram of lengths, which
has at most C cells whatever the number of items, and has a bounded number of
runs: every run uses up a length or a run of bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cuemill.llm.tokens import TOKENIZER, with_tokens
from cuemill.session import materialize

CAPACITY = 1024
MAX_CAPACITY = 1 << 16


def plan(histogram: dict[int, int], capacity: int, top_up: bool = True) -> list[tuple[int, int, int, int]]:
    """Slots (length, first number, first bin, items per bin), ordered by length and number.

    The item with number r of its length, r >= first number, is in bin
    first bin + (r - first number) // items per bin.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    used = np.zeros(capacity + 1, np.int64)
    slots: list[tuple[int, int, int, int]] = []
    bins = 0

    def take(length: int, first_bin: int, n_bins: int, per_bin: int) -> None:
        slots.append((length, int(used[length]), first_bin, per_bin))
        used[length] += n_bins * per_bin
        left[length] -= n_bins * per_bin

    def fill(first_bin: int, n_bins: int, room: int) -> None:
        """Tops up a run of equal bins; the run is cut where a length gives out."""
        work = [(first_bin, n_bins, room)]
        while work:
            at, n, free = work.pop()
            fits = np.flatnonzero(left[1 : free + 1])
            if not top_up or not len(fits):
                continue
            length = int(fits[-1]) + 1
            per = min(free // length, int(left[length]))
            m = min(n, int(left[length]) // per)
            take(length, at, m, per)
            if n > m:
                work.append((at + m, n - m, free))
            if free - per * length:
                work.append((at, m, free - per * length))

    for length in range(capacity, 0, -1):
        k = capacity // length
        while left[length]:
            per = min(k, int(left[length]))
            n = int(left[length]) // per
            at, bins = bins, bins + n
            take(length, at, n, per)
            room = capacity - per * length
            if per < k:  # the rest of a length shares its bin with the next lengths of the class
                shorter, count = length - 1, k - per
                while count and shorter > 0 and capacity // shorter == k:
                    if left[shorter] and room >= shorter:
                        more = min(count, int(left[shorter]), room // shorter)
                        take(shorter, at, 1, more)
                        count -= more
                        room -= more * shorter
                    shorter -= 1
            fill(at, n, room)
    return sorted(slots)


def _number(keys: list[str], schema: T.StructType):
    """Numbers the items of each length within a task."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(MAX_CAPACITY + 1, np.int64)
        for batch in batches:
            length = batch.column(len(keys) + 1).to_numpy(zero_copy_only=False)
            order = np.argsort(length, kind="stable")
            values, first, counts = np.unique(length[order], return_index=True, return_counts=True)
            local = np.empty(len(length), np.int64)
            local[order] = np.arange(len(length)) - np.repeat(first, counts) + np.repeat(seen[values], counts)
            seen[values] += counts
            columns = [*batch.columns, pa.array(np.full(len(length), task, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return number


def pack(df: DataFrame, keys: list[str], size: str, capacity: int = CAPACITY, top_up: bool = True) -> DataFrame:
    """(keys, piece, size, container): every item once, no container above capacity.

    An item above the capacity is divided into full pieces and a rest. Items of
    size 0 or null need no room and get container null. Rows are items: repeated
    rows are packed each. Other columns are left out.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be in 1..{MAX_CAPACITY}")
    total = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    n_pieces = F.greatest(F.ceil(total / capacity), F.lit(1))
    items = df.select(*keys, total.alias("__total"), F.explode(F.sequence(F.lit(0), (n_pieces - 1).cast("int"))).alias("piece")).select(
        *keys, "piece", F.least(F.col("__total") - F.col("piece").cast("bigint") * capacity, F.lit(capacity).cast("bigint")).alias("__len")
    )
    schema = T.StructType([*items.schema, T.StructField("__task", T.IntegerType()), T.StructField("__local", T.LongType())])
    numbered = materialize(items.mapInArrow(_number(keys, schema), schema))
    per_task = numbered.groupBy("__len", "__task").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__len").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("__len", "__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    histogram = {r[0]: r[1] for r in numbered.where("__len > 0").groupBy("__len").count().collect()}  # at most `capacity` rows
    slots = np.array(plan(histogram, capacity, top_up), np.int64).reshape(-1, 4)
    bits = 44
    starts = (slots[:, 0] << bits) | slots[:, 1]
    out_schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("piece", T.IntegerType()), T.StructField(size, T.LongType()), T.StructField("container", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(len(keys) + i).to_numpy(zero_copy_only=False) for i in (1, 2))
            at = np.searchsorted(starts, (length << bits) | rank, side="right") - 1
            slot = slots[np.maximum(at, 0)] if len(slots) else np.ones((len(length), 4), np.int64)
            container = pa.array(slot[:, 2] + (rank - slot[:, 1]) // slot[:, 3], mask=length == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], container], names=out_schema.names)

    ranked = numbered.join(offsets, ["__len", "__task"]).select(*keys, "piece", "__len", (F.col("__local") + F.col("__offset")).alias("__rank"))
    return ranked.mapInArrow(place, out_schema)


def pack_texts(df: DataFrame, keys: list[str], text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, top_up: bool = True) -> DataFrame:
    return pack(with_tokens(df.select(*keys, text), text, "tokens", tokenizer), keys, "tokens", capacity, top_up)
