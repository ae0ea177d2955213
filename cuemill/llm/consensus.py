"""Consensus labels of several annotators who disagree.

1. Joint counts of the labels of annotators and their partners are summed over
   all items (bounded by annotators and labels, not by items). Few annotators
   are each other's partners one by one; many are paired with pools of others,
   so that the counts grow with the annotators, not with their square.
2. Agreement corrected for chance gives each annotator's accuracy by the triplet
   moment method; shifted and reversed scales are found by the reading that
   agrees best with the reliable others.
3. Votes are combined with the log-odds those accuracies imply (``plain_labels``);
   counting each annotator's labels against the consensus of the others gives
   the final log-odds of every label, with the triplet estimate as prior
   (``labels``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.triplets import SHIFTS, choose_ways, corrected_agreement, habits, profiles, read_labels, read_partners, solve_triplets
from cuemill.session import materialize, number_rows

PAIRED_CODES = 1024  # annotators times labels up to which annotators are paired one by one
POOLS = 16
ROUNDS = 5
MAX_LABELS = 1024
PRIOR_WEIGHT = 8.0


def _lists(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat codes of a list column and the number of the item of each."""
    column = batch.column(at)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def _summed(partial: DataFrame, size: int) -> np.ndarray:
    """Sums of (code, value) as an array of ``size`` numbers."""
    found = partial.groupBy("code").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[found["code"].to_numpy()] = found["value"].to_numpy()
    return out


def _nonzero(sums: np.ndarray) -> pa.RecordBatch:
    code = np.flatnonzero(sums)
    return pa.RecordBatch.from_pydict({"code": code, "value": sums[code]})


class Consensus:
    """Fitted on a table of (item, annotator, label) rows; labels are integers from 0 on.

    A later row of the same item and annotator replaces an earlier one; of two
    at the same time the higher label counts. Rows with a null item, annotator
    or label, or a label outside the range, are no votes. Repeated rows count
    once. Other columns are ignored. An item's labels lie in one row; it has at
    most one for each annotator.
    """

    def __init__(self, df: DataFrame, item: str, annotator: str, label: str, at: str, n_labels: int, paired_codes: int = PAIRED_CODES) -> None:
        if not 0 < n_labels <= MAX_LABELS:
            raise ValueError(f"n_labels must be in 1..{MAX_LABELS}")
        self.item, self.n_labels = item, n_labels
        micros = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(0))
        votes = (
            df.select(F.col(item).alias("item"), F.col(annotator).cast("string").alias("who"), F.col(label).cast("int").alias("label"), micros.alias("at"))
            .where("item IS NOT NULL AND who IS NOT NULL AND label >= 0")
            .where(F.col("label") < n_labels)
            .groupBy("item", "who")
            .agg(F.max(F.col("at") * MAX_LABELS + F.col("label")).alias("last"))
            .select("item", "who", F.pmod("last", F.lit(MAX_LABELS)).cast("int").alias("label"))
        )
        index = number_rows(df.select(F.col(annotator).cast("string").alias("who")).where("who IS NOT NULL").distinct(), ["who"], "n").select("who", (F.col("n") - 1).cast("int").alias("number"))
        self.who = [r.who for r in index.orderBy("number").select("who").collect()]  # one name per annotator, as the result of ``reliability`` has
        self.items = materialize(votes.join(index, "who").groupBy("item").agg(F.array_sort(F.collect_list(F.col("number") * n_labels + F.col("label"))).alias("codes")))
        m = len(self.who)
        self.paired = m * n_labels <= paired_codes
        self.group = np.arange(m) if self.paired else np.arange(m) % POOLS
        self._fit()

    def _joint(self, way: np.ndarray | None) -> np.ndarray:
        """n[i, a, g, b]: labels as given on the left, those of the group's members read by their ways on the right."""
        k, m = self.n_labels, len(self.who)
        n_groups = m if self.paired else POOLS
        width = n_groups * k
        group, ways = self.group, np.repeat(np.arange(k)[None, :], m, 0) if way is None else way

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(m * k * width)
            for batch in batches:
                codes, row = _lists(batch, 0)
                if not len(codes):
                    continue
                who, label = codes // k, codes % k
                right = group[who] * k + ways[who, label]
                if len(ways) == n_groups:  # annotator by annotator: pairs at every distance within an item
                    for step in range(1, m):
                        same = row[step:] == row[:-step]
                        if not same.any():
                            break
                        sums += np.bincount(codes[:-step][same] * width + right[step:][same], minlength=len(sums))
                        sums += np.bincount(codes[step:][same] * width + right[:-step][same], minlength=len(sums))
                    continue
                step = max(1, (1 << 22) // width)
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                for low in range(0, len(first), step):  # items in portions: how often each of them has each group's label
                    start = first[low]
                    stop = first[low + step] if low + step < len(first) else len(row)
                    at = np.cumsum(np.append(False, row[start + 1 : stop] != row[start : stop - 1]))
                    table = np.zeros((at[-1] + 1, width))
                    np.add.at(table, (at, right[start:stop]), 1)
                    others = table[at]
                    others[np.arange(len(at)), right[start:stop]] -= 1  # not with oneself
                    r, c = np.nonzero(others)
                    sums += np.bincount(codes[start:stop][r] * width + c, others[r, c], len(sums))
            yield _nonzero(sums)

        return _summed(self.items.select("codes").mapInArrow(add_up, "code bigint, value double"), m * k * width).reshape(m, k, n_groups, k)

    def _fit(self) -> None:
        k, m = self.n_labels, len(self.who)
        raw = self._joint(None)
        size = raw.sum((1, 2, 3)) / np.maximum(raw.sum() / max(self.items.select(F.sum(F.size("codes"))).first()[0] or 1, 1), 1) + 1e-9  # about the labels of each annotator
        self.way = np.repeat(np.arange(k)[None, :], m, 0)
        read = raw
        for _ in range(ROUNDS if m else 0):
            agreement = corrected_agreement(read_labels(read, self.way), self.group)
            fresh = choose_ways(read, self.group, np.clip(solve_triplets(agreement, self.group, size), 0.02, 1), size)
            if (fresh == self.way).all():
                break
            self.way = fresh
            read = read_partners(raw, fresh) if self.paired else self._joint(fresh)
        both = read_labels(read, self.way)
        a = corrected_agreement(both, self.group)
        support = a.weight.sum(1)  # few common items say little: the estimate starts from one half
        self.quality = (support * np.clip(solve_triplets(a, self.group, size), 0, 1) + 0.5 * PRIOR_WEIGHT) / (support + PRIOR_WEIGHT)
        self.chance = float((a.chance * a.weight).sum() / max(a.weight.sum(), 1))
        self.agreement = float((a.beyond * a.weight).sum() / max(a.weight.sum(), 1))
        marginal = (both.sum((2, 3)) * self.quality[:, None] ** 2).sum(0) + 1
        self.log_prior = np.log(marginal / marginal.sum())
        profile = profiles(both, self.group, self.quality, self.chance, size) if m else np.zeros((0, k, k))
        self.raw = np.stack([profile[i][w] for i, w in enumerate(self.way)]) if m else profile
        self.raw /= np.maximum(self.raw.sum(1, keepdims=True), 1e-12)
        accuracy = np.clip(self.quality + (1 - self.quality) * self.chance, 1e-3, 1 - 1e-3)
        self.log_odds = np.log(accuracy * max(k - 1, 1) / (1 - accuracy))
        self._weigh()

    def _weigh(self) -> None:
        """Log-odds of each annotator's labels, counted against the consensus of the others."""
        k, m, log_prior = self.n_labels, len(self.who), self.log_prior
        logs = np.log(self.raw).reshape(m * k, k)

        def against_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((m * k, k))
            votes = np.zeros(m * k)
            for batch in batches:
                codes, row = _lists(batch, 0)
                if not len(codes):
                    continue
                sums = np.zeros((batch.num_rows, k))
                np.add.at(sums, row, logs[codes])
                rest = sums[row] - logs[codes] + log_prior
                rest = np.exp(rest - rest.max(1, keepdims=True))
                np.add.at(counts, codes, rest / rest.sum(1, keepdims=True))
                votes += np.bincount(codes, minlength=m * k)
            yield _nonzero(np.concatenate([counts.ravel(), votes]))

        total = _summed(self.items.select("codes").mapInArrow(against_others, "code bigint, value double"), m * k * (k + 1))
        counts = total[: m * k * k].reshape(m, k, k) + PRIOR_WEIGHT * self.raw
        self.votes = total[m * k * k :].reshape(m, k).sum(1)
        self.label_given_truth = counts / np.maximum(counts.sum(1, keepdims=True), 1e-12)

    def plain_labels(self, least: int = 3) -> DataFrame:
        """(item, score) by the triplets alone: the read label with most log-odds of the annotators who gave it, the lowest of equals."""
        k, weight, way = self.n_labels, self.log_odds, self.way

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, row = _lists(batch, 1)
                sums = np.zeros((batch.num_rows, k))
                np.add.at(sums, (row, way[codes // k, codes % k] if len(codes) else codes), weight[codes // k] if len(codes) else 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums.argmax(1).astype(np.int32))], names=[self_item, "score"])

        self_item = self.item
        kind = self.items.schema["item"].dataType.simpleString()
        return self.items.where(F.size("codes") >= least).select("item", "codes").mapInArrow(decide, f"`{self_item}` {kind}, score int")

    def labels(self, least: int = 3) -> DataFrame:
        """(item, score, n_labels, confidence, agreement) of items with ``least`` annotators or more.

        The score is the median of the posterior; agreement is 1 less the mean
        distance of an item's labels, over the distance expected by chance.
        """
        k, m, log_prior = self.n_labels, len(self.who), self.log_prior
        logs = np.log(np.maximum(self.label_given_truth, 1e-9)).reshape(m * k, k)
        spread = np.exp(log_prior)
        expected = float((spread[:, None] * spread[None, :] * np.abs(np.arange(k)[:, None] - np.arange(k)[None, :])).sum())

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, row = _lists(batch, 1)
                sums = np.zeros((batch.num_rows, k)) + log_prior
                np.add.at(sums, row, logs[codes])
                p = np.exp(sums - sums.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                score = (p.cumsum(1) >= 0.5 - 1e-12).argmax(1)
                given = np.zeros((batch.num_rows, k))
                np.add.at(given, (row, codes % k), 1)
                count = given.sum(1)
                below = given.cumsum(1)
                distance = 2 * (below * (count[:, None] - below)).sum(1) / np.maximum(count * (count - 1), 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(score.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(p[np.arange(len(score)), score]), pa.array(1 - distance / max(expected, 1e-9))],
                    names=[self_item, "score", "n_labels", "confidence", "agreement"],
                )

        self_item = self.item
        kind = self.items.schema["item"].dataType.simpleString()
        chosen = self.items.where(F.size("codes") >= least).select("item", "codes")
        return chosen.mapInArrow(decide, f"`{self_item}` {kind}, score int, n_labels int, confidence double, agreement double")

    def reliability(self, spark) -> DataFrame:
        """(annotator, n_labels, accuracy, beyond_chance, reversed, shift, log_odds) per annotator."""
        ways = habits(self.n_labels)
        rows = []
        for i, who in enumerate(self.who):
            way = next(w for w, h in enumerate(ways) if (h == self.way[i]).all())
            q = float(self.quality[i])
            rows.append((who, int(self.votes[i]), q + (1 - q) * self.chance, q, way >= len(SHIFTS), SHIFTS[way % len(SHIFTS)], float(self.log_odds[i])))
        return spark.createDataFrame(rows, "annotator string, n_labels bigint, accuracy double, beyond_chance double, reversed boolean, shift int, log_odds double")
