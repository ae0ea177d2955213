"""Annotator reliability from pairwise agreement, by the triplet moment method.

Everything here works on joint counts n[i, a, g, b]: how often annotator i gave
label a and a partner in group g was read as b, on one item. A group is one
annotator where there are few, else a pool of many; the counts' size depends on
annotators, groups and labels only, not on items.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SHIFTS = (0, 1, -1, 2, -2)


def habits(n_labels: int) -> np.ndarray:
    """Ways to read an annotator's labels [way, label]: as they are, shifted, or on a reversed scale."""
    labels = np.arange(n_labels)
    straight = [np.clip(labels - s, 0, n_labels - 1) for s in SHIFTS]
    return np.array(straight + [h[::-1] for h in straight])


def read_labels(n: np.ndarray, way: np.ndarray) -> np.ndarray:
    """The joint counts after every annotator's own labels are read by its way [annotator, label]."""
    out = np.zeros_like(n)
    for i, w in enumerate(way):
        np.add.at(out[i], w, n[i])
    return out


def read_partners(n: np.ndarray, way: np.ndarray) -> np.ndarray:
    """The joint counts after the partners' labels are read, where groups are annotators."""
    out = np.zeros_like(n)
    for g, w in enumerate(way):
        np.add.at(out[:, :, g, :].transpose(2, 0, 1), w, n[:, :, g, :].transpose(2, 0, 1))
    return out


class Agreement(NamedTuple):
    beyond: np.ndarray  # [annotator, group]: agreement beyond chance, 0 where there is no common item
    weight: np.ndarray  # [annotator, group]: labels on common items; 0 for an annotator's own group
    chance: np.ndarray  # [annotator, group]
    between: np.ndarray  # [group, group]: agreement beyond chance of the groups' members


def _beyond(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total = n.sum((1, 3))
    safe = np.maximum(total, 1)
    agree = np.einsum("iaga->ig", n) / safe
    chance = np.einsum("iag,iga->ig", n.sum(3), n.sum(1)) / safe**2
    return np.where(total > 0, (agree - chance) / np.maximum(1 - chance, 1e-9), 0.0), total, chance


def corrected_agreement(n: np.ndarray, group: np.ndarray) -> Agreement:
    """From counts with both sides read; ``group`` is each annotator's own."""
    beyond, weight, chance = _beyond(n)
    own = np.arange(len(n)), group
    beyond[own], weight[own] = 0, 0
    pooled = np.zeros((n.shape[2], *n.shape[1:]))
    np.add.at(pooled, group, n)
    between = _beyond(pooled)[0]
    np.fill_diagonal(between, 0)
    return Agreement(beyond, weight, chance, between)


def solve_triplets(a: Agreement, group: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Loadings q with beyond[i, g] = q[i] * q[g].

    For every annotator i, q[i]**2 is the ratio of the sums of beyond[i, g] *
    beyond[i, h] and between[g, h] over all pairs of groups g, h, weighted by the
    items in common; the sign is that of the agreement with the others. A few
    rounds put weight on groups that are themselves reliable; ``size`` weighs
    the members of a group.
    """
    n_groups = a.weight.shape[1]
    trust = np.ones(n_groups)
    q = np.zeros(len(group))
    members = np.maximum(np.bincount(group, size, n_groups), 1e-12)
    for _ in range(8):
        w = a.weight * trust
        seen = w * a.beyond
        top = seen.sum(1) ** 2 - (seen**2).sum(1)
        below = np.einsum("ig,gh,ih->i", w, a.between, w, optimize=True)
        square = np.divide(top, below, out=np.zeros_like(top), where=below > 0)
        q = np.sqrt(np.clip(square, 0, 0.999)) * np.where(seen.sum(1) > 0, 1, -1)
        trust = np.bincount(group, size * np.clip(q, 0.02, 1) ** 2, n_groups) / members
    return q


def choose_ways(n: np.ndarray, group: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The way of each annotator [annotator, label] that agrees best with the reliable others, whose labels are read.

    Another way than straight must gain more than chance would by the number of
    the annotator's labels, so that many annotators with few labels don't drift
    off together.
    """
    ways = habits(n.shape[1])
    trust = np.bincount(group, size * np.clip(q, 0.02, 1) ** 2, n.shape[2]) / np.maximum(np.bincount(group, size, n.shape[2]), 1e-12)
    weight = np.repeat(trust[None, :], len(n), 0)
    if n.shape[2] == len(n):
        weight[np.arange(len(n)), group] = 0
    pooled = np.einsum("iagb,ig->iab", n, weight)
    scores = []
    for way in ways:
        t = np.zeros_like(pooled)
        np.add.at(t.transpose(1, 0, 2), way, pooled.transpose(1, 0, 2))
        s = np.maximum(t.sum((1, 2)), 1e-9)
        chance = (t.sum(2) * t.sum(1)).sum(1) / s**2
        scores.append((np.einsum("iaa->i", t) / s - chance) / np.maximum(1 - chance, 1e-9))
    chance_gain = 1e-3 + 1 / np.sqrt(np.maximum(size, 1))
    best = (np.array(scores) - chance_gain[None, :] * (np.arange(len(ways)) > 0)[:, None]).argmax(0)
    return ways[best]


def profiles(n_read: np.ndarray, group: np.ndarray, q: np.ndarray, chance: float, size: np.ndarray) -> np.ndarray:
    """P(read label | true label) per annotator: [annotator, read, true].

    The accuracy on the diagonal comes from the triplets. The distance of the
    other labels follows the differences to the others, less the part of the
    variance that triplets of variances assign to those.
    """
    m, k, n_groups = len(n_read), n_read.shape[1], n_read.shape[2]
    gap = np.arange(k)[:, None] - np.arange(k)[None, :]
    count = n_read.sum((1, 3))
    total = np.maximum(count, 1e-9)
    mean = np.einsum("iagb,ab->ig", n_read, gap.astype(float)) / total
    var = np.einsum("iagb,ab->ig", n_read, gap.astype(float) ** 2) / total - mean**2
    members = np.maximum(np.bincount(group, size, n_groups), 1e-12)
    w = count * (np.bincount(group, size * np.clip(q, 0.02, 1) ** 2, n_groups) / members)[None, :]
    w[np.arange(m), group] = 0
    s2 = np.full(m, 1.0)
    for _ in range(20):  # var[i, g] = s2[i] + s2[g]
        of_group = np.bincount(group, size * s2, n_groups) / members
        s2 = np.maximum(((var - of_group[None, :]) * w).sum(1) / np.maximum(w.sum(1), 1e-9), 0.05)
    accuracy = np.clip(q + (1 - q) * chance, 0.02, 0.98)
    out = np.zeros((m, k, k))
    d = np.abs(gap)
    for i in range(m):
        low, high = 0.01, 0.95
        for _ in range(30):  # geometric tail with that variance
            r = (low + high) / 2
            tail = r ** (np.arange(1, k) - 1)
            v = (1 - accuracy[i]) * (tail * np.arange(1, k) ** 2).sum() / max(tail.sum(), 1e-12)
            low, high = (r, high) if v < s2[i] else (low, r)
        p = np.where(d == 0, accuracy[i], (1 - accuracy[i]) / 2 * r ** (np.maximum(d, 1) - 1.0) * (1 - r))
        p = p / p.sum(0, keepdims=True)
        marginal = n_read[i].sum((1, 2)) + 1e-6
        marginal = marginal / marginal.sum()
        keep = np.clip(q[i], 0, 1) ** 0.25 if q[i] > 0.05 else 0.0
        out[i] = keep * p + (1 - keep) * marginal[:, None]
    return out
