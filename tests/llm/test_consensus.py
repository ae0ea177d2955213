import numpy as np

from cuemill.llm.consensus import Consensus
from cuemill.llm.triplets import Agreement, corrected_agreement, solve_triplets

SCHEMA = "item string, who string, label int, at timestamp, score string"


def panel(seed=1, items=1500):
    rnd = np.random.default_rng(seed)
    truth = np.clip(np.round(rnd.normal(6.5, 2.2, items)), 0, 10).astype(int)
    rows = []
    for i, y in enumerate(truth):
        for who in rnd.choice(12, 5, replace=False):
            x = y + rnd.normal(0, 0.7)
            x = {9: 10 - y, 10: 7, 11: rnd.integers(0, 11)}.get(int(who), x + (1 if who == 8 else 0))
            rows.append((f"i{i}", f"w{who:02}", int(np.clip(round(float(x)), 0, 10)), None, "x"))
    return truth, rows


def test_planted_panel(spark):
    truth, rows = panel()
    fit = Consensus(spark.createDataFrame(rows + rows[:500], SCHEMA), "item", "who", "label", "at", 11)
    got = {r["item"]: r.score for r in fit.labels().collect()}
    y = np.array([got[f"i{i}"] for i in range(len(truth))])
    votes = {}
    for item, _, label, _, _ in rows:
        votes.setdefault(item, []).append(label)
    median = np.array([round(float(np.median(votes[f"i{i}"]))) for i in range(len(truth))])
    assert (y == truth).mean() > max(0.72, (median == truth).mean() + 0.05)
    quality = dict(zip(fit.who, fit.quality))
    assert quality["w10"] < 0.15 and quality["w11"] < 0.15 < min(quality[f"w{i:02}"] for i in range(8))
    assert fit.way[9][0] == 10 and fit.way[8][5] == 4
    plain = {r['item']: r.score for r in fit.plain_labels().collect()}
    z = np.array([plain[f'i{i}'] for i in range(len(truth))])
    assert (z == truth).mean() > (median == truth).mean()


def test_triplets_recover_loadings():
    q = np.array([0.9, 0.7, 0.5, 0.3, 0.0])
    c = np.outer(q, q)
    np.fill_diagonal(c, 0)
    w = 1.0 - np.eye(5)
    assert np.abs(solve_triplets(Agreement(c, w, 0 * c, c), np.arange(5), np.ones(5)) - q).max() < 1e-3


def test_edges(spark):
    rows = [("a", "u", 5, None, None), ("a", "v", 5, None, None), ("a", None, 9, None, None), (None, "u", 1, None, None), ("b", "u", 99, None, None), ("b", "v", None, None, None), ("c", "u", 3, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    fit = Consensus(df, "item", "who", "label", "at", 11)
    assert {r["item"] for r in fit.labels(least=1).collect()} == {"a", "c"}
    assert fit.labels().count() == 0
    empty = Consensus(df.limit(0), "item", "who", "label", "at", 11)
    assert empty.labels(1).count() == 0 and empty.reliability(spark).count() == 0
    assert corrected_agreement(np.zeros((2, 3, 2, 3)), np.arange(2)).beyond.sum() == 0


def test_later_row_counts(spark):
    df = spark.sql("""SELECT * FROM VALUES ('a','u',2,TIMESTAMP'2024-01-01'),('a','u',8,TIMESTAMP'2024-01-02'),('a','v',8,TIMESTAMP'2024-01-01'),('a','w',8,TIMESTAMP'2024-01-01') AS t(item,who,label,at)""")
    fit = Consensus(df, "item", "who", "label", "at", 11)
    assert [(r.score, r.n_labels) for r in fit.labels().collect()] == [(8, 3)]


def test_five_hundred_annotators(spark):
    """Pools of partners give about the accuracies that pairs give, and many annotators are no error."""
    rnd = np.random.default_rng(4)
    truth = np.clip(np.round(rnd.normal(6.5, 2.2, 6000)), 0, 10).astype(int)
    noise = rnd.uniform(0.4, 2.5, 500)
    noise[:5] = 50  # mere guesses
    rows = []
    for i, y in enumerate(truth):
        for who in rnd.choice(500, 8, replace=False):
            x = 10 - y if who == 7 else y + rnd.normal(0, noise[who])
            rows.append((f"i{i}", f"w{who:03}", int(np.clip(round(x), 0, 10)), None, "x"))
    fit = Consensus(spark.createDataFrame(rows, SCHEMA), "item", "who", "label", "at", 11)
    assert not fit.paired and len(fit.who) == 500
    got = {r["item"]: r.score for r in fit.labels().collect()}
    y = np.array([got[f"i{i}"] for i in range(len(truth))])
    votes: dict = {}
    for item, _, label, _, _ in rows:
        votes.setdefault(item, []).append(label)
    median = np.array([round(float(np.median(votes[f"i{i}"]))) for i in range(len(truth))])
    assert (y == truth).mean() > (median == truth).mean()
    assert np.corrcoef(fit.quality, -noise.clip(0, 3))[0, 1] > 0.8 and fit.way[7][0] == 10


def test_pools_agree_with_pairs(spark):
    truth, rows = panel(2)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs, pools = (Consensus(df, "item", "who", "label", "at", 11, paired_codes=c) for c in (4096, 1))
    assert (pairs.way == pools.way).all() and np.abs(pairs.quality - pools.quality).max() < 0.1
