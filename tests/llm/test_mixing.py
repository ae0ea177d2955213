import numpy as np

from cuemill.llm.mixing import Classifier, fit_rates, mix


def corpus(spark):
    rows = []
    for i in range(400):
        rows.append((i, f"the house near the river number {i % 7} " * (1 + i % 5), "a", None))
    for i in range(60):
        rows.append((1000 + i, f"una carta para el puerto {i % 5} " * (1 + i % 3), "b", "x"))
    for i in range(12):
        rows.append((2000 + i, "kurz gesagt ein brief", "c", "x"))
    rows += [(3000, "no source", None, "x"), (3001, "other source", "zzz", "x"), (3002, None, "a", "x"), (3003, "", "b", "x")]
    return spark.createDataFrame(rows, "id int, text string, source string, tokens string")


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.08, 4), ("missing", 0.02, 2)], "source string, target_share double, max_repeats int")
    got = mix(corpus(spark), targets, "id", "text", "source")
    rows = {r.source: r for r in got.shares.collect()}
    assert rows["missing"].tokens == 0
    for s in "abc":
        assert abs(rows[s].actual_share - rows[s].fitted_share) < 0.03
    cap = {"a": 1, "b": 2, "c": 4}
    docs = got.documents.collect()
    assert all(1 <= r.repeats <= cap[r.source] for r in docs)
    assert len({r.id for r in docs}) == len(docs) and not {r.id for r in docs} & {3000, 3001, 3002, 3003}


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mix(corpus(spark).limit(0), targets, "id", "text", "source").documents.count() == 0
    assert mix(corpus(spark), targets.limit(0), "id", "text", "source").documents.count() == 0
    one = mix(corpus(spark), targets, "id", "text", "source")
    assert [r.actual_share for r in one.shares.collect()] == [1.0]


def test_rates_are_feasible_and_best():
    rnd = np.random.default_rng(0)
    for _ in range(20):
        n, m = 4, 24
        source = rnd.integers(0, n, m)
        source[:n] = range(n)
        tokens = rnd.uniform(1, 100, m)
        expected = rnd.dirichlet(np.ones(n), m) * tokens[:, None]
        caps = rnd.integers(1, 4, n).astype(float)
        have = np.bincount(source, tokens, n)
        goal = have * caps * rnd.uniform(0.1, 1, n)
        fit = fit_rates(tokens, source, expected, goal, caps)
        assert (fit.rates >= 0).all() and (fit.rates <= caps[source] + 1e-9).all()
        assert np.allclose(np.bincount(source, tokens * fit.rates, n), goal, rtol=1e-6)
        loss = lambda r: ((expected * r[:, None]).sum(0) - goal) @ ((expected * r[:, None]).sum(0) - goal)
        start = (goal / have)[source]
        assert loss(fit.rates) <= loss(start) + 1e-6
        for _ in range(200):  # no feasible exchange between two groups of a source is better
            i, j = rnd.integers(0, m, 2)
            if source[i] == source[j] and i != j:
                d = min(fit.rates[i], (caps[source[i]] - fit.rates[j]) * tokens[j] / tokens[i], 0.01)
                r = fit.rates.copy()
                r[i] -= d
                r[j] += d * tokens[i] / tokens[j]
                assert loss(r) >= loss(fit.rates) - 1e-3 * max(loss(fit.rates), 1)


def test_a_document_does_not_vouch_for_itself():
    counts = np.zeros((2, 16))
    counts[0, 3], counts[1, 5] = 1, 1  # each source has one document of one word
    p = Classifier(counts).memberships(np.array([0, 1]), np.array([1, 1]), np.array([3, 5]))
    assert np.allclose(p, p[::-1, ::-1]) and p[0, 0] < 0.6
    assert np.isfinite(Classifier(np.zeros((3, 16))).memberships(np.array([0]), np.array([0]), np.zeros(0, int))).all()


def test_many_sources(spark):
    n = 300
    df = spark.range(n * 4).selectExpr("id", "concat('word', id % 13, ' and some more words ', id) AS text", f"concat('s', id % {n}) AS source")
    targets = spark.range(n).selectExpr("concat('s', id) AS source", f"1.0D / {n} AS target_share", "2 AS max_repeats")
    got = mix(df, targets, "id", "text", "source")
    rows = got.shares.collect()
    assert len(rows) == n and abs(sum(r.actual_share for r in rows) - 1) < 1e-9 and max(abs(r.actual_share - r.fitted_share) for r in rows) < 0.002


def test_memberships_steer_however_many_sources(spark):
    """Of every source three of nine documents read like the next one; odd sources are to give half of theirs, and must give those."""
    word = lambda k: "w" + "".join(chr(97 + k // 26**i % 26) for i in range(3))
    for n in (8, 66):
        voice = [" ".join(word(20 * i + j) for j in range(16)) for i in range(n)]
        rows = [(9 * i + k, voice[i if k < 6 else (i + 1) % n], f"s{i}") for i in range(n) for k in range(9)]
        df = spark.createDataFrame(rows, "id int, text string, source string")
        targets = spark.createDataFrame([(f"s{i}", (2.0 - i % 2) / (1.5 * n), 1) for i in range(n)], "source string, target_share double, max_repeats int")
        got = mix(df, targets, "id", "text", "source")
        assert got.shares.first().distance < 0.01
        rates = {r.id: r.rate for r in got.documents.collect()}
        odd = [9 * i + k for i in range(1, n, 2) for k in range(9)]
        like_own, like_next = (np.mean([rates.get(i, 0) for i in odd if (i % 9 > 5) == other]) for other in (False, True))
        assert like_next > 2 * like_own


def test_parts_change_no_repeat(spark, monkeypatch):
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.5, 2), ("c", 0.1, 4)], "source string, target_share double, max_repeats int")
    found = []
    for rows, files in ((100_000, 4), (10, 4), (3, 7)):
        monkeypatch.setattr("cuemill.llm.mixing.GROUP_ROWS", rows)
        found.append(sorted((r.id, r.repeats) for r in mix(corpus(spark).repartition(files), targets, "id", "text", "source").documents.collect()))
    assert found[0] == found[1] == found[2]


def test_memberships_are_the_formula(monkeypatch):
    rnd = np.random.default_rng(1)
    counts = rnd.poisson(0.7, (5, 32)).astype(float)
    lengths, source = rnd.integers(0, 20, 30), rnd.integers(0, 5, 30)
    words = np.concatenate([rnd.choice(32, k, replace=False) for k in lengths])
    whole = Classifier(counts).memberships(source, lengths, words)
    monkeypatch.setattr("cuemill.llm.mixing.CHUNK_CELLS", 7)
    assert np.allclose(Classifier(counts).memberships(source, lengths, words), whole)
    size, at = counts.sum(1), 0
    for s, k, p in zip(source, lengths, whole):
        own, own_size = counts.copy(), size.copy()
        mine = words[at : at + k]
        own[s, mine] = np.maximum(own[s, mine] - 1, 0)
        own_size[s] = max(own_size[s] - k, 0)
        log = (np.log(own[:, mine] + 0.2) - np.log(own_size + 0.2 * 32)[:, None]).sum(1) * min(k, 12) / max(k, 1) + np.log((size + 1) / (size.sum() + 5))
        assert np.allclose(p, np.exp(log) / np.exp(log).sum())
        at += k
