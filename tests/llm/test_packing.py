import random
from collections import Counter

from cuemill.llm.packing import pack, pack_texts, plan
from cuemill.llm.tokens import encoder, TOKENIZER


def place(histogram, capacity, **options):
    slots = plan(histogram, capacity, **options)
    load = Counter()
    for length, count in histogram.items():
        own = [s for s in slots if s[0] == length]
        for r in range(count):
            _, first, at, per = [s for s in own if s[1] <= r][-1]
            load[at + (r - first) // per] += length
    return load


def test_plan_keeps_capacity_and_fills():
    rnd = random.Random(5)
    for capacity in (7, 64, 1024):
        sizes = Counter(min(capacity, int(rnd.expovariate(4 / capacity)) + 1) for _ in range(3000))
        load = place(sizes, capacity)
        assert max(load.values()) <= capacity
        assert sum(load.values()) == sum(k * v for k, v in sizes.items())
        assert sum(load.values()) > 0.97 * capacity * len(load)
        plain = place(sizes, capacity, top_up=False)
        assert max(plain.values()) <= capacity and len(plain) >= len(load)


def test_table(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, None, 1, 3, 10, 25, 100, 101, 250])) for i in range(500)] + [(7, 33), (7, 33)]
    df = spark.createDataFrame(rows, "k int, n bigint").repartition(7)
    got = pack(df, ["k"], "n", capacity=100).collect()
    load = Counter()
    for r in got:
        if r.container is None:
            assert r.n == 0
        else:
            load[r.container] += r.n
    assert max(load.values()) <= 100
    assert sum(load.values()) == sum(n or 0 for _, n in rows)
    pieces = Counter(r.k for r in got)
    assert all(pieces[k] >= 1 for k, _ in rows)
    assert pack(df.limit(0), ["k"], "n").count() == 0


def test_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "word " * 5000, "c"), (4, "hi", "d")], "doc int, text string, tokens string")
    got = pack_texts(df, ["doc"], "text").collect()
    size = {d: sum(r.tokens for r in got if r.doc == d) for d in (1, 2, 3, 4)}
    assert size[1] == size[2] == 0 and size[3] == len(encoder(TOKENIZER).encode_ordinary("word " * 5000))
