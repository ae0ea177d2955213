import random

from pyspark.sql import functions as F

from cuemill.functions.timecode import lenient_ms
from cuemill.operators.intervals import periods_and_gaps

SCHEMA = "ep string, kind string, s bigint, e bigint"


def brute(rows):
    out = set()
    by = {}
    for ep, s, e in rows:
        by.setdefault(ep, [])
        if s is not None and e is not None and e > s:
            by[ep].append((s, e))
    for ep, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(ep, "period", s, e) for s, e in merged}
        out |= {(ep, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return {tuple(r) for r in periods_and_gaps(df, "ep", "s", "e", **options).collect()}


def test_random_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), "x", s := rnd.randrange(0, 5000), s + rnd.randrange(-3, 40)) for _ in range(600)]
    expected = brute([(r[0], r[2], r[3]) for r in rows])
    assert run(spark, rows, block_ms=100) == expected
    assert run(spark, rows, block_ms=100, fan_in=1) == expected
    assert run(spark, rows) == expected


def test_touching_at_a_block_border_and_long_intervals(spark):
    rows = [("a", None, 0, 100), ("a", None, 100, 1000), ("a", None, 1500, 1600), ("a", None, 1600, 1700)]
    assert run(spark, rows, block_ms=100) == brute([(r[0], r[2], r[3]) for r in rows])


def test_nulls_empty_and_repeats(spark):
    assert run(spark, []) == set()
    rows = [("a", None, None, 5), ("a", None, 5, None), ("a", None, 7, 7), ("a", None, 1, 2), ("a", None, 1, 2)]
    assert run(spark, rows) == {("a", "period", 1, 2)}


def test_lenient_times(spark):
    texts = {
        "00:00:01,000": 1000, "0:00:01.5": 1500, "　00:00:01,05\n": 1050, "99:99:99,999": 362439999,
        "00：00：01，000": None, "00:00:01,": None, "N/A": None, None: None, "00:00:01,0000": None, "００:00:01,000": 1000,
    }
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "t string, v bigint")
    assert df.where(~lenient_ms(F.col("t")).eqNullSafe(F.col("v"))).count() == 0


def test_negative_times(spark):
    rows = [("a", None, -250, -120), ("a", None, -130, 5), ("a", None, 50, 60)]
    assert run(spark, rows, block_ms=100) == brute([(r[0], r[2], r[3]) for r in rows])
