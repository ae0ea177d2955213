from pyspark.sql import functions as F

from cuemill.functions import text as fx
from cuemill.operators import cues as cue_op
from cuemill.operators import responses, runs, tqa, wrap
from cuemill.operators.mending import mend


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    return [r[0] for r in rows.select(column.alias("v"), "n").orderBy("n").select("v").collect()]


def test_languages(spark):
    texts = ["Hello there", "你好，世界。", "안녕하세요", "これは本です", "123", "", "   "]
    assert values(spark, texts, fx.language(F.col("t"))) == ["en", "zh", "ko", "ja", "zh", "en", "en"]


def test_sdh(spark):
    texts = ["♪♪", "[a] hello [b]", "(sighs)\n- [door]", "Hello (sighs) you", "- ", None, ""]
    assert values(spark, texts, fx.sdh_only(F.col("t"))) == [True, True, True, False, True, None, False]
    lines = ["Hello (sighs)  you ♪", "- [x]", "-- a", "-b", "- - c", "--", " [x] d"]
    assert values(spark, lines, fx.sdh_strip(F.array("t"))) == [["Hello you"], [], ["- a"], ["- b"], ["- c"], [], ["d"]]


def test_disfluency(spark):
    lines = ["Uh, they they went", "It was, you know, the the the end", "e- e- each one", "我我我我", "Um, so, like, yes."]
    assert values(spark, lines, fx.fluent(F.col("t"))) == ["They went", "It was, the end", "each one", "我我我我", "So, yes."]


def test_flatten_and_merge(spark):
    assert values(spark, ["你好\n世界", "a\nb", "你好\nabc"], fx.flatten(fx.lines(F.col("t")))) == ["你好世界", "a b", "你好 abc"]
    merged = fx.merge_lines(fx.lines(F.col("t")), 42, " ", ".!?", True)
    assert values(spark, ["Ends here.\nNext one\nand more\n- Talk", "- One\n- Two\nplain"], merged) == [["Ends here.", "Next one and more", "- Talk"], ["- One", "- Two plain"]]


CUES = "episode_id string, id int, start_ms bigint, end_ms bigint, text string"


def test_overlaps_and_quality(spark):
    rows = [("a", 0, 0, 2000, "x" * 20), ("a", 1, 1000, 3000, ""), ("a", 2, 3100, 13100, "line\nb\nc"), ("b", 0, 0, 1000, "ok"), ("b", 1, 1100, 1100, None)]
    cues = spark.createDataFrame(rows, CUES)
    assert {r.episode_id: (r.pair_count, r.overlap_count, r.max_overlap_ms) for r in cue_op.overlap_stats(cues).collect()} == {"a": (2, 1, 1000), "b": (1, 0, 0)}
    clipped = {(r.episode_id, r.id): r.end_ms for r in cue_op.clip_overlaps(cues).collect()}
    assert clipped == {("a", 0): 1000, ("a", 1): 13100, ("b", 0): 1000, ("b", 1): 1100}
    issues = {(r.episode_id, r.id): r.issues for r in cue_op.quality(cues).collect()}
    assert issues[("a", 0)] == ["cps", "line"] and issues[("a", 1)] == ["missing"] and issues[("a", 2)] == ["too_long", "lines"] and issues[("b", 1)] == ["missing"]
    assert cue_op.overlap_stats(cues.limit(0)).count() == 0


def test_batches(spark):
    cues = spark.createDataFrame([("a", i, 0, 0, "t") for i in range(10)], CUES)
    assert [r.n for r in cue_op.batch_plan(cue_op.batches(cues, 3)).orderBy("batch").collect()] == [3, 3, 3, 1]
    assert cue_op.batch_plan(cue_op.batches(cues, 0)).count() == cue_op.batch_plan(cue_op.batches(cues, None)).count() == 1


def test_wrapping():
    assert wrap.wrap(["short", "lines"], "en", 42, False) == ["short lines"]
    long = "I was walking along the old road because the bus had left before we came to the station"
    assert all(len(x) <= 42 for x in wrap.wrap([long], "en", 42, False)[:-1]) and " ".join(wrap.wrap([long], "en", 42, False)) == long
    assert "".join(wrap.break_line("我今天去了学校因为老师说我们要一起去看电影然后吃饭", 16, "zh")) == "我今天去了学校因为老师说我们要一起去看电影然后吃饭"
    assert wrap.end_mark(["我们今天一起去了学校看书"], "zh")[-1].endswith("。") and wrap.end_mark(["短句"], "zh") == ["短句"]
    assert wrap.cut_hard("x" * 95, 42) == ["x" * 42, "x" * 42, "x" * 11]


def test_allot():
    got = wrap.allot([10, 30], 0, 4_040_000)
    assert got == [(0, 1_000_000), (1_040_000, 4_040_000)]
    assert wrap.allot([1, 1, 1], 0, 100_000)[-1][1] <= 100_000 and wrap.allot([5], 3, 9) == [(3, 9)]


def test_split_keeps_text(spark):
    cues = spark.createDataFrame([("a", 0, 0, 10000, "word " * 80), ("a", 1, 10000, 11000, "fine"), ("a", 2, None, None, "w " * 90)], CUES)
    got = wrap.wrap_and_split(cues).orderBy("id").collect()
    assert sum(r.is_split for r in got) >= 2 and " ".join(" ".join(r.text for r in got).split()) == " ".join(("word " * 80 + "fine " + "w " * 90).split())
    assert wrap.wrap_and_split(cues.limit(0)).count() == 0


def test_mending():
    assert mend('```json\n{"0": {"src": "a", "tr": "b"}}\n```') == ({"0": {"src": "a", "tr": "b"}}, [])
    assert mend('{201": {"src": "a", "tr": "b"}}') == ({"201": {"src": "a", "tr": "b"}}, ["quoted keys"])
    assert mend('{"0": {"src": "a", "tr": "b"}') == ({"0": {"src": "a", "tr": "b"}}, ["closed braces"])
    assert mend('{"0": {"src": "a }", "tr": "b\\"}"}, "1": {"src": "c", "tr')[0] == {"0": {"src": "a }", "tr": 'b"}'}}
    assert mend('{"0":{"src":"a","tr":"b') == ({"0": {"src": "a"}}, ["dropped the last entry"])
    assert mend('{"0": "a", "1": "b') == (None, ["unrecoverable"])
    assert mend("") == mend(None) == (None, ["empty"]) and mend("nonsense").value is None and mend("{").value == {}
    assert mend("[" * 5000).value is None


def test_echoes():
    asked = {"0": "Hello there", "1": "Marcel ?", "2": "at dawn we rise", "3": "Straße", "4": "at dawn we rise", "5": None}
    verdict = lambda key, src: responses.echo_verdict(key, src, asked, {})[:2]
    assert verdict("0", "Ｈｅｌｌｏ　ｔｈｅｒｅ") == ("ok", None) and verdict("3", "STRASSE") == ("ok", None)
    assert verdict("0", "Ｍａｒｃｅｌ？") == ("misaligned", "1") and verdict("1", "marcel") == ("ok", None)
    assert verdict("4", "At dawn, we rise!") == ("ok", None) and verdict("0", "at dawn we rise") == ("misaligned", "2")
    assert verdict("2", "at down we rise") == ("drift", None) and verdict("2", "nothing like it") == ("mismatch", None)
    assert verdict("0", None) == verdict("0", " ") == ("missing", None)


def test_scores(spark):
    rows = [("a1", "s1", "cand-1", "x", f"r{i}", v, ["FABRICATION"] if i == 0 else [], "evaluator", False, i, True) for i, v in enumerate((2, 8, 9))]
    rows.append(("a2", "s1", "cand-1", "y", "r9", 4, ["FABRICATION"], "evaluator", False, 0, True))
    df = spark.createDataFrame(rows, "anonymous_id string, sample_id string, candidate_id string, dimension string, evaluator_run_id string, score int, hard_failures array<string>, scored_by string, refusal_detected boolean, run_index int, valid boolean")
    scores = tqa.final_scores(tqa.ledger(df))
    first = scores.where("anonymous_id = 'a1'").first()
    assert (first.median, first.trimmed_mean, first.hard) == (8.0, 8.0, ["FABRICATION"])
    weights = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "dimension string, weight double")
    episode = tqa.episodes(scores, weights).first()
    assert (episode.score, episode.hard_count, episode.sample_count, episode.status) == (6.0, 1, 1, "FAIL")
    assert tqa.sample_display(scores, weights).first().lowest == 4.0
    assert tqa.divergence(tqa.ledger(df)).first().spread == 7


def test_runs(spark):
    source = spark.createDataFrame([("e", i, t) for i, t in enumerate(["First", "Second", "Third", "Second"])], "episode_id string, pos int, text string")
    wanted = spark.createDataFrame([("e", 0, "Second"), ("e", 1, "Third")], "episode_id string, pos int, text string")
    assert tuple(runs.find_window(source, wanted).first()) == ("e", 1, 1)
    table = spark.createDataFrame([(1, ["Hello you", "bye", "gone"], [("hello", 0.0, 0.5), ("bye", 1.0, 1.0)])], "k int, sentences array<string>, words array<struct<text:string,start_s:double,end_s:double>>")
    assert [(r.start_s, r.end_s) for r in runs.align_words(table, "k").orderBy("n").collect()] == [(0.0, 0.5), (1.0, 1.3), (None, None)]
