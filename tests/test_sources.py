import pytest

from cuemill.pipeline import answers, stage_a, translate
from cuemill import provider
from cuemill.sources.side import read_csv_glossary, read_ledger, read_table_glossary, read_words, write_ledger
from cuemill.sources.srt import decode, parse_strict, parse_tolerant, read_files, strict_errors, to_srt
from cuemill.streaming.feeds import dropped_srt, ledger_stream, write_batches

SAMPLE = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nHello world\r\n\r\n2\r\n00:00:03.000 --> 00:00:04.000 X1:2\r\nLine A\r\nLine B\r\n\r\nnonsense\r\n\r\nx\n00:00:05,000 --> 00:00:06,000\nno number\n"


def test_tolerant(spark):
    df = spark.createDataFrame([("a", SAMPLE), ("b", ""), ("c", None)], "path string, text string")
    got = [tuple(r)[2:] for r in parse_tolerant(df).orderBy("path", "pos").collect()]
    assert got == [(1, 1000, 2000, "Hello world"), (2, 3000, 4000, "Line A\nLine B")]


def test_strict_keeps_blank_lines(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\nfirst\n\nstill first\n\n2\n00:00:03,000 --> 00:00:04,000\n\n\n3\n00:00:05,000 --> 00:00:06,000\n42\nlast\n"
    got = [(r.seq, r.text) for r in parse_strict(spark.createDataFrame([("a", text)], "path string, text string")).orderBy("pos").collect()]
    assert got == [(1, "first\n\nstill first"), (3, "42\nlast")]


def test_round_trip_through_files(spark, tmp_path):
    cues = spark.createDataFrame([("e", 0, 1000, 2000, "你好"), ("e", 1, 3000, 4500, "a\nb")], "episode_id string, id int, start_ms bigint, end_ms bigint, text string")
    srt = to_srt(cues).first().srt
    (tmp_path / "a.srt").write_bytes(srt.encode("gb18030"))
    (tmp_path / "b.srt").write_bytes(srt.encode("utf-8-sig"))
    rows = parse_tolerant(read_files(spark, str(tmp_path))).orderBy("path", "pos").collect()
    assert [r.text for r in rows] == ["你好", "a\nb"] * 2 and rows[1].end_ms == 4500


def test_glossaries_and_words(spark, tmp_path):
    (tmp_path / "g.csv").write_text('﻿source,target,note\nred  coat,红外套,"a, b"\nred coat,other,\nkey,钥匙,\n', encoding="utf-8")
    assert {r.line for r in read_csv_glossary(spark, str(tmp_path / "g.csv")).collect()} == {"red coat = 红外套（a, b）", "key = 钥匙"}
    (tmp_path / "bad.csv").write_text("source,note\n", encoding="utf-8")
    with pytest.raises(ValueError):
        read_csv_glossary(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "g.md").write_text("# x\n| 中文译名 | 法文/英文原名 |\n|---|:-:|\n| 伊尔 | Ilska (girl)/Il |\n| x | 中文 |\n| 二 | Il |\n| 空 | |\n| one |\n", encoding="utf-8")
    assert [r.line for r in read_table_glossary(spark, str(tmp_path / "g.md")).orderBy("pos").collect()] == ["Ilska = 伊尔", "Ilska (girl) = 伊尔", "Il = 伊尔"]
    (tmp_path / "w.json").write_text('[{"text": "a", "start": 12000, "end": "x"}, {"text": "b", "start": 1.5, "end": 2}]')
    assert [(r.start_s, r.end_s) for r in read_words(spark, str(tmp_path / "w.json")).orderBy("pos").collect()] == [(12.0, 0.0), (1.5, 2.0)]


def test_usage_and_cues(spark):
    from cuemill.operators.responses import usage
    from cuemill.sources.srt import as_cues

    bodies = ['{"prompt_tokens": 3, "completion_tokens": 4, "completion_tokens_details": {"reasoning_tokens": 1}, "total_tokens": 7}', '{"input_tokens": 2, "output_tokens": "x"}', "{broken", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    assert [tuple(r)[1:] for r in df.select("i", *[c.alias(k) for k, c in usage(df.b).items()]).orderBy("i").collect()] == [(3, 4, 1, 7), (2, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    files = spark.createDataFrame([("a", "7\n00:00:01,000 --> 00:00:02,000\nx\n\n9\n00:00:03,000 --> 00:00:04,000\ny\n")], "path string, text string")
    assert [(r.episode_id, r.id, r.seq, r.text) for r in as_cues(parse_strict(files)).orderBy("id").collect()] == [("a", 0, 7, "x"), ("a", 1, 9, "y")]


def test_strict_errors(spark):
    good = "1\n00:00:01,000 --> 00:00:02,000\nfirst  \nsecond\n"
    files = spark.createDataFrame([("a", good), ("b", "\n\noops\n" + good), ("c", "7"), ("d", None), ("e", "")], "path string, text string")
    assert {tuple(r) for r in strict_errors(files).collect()} == {("b", 3, "oops"), ("c", 1, "7")}
    assert {(r.path, r.text) for r in parse_strict(files, fail=False).collect()} == {("a", "first\nsecond"), ("b", "first\nsecond")}
    with pytest.raises(Exception, match="no cue in b at line 3: oops"):
        parse_strict(files.where("path = 'b'")).collect()


def test_decoding():
    assert decode("é".encode("cp1252") + b"t", detect=lambda _: "cp1252") == ("ét", "cp1252")
    assert decode(b"\xef\xbb\xbfab", detect=lambda _: "cp1252") == ("ab", "utf-8-sig")
    assert decode("中".encode("gb18030")) == ("中", "gb18030") and decode(b"ab", "no-such-name")[0] == "ab"


def test_ledger_round_trip(spark, tmp_path):
    row = {"anonymous_id": "a", "candidate_id": "c", "sample_id": "s", "dimension": "d", "evaluator_run_id": "r", "score": 7, "hard_failures": [], "rationale": "ü", "confidence": 0.5, "scored_by": "evaluator",
           "refusal_detected": False, "raw_response_hash": "h", "raw_response_path": None, "valid": True, "retry_index": 0, "run_index": 0}
    from cuemill.sources.side import LEDGER

    path = str(tmp_path / "ledger")
    for _ in range(2):
        write_ledger(spark.createDataFrame([row], LEDGER), path)
    assert [r.asDict() for r in read_ledger(spark, path).collect()] == [row]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text("{broken")
    with pytest.raises(Exception):
        read_ledger(spark, str(tmp_path / "bad")).collect()


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.srt").write_text(SAMPLE)
    seen = []
    write_batches(dropped_srt(spark, str(tmp_path / "in")), str(tmp_path / "c1"), lambda df, _: seen.extend(df.collect())).awaitTermination(60)
    assert len(seen) == 2
    rows = spark.sql("SELECT * FROM VALUES ('r1', 0, TIMESTAMP'2024-01-01'), ('r1', 0, TIMESTAMP'2024-01-02'), ('r2', 0, TIMESTAMP'2024-01-01') AS t(evaluator_run_id, retry_index, scored_at)")
    rows.write.parquet(str(tmp_path / "p"))
    once = []
    stream = ledger_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "p")))
    write_batches(stream, str(tmp_path / "c2"), lambda df, _: once.extend(df.collect())).awaitTermination(60)
    assert sorted(r.evaluator_run_id for r in once) == ["r1", "r2"]


def test_run_with_stub(spark):
    cues = spark.createDataFrame([("e", i, i * 1000, i * 1000 + 1500, f"Line {i}." if i != 3 else " ") for i in range(12)], "episode_id string, id int, start_ms bigint, end_ms bigint, text string")
    prepared = stage_a(cues, overlap="auto")
    assert prepared.count() == 11 and prepared.where("id = 0").first().end_ms == 1000
    called = translate(prepared, "into de", size=5)
    assert called.count() == 3
    assert list(called.where("batch_index = 2").first().input_map) == ["10"]
    assert {r.tr for r in answers(called).collect()} == {f"[de] Line {i}." for i in range(12) if i != 3}
    assert translate(prepared, "into de", size=5, done=called.where("batch_index = 1")).count() == 2
