from cuemill.llm.encodings import byte_pairs, forms, read_as, residues, script, wide_forms, write_as
from cuemill.llm.garbled import find_garbled

CLEAN = {
    "latin": "Le café près de la forêt était fermé",
    "cyrillic": "Слушай внимательно ночью было темно",
    "hangul": "매일 밤 바다 꿈을 꿔",
    "cjk": "我们明天需要银盒子，不然就完了。",
}


def test_forms_of_words():
    assert forms("café", "latin")["cafÃ©"] == "utf-8>cp1252"
    assert forms("don’t", "latin")["donвЂ™t"] == "utf-8>cp1251"
    assert "锟斤拷" in residues() and "ï¿½" in residues()
    assert script("cafÃ©") != "latin" and script("кафе") == "cyrillic" and script("x\x81") is None
    assert read_as(write_as("é", "utf-8"), "cp1252") == "Ã©"
    assert wide_forms("Hé") == {"H\0é": "utf-16>latin-1"} and byte_pairs("水")["?e"] == "iso2022_jp>ascii"
    assert script("Г\xa0") is None
    assert forms("caf\u00e9", "latin", deep=True)[read_as(read_as("café".encode(), "cp1252").encode(), "cp1251")] == "utf-8>cp1252>utf-8>cp1251"


def test_planted_cases(spark):
    chains = {"latin": [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("cp1252", "mac_roman"), ("cp1252", "utf-8")], "cyrillic": [("utf-8", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1251")],
              "hangul": [("utf-8", "cp1252"), ("cp949", "cp1252"), ("cp949", "gb18030")], "cjk": [("utf-8", "cp1252"), ("gb18030", "cp1252"), ("utf-8", "gb18030"), ("gb18030", "big5")]}
    rows, expected, restored = [], set(), {}
    for kind, text in CLEAN.items():
        rows += [(f"{kind}{i}", 0, text, "x") for i in range(12)]
        for right, wrong in chains[kind]:
            form = read_as(write_as(text, right), wrong)
            key = f"{kind}:{right}>{wrong}"
            rows += [(key, 1, form, "x"), (key, 1, form, "y")]
            expected.add((key, 1))
            restored[key] = text
    rows += [("trap", i, t, None) for i, t in enumerate(["MAÇÃS — 3 € – ¥500", "½ DOSE • 30 °C", "«ВЕТЕР»", "", " ", None, "plain", "鍵盤 · 琴鍵", "🎵" * 5000])]
    df = spark.createDataFrame(rows, "ep string, id int, text string, restored string")
    got = find_garbled(df, ["ep", "id"], "text").collect()
    assert {(r.ep, r.id) for r in got} == expected
    assert len(got) == len(expected)
    left = {r.ep: (r.restored, restored[r.ep]) for r in got if r.restored != restored[r.ep]}
    assert all(a is None for a, _ in left.values()) and len(left) <= 3, left


def test_empty(spark):
    df = spark.createDataFrame([], "ep string, id int, text string")
    assert find_garbled(df, ["ep", "id"], "text").count() == 0


def garble(text, right, wrong):
    return read_as(write_as(text, right), wrong)


def test_rare_chains(spark):
    """UTF-16 read byte by byte, escapes taken for text, two wrong readings after each other."""
    base = [(f"c{i}", 0, t) for t in ("we walked along the old river", "水曜日の朝に駅で会いましょう", "près de la forêt") for i in range(9)]
    cases = {
        "wide": ("we walked along", "we walked along".encode("utf-16-le").decode("latin-1")),
        "escapes": (None, "水曜日の朝に".encode("iso2022_jp").decode("ascii")),
        "twice": ("près de la forêt", garble(garble("près de la forêt", "utf-8", "cp1252"), "utf-8", "cp1251")),
        "ascii": (None, "we walked along the old".encode().decode("utf-16-le", "replace")),
    }
    df = spark.createDataFrame(base + [(k, 1, t) for k, (_, t) in cases.items()] + [("none", 2, "tab\tand\x0bnothing else"), ("none", 3, "\x00"), ("none", 4, "x" * 5000)], "ep string, id int, text string")
    got = {r.ep: r.restored for r in find_garbled(df, ["ep", "id"], "text").collect()}
    assert set(got) == set(cases)
    assert all(got[k] == t for k, (t, _) in cases.items() if t)


def test_ascii_words_of_any_text_count(spark):
    """The plain words of a text count, whatever else stands in it."""
    rows = [(f"c{i}", 0, "we walked along the forêt") for i in range(5)] + [("wide", 1, "we walked along".encode("utf-16-le").decode("latin-1"))]
    got = find_garbled(spark.createDataFrame(rows, "ep string, id int, text string"), ["ep", "id"], "text").collect()
    assert [(r.ep, r.restored) for r in got] == [("wide", "we walked along")]


def test_long_words_and_runs(spark):
    """No word or run is too long to be looked up."""
    word = "Donaudampfschifffahrtsgesellschaftskapitänsmützenständerüberzugsfarbenprüfer"
    df = spark.createDataFrame([(f"a{i}", 0, f"der {word} kam") for i in range(5)] + [("b", 1, garble(f"der {word} kam", "utf-8", "cp1252"))], "ep string, id int, text string")
    assert [(r.ep, r.restored) for r in find_garbled(df, ["ep", "id"], "text").collect()] == [("b", f"der {word} kam")]


def test_lost_bytes_with_two_candidates_stay_lost(spark):
    rows = [(f"a{i}", 0, w) for i in range(6) for w in ("café", "cafè")] + [("b", 1, garble("café", "cp1252", "utf-8"))]
    got = find_garbled(spark.createDataFrame(rows, "ep string, id int, text string"), ["ep", "id"], "text").collect()
    assert [(r.ep, r.restored) for r in got] == [("b", None)]
