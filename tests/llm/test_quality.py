import numpy as np

from cuemill.llm.measures import document_words, measure, word_hash
from cuemill.llm.quality import _VOTES, KINDS, common_words, function_weights, learn, text_kinds

PROSE = "The old house stood near the river, and nobody had lived there for many years. We walked there every evening."
TEXTS = {
    "prose": [PROSE, PROSE.replace("river", "station"), "- We walked near the old river every evening.\n- Nobody had lived there for many years.", PROSE.lower().replace(".", "").replace(",", "")],
    "list": ["- house\n- river\n- old station\n- evening", "1. river\n2. house\n3. station", "Credits\n\n* [x] house 7;\n* [ ] river 3\n* [x] station 9."],
    "table": ["| a | b |\n|---|---|\n| house | 3 |\n| river | 4 |\n| station | 5 |", "house\t3\t4\nriver\t5\t6\nstation\t1\t2", "house,3,4,5\nriver,4,5,6\nold,1,2,3"],
    "junk": ['<div class="a"><span style="w:1"></span></div>\n<div class="b"></div>', "x+1ar2P1X0fM0VhHW/u8VcfbeDcsK/KZRdSOa7kNbEGInAFitxCA8tzWQQrf7", "]{@?/&?}+~& /??/)]) &)][/*& ##[}~#~**[^[&|_", "Subscribe! " * 60],
}


NONE = np.zeros(0, np.int64)


def test_statistics_of_nothing():
    docs, blocks = measure(["", " \n\t", "!", "a\r\nb\n \nc"], NONE)
    assert all(np.isfinite(v).all() for v in docs.values()) and list(blocks["doc"]) == [2, 3, 3]
    assert list(docs["n_words"]) == [0, 0, 1, 3] and list(docs["n_lines"]) == [0, 0, 1, 3]


def test_words():
    word, doc = document_words(["Ab cde CDE 中文 12 <b class=x>", "cde", "바이올린을", "바이올린"])
    found = [set(word[doc == i]) for i in range(4)]
    assert found[0] == {word_hash("cde"), word_hash("中"), word_hash("文")} and found[1] < found[0] and found[2] == found[3] == {word_hash("바이")}


def test_marks_before_blanks_and_closers():
    texts = [f"It was late.{end}\nNo mark here{end}" for end in ("", " " * 40, "\u3000\t" * 9, ")" * 20, "”) ")]
    assert list(measure(texts, NONE)[0]["end_punctuation"]) == [0.5] * len(texts)


def test_measures_stay_apart():
    """A text measures the same alone and among others."""
    texts = [t for k in TEXTS for t in TEXTS[k]] + ["", "- a\n- b\n\nfoo,bar,baz\nx,y,z", "&amp; <a href=1>q</a> 5 < 6 > 4", "x" * 300]
    docs, blocks = measure(texts, NONE)
    for i, text in enumerate(texts):
        alone, parts = measure([text], NONE)
        assert all(alone[k][0] == docs[k][i] for k in docs), text
        assert all(np.allclose(parts[k], blocks[k][blocks["doc"] == i]) for k in parts if k != "doc"), text


def planted(rnd, n=4000, own_rate=0.7, other_rate=0.06, votes=_VOTES):
    kinds = rnd.integers(0, 4, n)
    return kinds, rnd.random((n, len(votes))) < np.where(votes[None, :] == kinds[:, None], own_rate, other_rate)


def fitted(fires, votes=_VOTES):
    patterns, inverse, counts = np.unique(fires @ (1 << np.arange(len(votes))), return_inverse=True, return_counts=True)
    return learn(patterns, counts, votes), inverse


def test_em_separates_planted_kinds():
    kinds, fires = planted(np.random.default_rng(0))
    learned, inverse = fitted(fires)
    assert (learned.posterior[inverse].argmax(1) == kinds).mean() > 0.95
    assert abs(learned.fires[:, 0].mean() - 0.7) < 0.05 and abs(learned.fires[:, 1].mean() - 0.06) < 0.02


def test_a_bad_function_loses_its_weight():
    """One function per kind fires at random, two are sound; plain votes err where the bad ones fire."""
    votes = np.array([0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3])
    rnd = np.random.default_rng(3)
    kinds, fires = planted(rnd, 8000, 0.75, 0.02, votes)
    for bad in (0, 3, 6, 9):
        fires[:, bad] = rnd.random(len(kinds)) < 0.5
    learned, inverse = fitted(fires, votes)
    weight = np.log(learned.fires[:, 0] / learned.fires[:, 1])
    assert (weight[[0, 3, 6, 9]] < 0.6).all() and (weight[[1, 2, 4, 5, 7, 8, 10, 11]] > 2).all()
    by_votes = (fires.astype(int) @ np.eye(4)[votes]).argmax(1)
    assert (learned.posterior[inverse].argmax(1) == kinds).mean() > (by_votes == kinds).mean() + 0.08


def test_the_weight_of_related_votes_is_damped():
    """Five copies of one function count about as one."""
    rnd = np.random.default_rng(5)
    votes = np.array([0] * 5 + [1, 1, 1])
    kinds = rnd.integers(0, 2, 6000)
    one = rnd.random(6000) < np.where(kinds == 0, 0.7, 0.2)
    others = rnd.random((6000, 3)) < np.where(kinds[:, None] == 1, 0.7, 0.1)
    fires = np.hstack([np.repeat(one[:, None], 5, 1), others])
    patterns, inverse, counts = np.unique(fires @ (1 << np.arange(8)), return_inverse=True, return_counts=True)
    learned = learn(patterns, counts, votes, 2)
    assert learned.damping[0] < learned.damping[1]


def test_em_decides_against_most_votes():
    patterns = np.array([0b000111, 0b111000, 0b001011, 0b000001, 0b000011])
    votes = np.array([0, 0, 0, 1, 1, 1])
    learned = learn(patterns, np.array([500, 500, 40, 300, 300]), votes, 2)
    assert np.isfinite(learned.posterior).all() and learned.posterior[0, 0] > 0.9 and learned.posterior[1, 1] > 0.9


def test_table(spark):
    rows = [(i * 100 + j, t, "x") for i, k in enumerate(KINDS) for j in range(8) for t in [TEXTS[k][j % len(TEXTS[k])]]]
    rows += [(900, None, "x"), (901, " \n ", None), (902, PROSE + "\n\n" + "- house\n- river", "x"), (903, "word " * 30000, "x")]
    df = spark.createDataFrame(rows, "doc int, text string, kind string")
    got = {r.doc: r.kind for r in text_kinds(df, "doc", "text").collect()}
    assert got[900] is None and got[901] is None and got[902] == "prose" and got[903] == "junk"
    wrong = [(TEXTS[k][j % len(TEXTS[k])][:40], got[i * 100 + j]) for i, k in enumerate(KINDS) for j in range(8) if got[i * 100 + j] != k]
    right = sum(got[i * 100 + j] == k for i, k in enumerate(KINDS) for j in range(8))
    assert right >= 30, wrong
    assert text_kinds(df.limit(0), "doc", "text").count() == 0
    assert function_weights(df, "doc", "text").count() == function_weights(df.limit(0), "doc", "text").count() == 27


def test_common_words_are_alike_at_every_size(spark):
    """Rare noise grows with the documents, but is no larger share of them."""
    texts = [f"the old house river{i % 7} noise{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(4000)]
    found = [common_words(spark.createDataFrame([(t,) for t in [*texts[:n], None, " "]], "text string"), "text") for n in (400, 1200, 4000)]
    assert all(set(f) == {word_hash(w) for w in ("the", "old", "house", "river")} for f in found)
