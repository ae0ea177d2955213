import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cuemill.llm.split import BOUNDARY, cut_text, split_oversized


def check(text, limit=200, overlap=20):
    pieces = cut_text(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e, _ in pieces) == text
    assert all(e - s <= limit and 0 <= c - s <= overlap for s, c, e, _ in pieces)
    run = longest = 0
    for ch in text:
        run = 0 if ch in BOUNDARY else run + 1
        longest = max(longest, run)
    assert any(f for *_, f in pieces) == (longest > limit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n.。，#-x中😀</>p&;1)", max_size=120), st.integers(5, 40))
def test_round_trip_and_force(text, limit):
    if len(text) > limit:
        check(text, limit, min(4, limit - 1))


def test_markup_is_no_force():
    """A cut before a tag is none inside an overlong run."""
    text = "<p>" + "word " * 30 + "end</p><div>" + "word " * 30 + "end</div><p>" + "word " * 30 + "</p>"
    pieces = cut_text(text)
    assert not any(f for *_, f in pieces) and [text[c:e][:3] for _, c, e, _ in pieces] == ["<p>", "<di", "<p>"]
    check(text)


def cores(text, limit=200, overlap=20):
    return [text[c:e] for _, c, e, _ in cut_text(text, limit, overlap)]


def test_sections_nest_by_level():
    text = "# A\n" + "one two. " * 12 + "\n## B\n" + "three four. " * 4 + "\n# C\n" + "five six. " * 4
    assert [c.split("\n")[0] for c in cores(text, 160)] == ["# A", "## B", "# C"] and "## B" not in cores(text, 120)[-1] and cores(text, 120)[-1].startswith("# C")
    assert [c[:4] for c in cores(text, 190)] == ["# A\n", "# C\n"] and cores("x " * 90 + "\n# Head\n" + "y " * 120)[1].startswith("# Head\ny")


def test_items_nest_by_indent():
    text = "- a\n  - b " + "w " * 60 + "\n  - c " + "v " * 50 + "\n- d " + "u " * 20
    assert [c.strip()[:3] for c in cores(text)] == ["- a", "- c", "- d"]


def test_tags_stay_paired():
    text = "<div><p>" + "word " * 30 + "</p><p>" + "other " * 20 + "</p></div><div>" + "x y " * 30 + "</div>"
    assert [(c[:8], c[-6:]) for c in cores(text)] == [("<div><p>", "d </p>"), ("<p>other", "</div>"), ("<div>x y", "</div>")]


def test_tail_of_an_opened_node_stands_alone():
    text = "a " * 100 + "tail.\n\nNext one. And more of it."
    assert cores(text)[-1] == "Next one. And more of it."


def test_deep_and_odd_structures():
    for text in ("<div>" * 3000 + "x" + "</div>" * 3000, "<p>" * 3000, "</p>" * 3000, "- a\n" * 5000, "# x\n" * 5000, "<" * 5000, "\n" * 5000, "".join(" " * i + "- a\n" for i in range(300))):
        check(text)


def test_long_texts():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdef") for _ in range(rnd.randrange(1, 12))) for _ in range(20000)]
    check(" ".join(words))
    check("word " * 39 + "x" * 195 + " end")
    check("y" * 100_000)


def test_headings_and_items_come_first():
    text = "# One\n" + "alpha beta. " * 10 + "\n\n# Two\n" + "- item one, long\n" * 8
    cores = [text[c:e] for _, c, e, _ in cut_text(text)]
    assert any(c.startswith("# Two") for c in cores)


def test_table(spark):
    rows = [(1, "a" * 201, "x"), (1, "a" * 201, "y"), (2, "ab " * 80, None), (3, None, None), (4, "", None), (5, "short", None)]
    df = spark.createDataFrame(rows, "k int, t string, piece string")
    got = split_oversized(df, ["k"], "t").collect()
    cuts = {(r.k, r.cut) for r in got}
    assert cuts == {(1, "forced"), (2, "natural"), (3, None), (4, None), (5, None)}
    assert sum(r.k == 1 for r in got) == 2
    assert split_oversized(df.limit(0), ["k"], "t").count() == 0
