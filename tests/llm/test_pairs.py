import json

import numpy as np

from cuemill.llm.answers import blank, openings, plain, read_answer
from cuemill.llm.language import Languages
from cuemill.llm.pairs import prompt_slots, band_hashes, clusters, find_defects, refusal_templates, shingles

SCHEMA = "result_id bigint, target_lang string, instructions string, input_map map<string,string>, raw_text string, status string, incomplete_reason string, created_at timestamp, id string, defect string"
EN = ["The train leaves before dawn.", "We need the old map this winter.", "Nobody will remember the letter.", "My sister keeps the lamp under the bed."]
FR = ["Le train part avant l'aube.", "Il nous faut la vieille carte cet hiver.", "Personne ne se souviendra de la lettre.", "Ma sœur garde la lampe sous son lit."]
DE = ["Der Zug fährt vor Tagesanbruch.", "Wir brauchen die alte Karte diesen Winter.", "Niemand wird sich an den Brief erinnern.", "Meine Schwester bewahrt die Lampe unter dem Bett auf."]
NO = "I must decline to translate this material because of its nature."


def answer(trs, n=0):
    return json.dumps({str(i): {"src": EN[(i + n) % 4], "tr": t} for i, t in enumerate(trs)}, ensure_ascii=False)


def test_reading():
    whole = read_answer('```json\n{7": {"src": "a", "tr": "b"}}\n```')
    assert [e.key for e in whole.entries] == ["7"] and not whole.cut
    cut = read_answer('{"1": {"src": "a", "tr": "b"}, "2": {"src": "c", "tr": "d e')
    assert [(e.key, e.tr, e.whole) for e in cut.entries] == [("1", "b", True), ("2", "d e", False)] and cut.cut
    assert not read_answer('{"1": {"src": "a", "tr": "b"}').cut
    for nothing in (None, "", "[]", "null", '""'):
        assert read_answer(nothing) == ([], [], False)
    assert read_answer("No.").said == ["No."]


IT = ["Il treno parte prima dell'alba.", "Quest'inverno ci serve la vecchia mappa.", "Nessuno si ricorderà della lettera.", "Mia sorella tiene la lampada sotto il letto."]
ES = ["El tren sale antes del amanecer.", "Necesitamos el mapa viejo este invierno.", "Nadie recordará la carta.", "Mi hermana guarda la lámpara debajo de la cama."]
AR = "القطار يغادر قبل الفجر ولن يتذكر أحد الرسالة"


def test_language_is_learned_from_the_labels():
    known = {"en": EN, "fr": FR, "de": DE, "es": ES, "zh": ["我妹妹还把灯放在床底下", "火车黎明之前开别迟到", "没人会记得那封信"], "ja": ["ペラは島で待っている", "手紙のことは誰も覚えていない"], "ru": ["Где письмо и кто его взял", "Поезд уходит до рассвета"]}
    other = Languages([(t, code) for code, texts in known.items() for t in texts for _ in range(12)]).other
    for code, texts in known.items():
        for target in known:
            assert [other(t, target) for t in texts] == [target != code] * len(texts), (code, target)
    assert all(other(t, "es") and other(t, "fr") for t in IT) and other(AR, "fr") and other(AR, "zh")
    assert other("Hm.", "fr") is None and other(IT[0], "it") is None
    also = Languages([(t, c) for c, texts in (("it", IT), ("es", ES)) for t in texts for _ in range(12)]).other
    assert not also(IT[0], "it") and also(IT[1], "es") and also(AR, "it")


def test_short_refusals_have_an_opening():
    assert openings("I can't.") == ["i can't."] and openings("No.") == ["no."] and openings("...") == openings("") == []
    assert openings("I'm sorry, but this is beyond me 12 times. It really is so.")[1] == "but this is beyond me # times"


def test_prompts_that_differ_in_a_letter_are_related():
    words = " ".join(f"word{i}" for i in range(60))
    slots = prompt_slots([words, words + "s", "quite another text about the sea and its ships", ""])
    assert (slots[0] != slots[1]).sum() <= 1 and (slots[0] != slots[2]).sum() >= 7


def test_near_equal_refusals_make_few_links(spark):
    """10,000 variants of one refusal: one cluster, and links that grow with the clauses, not with their pairs."""
    texts = [f"i must decline to translate the material of {a}{b}{c} because of its nature" for a in "abcdefghijklmnopqrstuvwxyz"[:22] for b in "abcdefghijklmnopqrstu" for c in "abcdefghijklmnopqrstuvwxyz"[:22]]
    df = spark.createDataFrame([(t,) for t in texts], "clause string").repartition(8)
    got = clusters(df, df.limit(5), salt_rows=3000)
    assert got.count() == len(texts) == 10164 and got.select("cluster").distinct().count() == 1


def test_clusters_are_verified(spark):
    same = "nobody will ever remember the letter that we left at the station"
    rows = [same, same + " then", same + " then we", "a wholly different sentence about boats", "a wholly different sentence about boat"]
    df = spark.createDataFrame([(t,) for t in rows], "clause string")
    got = {r.clause: r.cluster for r in clusters(df, df).collect()}
    assert got[rows[0]] == got[rows[1]] == got[rows[2]] != got[rows[3]] == got[rows[4]]
    assert clusters(df.limit(0), df.limit(0)).count() == 0
    a, b = band_hashes([same, same + "s"])
    assert (a == b).any() and band_hashes(["x"]).shape == (1, 20) and (band_hashes([same]) == a).all()


def test_a_template_needs_unrelated_prompts(spark):
    schema = "prompt array<bigint>, bare boolean, openings array<string>"
    prompts = [[i * 100 + k for k in range(8)] for i in range(6)]
    rows = [(p, True, ["i cannot help with that text"]) for p in prompts] + [(prompts[0], True, ["this one prompt always gets the same reply"])] * 6
    rows += [(p, i == 0, ["here are the words you wanted"]) for i, p in enumerate(prompts)]
    assert {r.clause for r in refusal_templates(spark.createDataFrame(rows, schema)).collect()} == {"i cannot help with that text"}


def test_defects(spark):
    rows, expected = [], {}

    def add(defect, raw, n=2, target="fr", status="completed", reason=None, asks="Translate into French."):
        i = len(rows)
        rows.append((i, target, asks, {str(k): EN[(k + i) % 4] for k in range(n)}, raw, status, reason, None, "x", "y"))
        if defect:
            expected[i] = defect

    def good(i, n=2):
        return json.dumps({str(k): {"src": EN[(k + i) % 4], "tr": FR[(k + i) % 4]} for k in range(n)}, ensure_ascii=False)

    for _ in range(12):
        add(None, good(len(rows)))
    add(None, "Here is the translation:\n" + good(len(rows)))
    add(None, good(len(rows))[:-1], reason="length")
    for _ in range(3):
        add("refusal", NO)
    add("refusal", json.dumps({"0": {"src": EN[0], "tr": NO}, "1": {"src": EN[1], "tr": NO}}))
    add("refusal", good(len(rows)), status="refusal")
    add("empty", "")
    add("empty", None)
    add("empty", json.dumps({"0": {"src": EN[0], "tr": " "}, "1": {"src": EN[1], "tr": ""}}))
    add("truncated", good(len(rows))[:-20])
    add("truncated", json.dumps({"0": {"src": EN[0], "tr": FR[len(rows) % 4]}}, ensure_ascii=False))
    i = len(rows)
    add("copied", json.dumps({str(k): {"src": EN[(k + i) % 4], "tr": f"<i>{EN[(k + i) % 4].upper()}</i>"} for k in range(2)}))
    i = len(rows)
    add("wrong_language", json.dumps({str(k): {"src": EN[(k + i) % 4], "tr": DE[(k + i) % 4]} for k in range(2)}, ensure_ascii=False), target=None)
    rows.append((len(rows), None, None, None, None, None, None, None, None, None))
    expected[len(rows) - 1] = "empty"
    df = spark.createDataFrame(rows + rows[:5] + rows[14:16], SCHEMA)
    got = {r.result_id: r.defect for r in find_defects(df, "result_id").collect()}
    assert got == expected
    assert find_defects(df.limit(0), "result_id").count() == 0


def test_parts():
    assert plain("<i>Ｈello, World!</i>") == "helloworld" and openings("Yes, this is a long clause; no.") == ["this is a long clause"]
    assert plain("a" + "<" + "b" * 500 + ">") == "a" and blank(None) and blank(" \u3000\n") and not blank("…")
    assert len(shingles("abc")) == 1
