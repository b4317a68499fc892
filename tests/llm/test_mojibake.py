"""Problem 2: garbled text found and restored."""

import pytest

from docloom.llm.mojibake import best_path, candidates, fill_keys, find_garbled, fits, put_in_place, restored_texts

CLEAN = ["Die Prüfung der Anlage für den Gerätebuch", "La sección superó los 40 grados", "Le numéro désigne la clé d’accès", "Датчик и отчёт после смены", "The mark √ on form 5 and Â beside", "über dem Gerätebuch für Prüfung", "The ledger’s range is 30–98 °C"]


def garble(text, true, seen):
    return text.encode(true).decode(seen, "replace" if seen == "utf-8" else "strict")


@pytest.mark.parametrize("true, seen, word", [("utf-8", "cp1252", "Prüfung"), ("utf-8", "mac_roman", "sección"), ("utf-8", "cp1250", "numéro"), ("cp1252", "cp850", "sección"), ("cp1251", "cp1252", "отчёт"), ("utf-8", "cp1251", "смены")])
def test_candidates_contain_the_original(true, seen, word):
    assert word in [w for _, w, _ in candidates(garble(word, true, seen))]


def test_two_levels():
    twice = garble(garble("é", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert "é" in [w for _, w, _ in candidates(twice)]


def test_path_keeps_to_one_channel():
    words = [(0, "a", -5.0, [("x", "A", 2.0)]), (1, "b", 0.0, [("x", "B", 0.5), ("y", "Q", 1.0)]), (2, "c", -5.0, [("x", "C", 2.0)])]
    assert [w for _, _, w, _ in best_path(words)] == ["A", "B", "C"]


def test_rows(spark):
    rows = [(f"c{i}_{k}", t) for i, t in enumerate(CLEAN) for k in range(30)]
    bad = [
        ("g1", garble("Die Prüfung der Anlage für den Gerätebuch", "utf-8", "cp1252")),
        ("g2", "Ohne " + garble("Prüfung für", "cp1252", "cp850") + " weiter"),
        ("g3", garble("La sección superó", "cp1252", "utf-8")),
        ("g4", garble("The ledger’s range is 30–98 °C", "utf-8", "cp1252")),
    ]
    odd = [("n1", None), ("n2", ""), (None, bad[0][1]), ("g1", bad[0][1]), ("n3", "é" * 100_000), ("n4", "Â")]
    df = spark.createDataFrame(rows + bad + odd, "k string, text string").selectExpr("*", "1 AS pos", "'x' AS token", "'y' AS words")
    out = {r.k: {f.token: f.word for f in r.repairs} for r in find_garbled(df, ["k"], "text").collect()}
    assert set(out) == {"g1", "g2", "g3", "g4"}
    assert "Prüfung" in out["g1"].values() and "für" in out["g2"].values() and "sección" in out["g3"].values()
    assert find_garbled(df.limit(0), ["k"], "text").count() == 0


def test_what_is_left_of_a_sequence_bounds_what_was_lost():
    found = {c: (w, a) for c, w, a in candidates("ma\u00c5\ufffdy")}
    word, allowed = found["utf-8 as cp1252 x1"]
    assert word == "ma\ufffdy" and fits(word, allowed, "mały") and not fits(word, allowed, "maóy")
    keys = set(fill_keys("расписание", False))
    assert set(fill_keys("ра\ufffdпи\ufffdание", True)) <= keys and fill_keys("\ufffd\ufffd\ufffd", True) == []


def test_a_left_lead_byte_decides(spark):
    rows = [(f"a{i}", "Ten dom jest mały i nowy") for i in range(5)] + [(f"b{i}", "Ten dom jest maóy i nowy") for i in range(50)] + [("g", "Ten dom jest ma\u00c5\ufffdy i nowy")]
    out = {r.k: r.restored for r in restored_texts(spark.createDataFrame(rows, "k string, t string"), ["k"], "t").collect()}
    assert out == {"g": "Ten dom jest mały i nowy"}


def test_words_are_replaced_in_their_places():
    assert put_in_place("(é) «x» día, día! é", {2: "DÍA", 4: "e"}) == "(é) «x» DÍA, día! e"


def test_texts_of_one_key_stay_apart(spark):
    rows = [(f"c{i}", t) for i in range(30) for t in CLEAN] + [("g", "Ohne PrÃ¼fung weiter"), ("g", "Ganz ohne"), ("g", "Ohne PrÃ¼fung weiter")]
    df = spark.createDataFrame(rows, "k string, t string")
    assert [tuple(r) for r in restored_texts(df, ["k"], "t").collect()] == [("g", "Ohne Prüfung weiter")]


@pytest.mark.parametrize("true, seen, copies", [("utf-8", "cp1252", 20), ("utf-8", "mac_roman", 20), ("cp1252", "cp850", 5), ("cp1251", "cp1252", 20)])
def test_planted_texts_come_back_though_a_third_or_most_rows_are_garbled(spark, true, seen, copies):
    texts = ["Датчик и отчёт после смены", "Отчёт после смены и датчик"] if true == "cp1251" else CLEAN[:3] + CLEAN[5:6]
    rows = [(f"c{i}", t) for i in range(10) for t in texts]
    bad = {f"g{i}": t for i, t in enumerate(texts * copies)}
    df = spark.createDataFrame(rows + [(k, garble(t, true, seen)) for k, t in bad.items()], "k string, t string")
    out = {r.k: r.restored for r in restored_texts(df, ["k"], "t").collect()}
    assert out == bad
