"""Problem 6: one form of text that looks the same."""

import pytest

from docloom.llm.lookalikes import SUSPECT, bigram_model, changed_forms, one_form, p6_forms, p6_found, restore, unify
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def model(spark):
    texts = ["the heading of the section and the report", "the excess voltage", "датчик и отчёт после смены", "Sicherheit und Prüfung"] * 20
    return bigram_model(spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string"), "t")


@pytest.mark.parametrize(
    "text, kind",
    [("ＡＢ１", "full_width"), ("ﬁlm", "full_width"), ("a b", "space"), ("a​b", "zero_width"), ("café", "combining"), ("hеading", "mixed"), ("see the ехсеѕѕ now", "look_alike")],
)
def test_kinds(text, kind, model):
    assert kind in one_form(text, model)[1]


@pytest.mark.parametrize("text", ["plain", "", "soft­hyphen", "x² ½ ª … ①", "датчик", "Ω and Δ and β", "tab\tand\nline", "é ü ß", "µm"])
def test_what_does_not_count(text, model):
    assert one_form(text, model)[1] == []


def test_restoration(model):
    assert restore("hеadіng", "L", model) == "heading"
    assert restore("дaтчик", "C", model) == "датчик"
    assert one_form("ｓｅｃｔｉｏｎ　of​", model)[0] == "section of"


def test_rows(spark, model):
    rows = [("a", None), ("b", ""), ("c", "plain"), ("d", "x y"), ("d", "x y"), (None, "z​z"), ("e", "еa" * 50_000)]
    df = spark.createDataFrame(rows, "k string, text string").selectExpr("*", "'f' AS form", "1 AS kinds")
    out = unify(df, ["k"], "text", model, only=F.col("text").rlike(SUSPECT)).collect()
    assert sorted((r.k or "", r.kinds) for r in out) == [("", ["zero_width"]), ("d", ["space"]), ("d", ["space"]), ("e", ["mixed"])]
    assert unify(df.limit(0), ["k"], "text", model).count() == 0


def test_every_changed_text_has_a_form(spark, model):
    rows = [("a", "wait… x² ½"), ("b", "soft\u00adhyphen"), ("c", "x\u00a0y…"), ("d", "plain"), ("e", "für датчик"), ("f", None)]
    out = changed_forms(spark.createDataFrame(rows, "k string, text string"), ["k"], model).collect()
    assert {r.k: r.form for r in out} == {"a": "wait... x2 1⁄2", "b": "softhyphen", "c": "x y..."}


def test_p6_forms_returns_them(spark, tmp_path):
    spark.createDataFrame([("e1", "wait…"), ("e2", "plain")], "element_id string, text string").write.parquet(f"{tmp_path}/elements.parquet")
    spark.createDataFrame([(1, "wait…"), (2, "x\u00a0y")], "evidence_id long, quote string").write.parquet(f"{tmp_path}/evidence.parquet")
    assert {tuple(r) for r in p6_forms(spark, str(tmp_path)).collect()} == {("elements", "e1", "wait..."), ("evidence", "1", "wait..."), ("evidence", "2", "x y")}
    assert {tuple(r) for r in p6_found(spark, str(tmp_path)).collect()} == {("evidence", "2")}


def test_planted_look_alikes_come_back(spark):
    import random

    from docloom.llm.lookalikes import TO_LATIN

    rng = random.Random(2)
    latin = ["the section heading covers every excess voltage of the copper pipe", "a second copy is kept in the archive beside the press", "sixteen people proposed an exact scope"]
    cyrillic = ["датчик и отчёт после смены", "проверка прибора перед сменой", "состав комиссии и расписание"]
    model = bigram_model(spark.createDataFrame([(t,) for t in (latin + cyrillic) * 20], "t string"), "t")
    other = {v: k for k, v in TO_LATIN.items() if "Ѐ" <= k}
    right = total = 0
    for text in (latin + cyrillic) * 20:
        table = other if text in latin else {k: v for k, v in TO_LATIN.items() if "Ѐ" <= k}
        planted = "".join(table[c] if c in table and rng.random() < 0.3 else c for c in text)
        if planted != text:
            total += 1
            right += one_form(planted, model)[0] == text
    assert total > 80 and right >= 0.97 * total


def test_words_of_look_alikes_only_follow_the_text(model):
    assert one_form("see the ехсеѕѕ now", model) == ("see the excess now", ["look_alike"])
    assert one_form("датчик и отчёт, а ехсеѕѕ", model)[1] == []
