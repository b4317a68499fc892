"""Problem 4: defects of prompt and response pairs."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from docloom.llm import pairs
from docloom.llm.pairs import DEFECTS, best_cutoff, find_defects, fit, language, plant

GOOD = ["The pump is kept in the north hall and the team inspects it after every restart.", "Without the form the cabinet cannot leave the archive area.", "The limit for the valve is 40 kg, measured at the bench."]
REFUSALS = ["I'm sorry, but I can't help with that request.", "As an AI model, I must decline to answer.", "Unfortunately, I am unable to answer this."]


def test_language():
    assert language("The pump is in the hall and it is not open")[0] == "en"
    assert language("Die Pumpe ist nicht in der Halle")[0] == "de"
    assert language("La bomba está en el almacén según la ficha")[0] == "es"
    assert language("Le relevé est dans la boîte à outils")[0] == "fr"
    assert language("AM-12 DE-7")[0] == "" and language("")[0] == ""


def test_label_model_prefers_agreeing_functions():
    votes = pd.DataFrame({"a": [1, 1, 0, -1], "b": [1, 0, 0, -1], "c": [1, 0, 0, -1], "n": [30, 40, 900, 30]})
    post = fit(votes).posterior(votes.drop(columns="n").to_numpy())
    assert post[0] >= 0.8 > post[1] > post[2]


def test_cutoffs_are_of_the_best_f1():
    posterior, bad = np.array([0.2, 0.6, 0.7, 0.9, 0.95]), np.array([False, False, True, True, True])
    cutoff = best_cutoff(posterior, np.ones(5), bad)
    assert 0.6 < cutoff <= 0.7
    assert 0.5 <= best_cutoff(posterior, np.ones(5), ~bad) <= 0.99


def test_planted_defects():
    answers = ["The pump is kept in the hall and the team inspects it there.", "Die Pumpe ist in der Halle und wird nicht von dem Prüfer nach der Schicht bewegt."]
    sample = pd.DataFrame([(f"Where is pump {i}?", "", answers[i % 2]) for i in range(70)], columns=["i", "c", "o"])
    planted = plant(sample)
    assert set(planted["planted"]) == {"", *DEFECTS}
    kept = planted[planted["planted"] == ""]
    assert set(kept["o"]) <= set(answers)
    cut = planted[planted["planted"] == "truncated"]["o"]
    assert all(any(a.startswith(o) and a != o for a in answers) for o in cut)
    assert all(language(o)[0] != language(answers[n % 2])[0] for n, o in planted[planted["planted"] == "other_language"][["id", "o"]].itertuples(index=False))


def test_rows(spark):
    question = "Explain how the team should move the pump described in form {}."
    rows = [(i, question.format(i), "The pump is in the hall. " * 3, GOOD[i % 3]) for i in range(200)]
    want = {}

    def add(answer, defect=None, instruction=None):
        n = 1000 + len(want) + len(rows)
        rows.append((n, instruction or question.format(n), "The pump is in the hall.", answer))
        if defect:
            want[n] = defect

    for x in (None, "", " \t\n", "​", "N/A", "none", "-", "...", "[]"):
        add(x, "empty")
    for x in REFUSALS:
        add(x, "refusal")
    add("I can't be opened by hand, says the label on the pump 7.")
    add("Sorry is the wrong word for notice 5; the team only needs to seal the pump again.")
    add(question.format(5), "copied_question", question.format(5))
    add("Question: " + question.format(6), "copied_question", question.format(6))
    add(" ".join([question.format(7)] * 2), "copied_question", question.format(7))
    add(question.format(8) + " " + GOOD[0], None, question.format(8))
    add("Das Prüflabor zählt die Anlage nicht am Monatsende und die Schicht ist offen.", "other_language")
    add("Das Prüflabor zählt die Anlage nicht am Monatsende und die Schicht ist offen.", None, "Answer in German: " + question.format(9))
    add("The pump is kept in the north hall and the team inspects it after every", "truncated")
    add("Without the form the cabinet cannot leave the archive area. The limit for the val", "truncated")
    add("40 kg")
    add("- pump A-1\n- valve\n- cabinet")
    rows += [rows[0], (None, "x", "y", None), (5000, None, None, GOOD[0]), (5001, "q " * 40_000, "c " * 40_000, GOOD[1])]
    df = spark.createDataFrame(rows, "record_id long, instruction string, context string, expected_output string").selectExpr("*", "'a' AS id", "1 AS kind", "'b' AS score")
    out = [(r.id, r.defect) for r in find_defects(df).collect()]
    assert len(out) == len(set(out))
    assert dict(out) == want
    assert find_defects(df.limit(0)).count() == 0


def test_planting_by_turns():
    sample = pd.DataFrame({"i": ["Where is it?"] * 3, "o": [GOOD[0], "No.", GOOD[0]]})
    planted = plant(sample, [3, 3, 7], ["en", "en", "en"])
    assert planted["planted"].tolist() == ["other_language", "", "empty"]
    assert planted["o"].tolist() == [None, "No.", "   "]


def test_cutoffs_are_validated_on_all_sound_pairs(spark, monkeypatch):
    n, late = 2_500, 2_300  # as many pairs as follow the first 2,000 by the hash of their id, and German ones only among the last
    german = ("Wo steht die Pumpe {} und wer prüft sie nach der Schicht?", "Die Pumpe {} ist in der Halle und wird nicht von dem Prüfer nach der Schicht bewegt.")
    english = ("Where is the pump {} and who checks it after the shift?", "The pump {} is kept in the hall and the team checks it after every restart of the line.")
    order = [r.id for r in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()]
    texts = {k: german if rank >= late else english for rank, k in enumerate(order)}
    rows = [(k, texts[k][0].format(k), "", texts[k][1].format(k)) for k in range(n)]
    rows += [rows[order[-1]]] * 3 + [(n, english[0].format(n), "", ""), (n + 1, english[0].format(n), "", "N/A")]
    df = spark.createDataFrame(rows, "record_id long, instruction string, context string, expected_output string")
    cutoffs, counts, filled = [], [], []
    validated, patterns, others = pairs.validated_cutoffs, pairs._patterns, pairs._in_other_languages
    monkeypatch.setattr(pairs, "validated_cutoffs", lambda *a: cutoffs.append(validated(*a)) or cutoffs[-1])
    monkeypatch.setattr(pairs, "_patterns", lambda voted, *by: counts.append(patterns(voted, *by)) or counts[-1])
    monkeypatch.setattr(pairs, "_in_other_languages", lambda *a: filled.append(others(*a)) or filled[-1])
    assert {r.id: r.defect for r in find_defects(df).collect()} == {n: "empty", n + 1: "empty"}
    used = counts[1].groupby(["defect", "planted"])["n"].sum().unstack()
    assert set(used.columns) == {"", *DEFECTS} and (used.sum(axis=1) == n).all() and used.min().min() >= n // 10
    assert all(0.5 <= c <= 0.99 for c in cutoffs[0].values()) and cutoffs[0]["other_language"] != 0.8
    given = filled[0].collect()
    assert len({r.id for r in given}) == len(given) == used["other_language"].iloc[0]
    assert all((r.i, r.c) == rows[r.id][1:3] and r.o in {x[3] for x in rows} and {language(r.i)[0], language(r.o)[0]} == {"en", "de"} for r in given)
    assert len({r.o for r in given}) > 100  # not a few answers for all
    find_defects(df.repartition(7)).count()
    assert cutoffs[1] == cutoffs[0]
