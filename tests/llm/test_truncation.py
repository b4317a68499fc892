"""Problem 9: cut texts."""

import random

import pandas as pd

from docloom.llm.endings import ending_features
from docloom.llm.truncation import find_truncated, fit_mixture, judge_endings, significant_lengths


def corpus():
    rng = random.Random(3)
    subjects, verbs = ["The pump", "Every valve", "A second boiler", "Without form 12 the crew"], ["is kept in the north hall", "shares one locker with the archive", "was moved before the spring outage", "must be inspected after every restart"]
    out, cut = [], set()
    for i in range(1500):
        text = "\n".join(" ".join(f"{rng.choice(subjects)} {rng.choice(verbs)} by team {rng.randint(1, 99)}." for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))
        source = "ab"[i % 2]
        end = rng.random()
        if source == "a" and len(text) > 200 and i % 3 == 0:
            text = text[:200]
            if not text.rstrip().endswith((".", "\n")) and text.split("\n")[-1]:
                cut.add(i)
        elif end < 0.1:
            text += "\n- pump 12\n- valve"
        elif end < 0.2:
            text += "\nKind regards"
        elif end < 0.3:
            text += "\nA-12 | 30 | north"
        out.append((i, text, source))
    return out, cut


def test_cut_texts(spark):
    rows, cut = corpus()
    extra = [(5000, None, "a"), (5001, "", "b"), (None, "The pump is", "a"), rows[0], (5002, "The pump is kept in the north hall by te", None), (5003, "The pump is kept in the no…", "b"), (5004, "The pump is kept in the north hall by team 3.\n" * 4000, "b")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, source string").selectExpr("*", "1 AS id", "'k' AS kind", "2 AS score")
    found = [r.id for r in find_truncated(df).collect()]
    assert len(found) == len(set(found))
    want = cut | {5002, 5003}
    assert len(set(found) & want) >= 0.97 * len(want)
    assert len(set(found) - want) <= 0.03 * len(want)
    assert find_truncated(df.limit(0)).count() == 0


def test_significant_lengths(spark):
    rng = random.Random(1)
    rows = [("a", "characters", int(rng.lognormvariate(5.4, 0.4))) for _ in range(3000)] + [("a", "characters", 255)] * 60 + [("b", "characters", int(rng.lognormvariate(5.4, 0.4))) for _ in range(3000)]
    found = {(r.source, r.length) for r in significant_lengths(spark.createDataFrame(rows, "source string, unit string, length int"), "source").collect()}
    assert ("a", 255) in found and len(found) <= 2


def test_rows_that_only_the_hazard_finds(spark):
    """Openings that are labels as often as sentences: alone they say little, at a significant length enough."""
    rng = random.Random(9)
    rows, limit, elsewhere, cut = [], set(), set(), set()
    for i in range(3000):
        words = " ".join(rng.choice(["north", "hall", "spring", "crew", "locker", "archive"]) for _ in range(rng.randint(4, 40)))
        subject = rng.choice(["The pump", "The valve", "The boiler"])
        kind = i % 10
        if kind < 3:
            text = f"{subject} {words}."
        elif kind < 7:
            text = f"{subject} {words}.\n" + "\n".join(f"{subject} list {rng.choice('abcdef')}" for _ in range(4))  # labels, complete without a stop
        else:
            text = f"{subject} {words} and {words} of {words}."
        source = "ab"[i % 2]
        if source == "a" and len(text) > 120:
            text = text[:120]
            cut.add(i)
            if not text.endswith(".") and "\n" not in text:
                limit.add(i)
        elif source == "b" and i % 200 == 1 and "\n" not in text:
            text = text[: len(text) // 2]
            elsewhere.add(i)
        rows.append((i, text, source))
    judged, _ = judge_endings(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    by_id = {r.id: r for r in judged.collect()}
    assert len(limit) > 100 and sum(by_id[i].posterior >= 0.5 for i in limit) >= 0.97 * len(limit)
    assert all(by_id[i].posterior < 0.5 for i in elsewhere)
    found = {r.id for r in find_truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(found - cut) <= 0.05 * len(found)


def test_mixture_without_a_significant_length_keeps_the_scores():
    table = pd.DataFrame({"kind": ["fragment", "terminal"], "level": [7, 0], "marked": [False, False], "excess": [0, 0], "n": [10, 1000]})
    assert fit_mixture(table)["posterior"].tolist() == [0.7, 0.0]
    assert fit_mixture(table.iloc[:0])["posterior"].tolist() == []


def test_long_omissions_are_read_whole(spark):
    texts = [(1, "The pump is kept in the no" + " " * 3000 + "…", "a"), (2, "The pump is kept in the no [ ... ]", "a"), (3, "Done.", "a")]
    rows = {r.id: r for r in ending_features(spark.createDataFrame(texts, "doc_id int, text string, source string"), "doc_id", "text").collect()}
    assert rows[1].marked and rows[1].body_chars == 26 and rows[2].marked and rows[2].body_chars == 26 and not rows[3].marked
