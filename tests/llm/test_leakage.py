"""Problem 7: leaks against brute force."""

import random
import re

from docloom.llm.leakage import find_leaks, find_near_passages, positional_index
from docloom.session import cut_lineage


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(text, n):
    words = words_of(text)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def corpus(rng):
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(3, 25)))) for i in range(12)]
    docs = []
    for d in range(60):
        text = " ".join(rng.choices(vocab, k=20))
        if d % 3 == 0:
            words = items[d % 12][1].split()
            cut = rng.randint(0, max(0, len(words) - 8))
            text += " — " + ", ".join(words[cut : cut + rng.randint(4, 14)]) + "! " + text[:30]
        docs.append((d, text))
    return docs + [(100, None), (101, ""), (None, items[0][1]), (3, docs[3][1])], items


def longest(doc, item):
    best = 0
    for a in range(len(doc)):
        for b in range(len(item)):
            n = 0
            while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n]:
                n += 1
            best = max(best, n)
    return best


def ordered(doc, window, at, slack):
    """Most words of the window in order in the document, each within ``slack`` of its place."""
    best = [0] * (len(doc) + 1)
    for j, w in enumerate(window):
        fresh = best[:]
        for p in range(max(0, at + j - slack), min(len(doc), at + j + slack + 1)):
            if doc[p] == w:
                fresh[p + 1] = max(fresh[p + 1], best[p] + 1)
        for p in range(1, len(fresh)):
            fresh[p] = max(fresh[p], fresh[p - 1])
        best = fresh
    return best[-1]


def test_against_brute_force(spark):
    docs, items = corpus(random.Random(5))
    expected = {(d, i): longest(words_of(t), words_of(u)) for d, t in docs if d is not None for i, u in items if grams(t, 6) & grams(u, 6)}
    a = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "1 AS pos", "'t' AS term", "2 AS item_id")
    b = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 AS doc_id", "'x' AS words")
    got = {(r.doc_id, r.item_id): r.words for r in find_leaks(a, b, run=6).collect()}
    assert got == expected


def test_near_passages_against_brute_force(spark):
    docs, items = corpus(random.Random(6))
    span, least, slack = 6, 5, 2
    expected = {}
    for d, t in docs:
        for i, u in items:
            doc, item = words_of(t), words_of(u)
            tries = [ordered(doc, item[s : s + span], at, slack) for s in range(len(item) - span + 1) for at in range(-span - slack, len(doc) + slack)]
            if d is not None and doc and max(tries, default=0) >= least:
                expected[d, i] = max(tries)
    a = spark.createDataFrame(docs, "doc_id int, text string")
    b = spark.createDataFrame(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in find_near_passages(a, b, span=span, share=least / span, slack=slack).collect()}
    assert len(expected) > 20 and got == expected


def test_a_stored_index_answers_several_searches(spark):
    docs, items = corpus(random.Random(7))
    a = spark.createDataFrame([(f"d{d}", t) for d, t in docs], "k string, body string")
    b = spark.createDataFrame(items, "item_id int, text string")
    index = cut_lineage(positional_index(a, "k", "body"))
    for run in (5, 6):
        one = sorted(find_leaks(a, b, "k", "body", run=run, index=index).collect())
        assert one and one == sorted(find_leaks(a, b, "k", "body", run=run).collect())


def test_no_match_crosses_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id int, text string").coalesce(1)
    items = spark.createDataFrame([(7, "a b c d e f")], "item_id int, text string")
    assert find_leaks(docs, items, run=4).count() == 0 and find_leaks(docs, items, run=3).count() == 2
    assert find_near_passages(docs, items, span=6, share=0.6).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    assert find_leaks(docs, none).count() == 0
    assert find_leaks(docs.limit(0), spark.createDataFrame([(1, None)], "item_id int, text string")).count() == 0
    assert find_leaks(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id int, text string"), run=2).count() == 0


def test_near_passages_bridge_small_edits(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, "zero " + item.replace("seven", "changed") + " end"), (2, "nothing of it one"), (3, " ".join(reversed(item.split())))], "doc_id int, text string")
    items = spark.createDataFrame([(7, item)], "item_id int, text string")
    assert find_leaks(docs, items).count() == 0
    assert [(r.doc_id, r.item_id, r.matched) for r in find_near_passages(docs, items).collect()] == [(1, 7, 12)]


def test_repeated_words_need_repeated_words(spark):
    item = "zulu alpha zulu alpha one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, "zulu alpha one two three four five six seven eight nine"), (2, item)], "doc_id int, text string")
    found = {r.doc_id: r.matched for r in find_near_passages(docs, spark.createDataFrame([(7, item)], "item_id int, text string")).collect()}
    assert found == {1: 11, 2: 13}
