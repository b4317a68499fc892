"""Problem 1: noise of scanned pages."""

import pytest

from docloom.llm import scans
from docloom.llm.scans import corrections, find_divided, find_furniture, find_misread, misread_words, repair_pages, word_counts

SCHEMA = "doc_id string, element_id string, element_type string, text string, ord int, page_number int"
BODY = "The records clerk transfers the external manifold before each shift. The safety lead hasn’t approved the high-pressure cabinet."


def upload(doc, pages=6):
    rows, n = [], 0

    def add(kind, text, page):
        nonlocal n
        rows.append((doc, f"{doc}{n}", kind, text, n, page))
        n += 1

    add("heading", "Shared Checklist Procedure", 1)
    add("heading", "Hydraulic manifold:", 1)
    for page in range(1, pages + 1):
        if page > 1:
            add("text" if page % 2 else "heading", "SHARED CHECKLIST PROCEDURE" if page % 4 else "Shared Checkl1st Procedure", page)
        add("paragraph", BODY.replace("manifold before", "mani-\nfold before").replace("high-pressure", "high-\npressure"), page)
        add("text", "95 kg" if page == 3 else "4,122", page)
        add("text", f"- {page} -", page)
    return rows


@pytest.fixture(scope="module")
def elements(spark):
    rows = upload("u") + upload("v")
    rows += [("u", "m1", "paragraph", "The rccords clerk transfers the external rnanifold.", 90, 7), ("u", "t1", "table", "rccords | x", 91, 7)]
    rows += [("w", f"w{i}", "paragraph", BODY, i, None) for i in range(60)]
    rows += [("x", None, None, None, None, None), ("u", "n1", "paragraph", None, 92, 8), ("u", "n2", "paragraph", "", 93, 8), ("u", "u0", "heading", "Shared Checklist Procedure", 0, 1), ("y", "long", "paragraph", "Plain words. " * 50_000, 0, 1)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'e' AS edge", "'w' AS word", "1 AS page")


def test_furniture(elements):
    found = {r.element_id for r in find_furniture(elements.drop("page")).collect()}
    headers = {r.element_id for r in elements.where("upper(text) LIKE 'SHARED CHECKL%' AND ord > 0").collect()}
    numbers = {r.element_id for r in elements.where("text LIKE '- % -'").collect()}
    assert found == headers | numbers


def test_divided(elements):
    clean = elements.drop("page")
    found = {(r.left, r.right) for r in find_divided(clean, word_counts(clean)).collect()}
    assert found == {("mani", "fold")}


def test_misread(elements):
    clean = elements.drop("page")
    counts = word_counts(clean)
    assert {r.word for r in misread_words(counts).collect()} >= {"rccords", "rnanifold"}
    found = {(r.element_id, r.word, r.correction) for r in find_misread(clean, counts, find_furniture(clean)).collect()}
    assert found == {("m1", "rccords", "records"), ("m1", "rnanifold", "manifold")}


def test_corrections_undo_one_error():
    assert "records" in corrections("rccords") and "modular" in corrections("moclular") and "section" in corrections("secti0n")
    assert "TABLE" in corrections("TABLF") and corrections("") == []


def test_repair(elements):
    out = {r.element_id: r.text for r in repair_pages(elements.drop("page")).collect()}
    assert out["m1"] == "The records clerk transfers the external manifold."
    assert any("external manifold before each shift" in t and "high-pressure" in t for t in out.values())
    assert not any(t.startswith(("- ", "SHARED")) for t in out.values())


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert find_furniture(none).count() == 0
    assert find_divided(none, word_counts(none)).count() == 0
    assert repair_pages(none).count() == 0


def test_paragraph_over_a_page_end(spark):
    rows = [("d", "a", "paragraph", "The clerk moves the cabinet and the", 0, 1), ("d", "b", "text", "- 1 -", 1, 1), ("d", "c", "paragraph", "valve before noon.", 2, 2), ("d", "e", "text", "- 2 -", 3, 2)]
    out = [(r.element_id, r.text) for r in repair_pages(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert out == [("a", "The clerk moves the cabinet and the valve before noon.")]


def test_furniture_on_a_line_inside_an_element(spark):
    title = "Shared Checklist Procedure"
    rows = [("d", "h", "heading", title, 0, 1)]
    for page in range(2, 7):
        rows += [("d", f"r{page}", "text", title, 10 * page, page), ("d", f"b{page}", "paragraph", f"The clerk moves the cabinet and\n– {page} –\nthe valve, says page\n{page}.", 10 * page + 1, page), ("d", f"c{page}", "paragraph", "All is well.", 10 * page + 2, page)]
    rows += [("d", "x", "paragraph", "The external mani-\n7\nfold is closed and\nShared Checklist Procedure\nlocked.", 71, 7), ("d", "y", "paragraph", "On that day 587 minutes were\n404\nlogged.", 72, 7), ("d", "z", "paragraph", "The manifold is shut.", 73, 7), ("d", "r7", "text", title, 70, 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.element_id, r.at) for r in find_furniture(df).collect()}
    assert found == {(f"r{p}", 0) for p in range(2, 8)} | {(f"b{p}", 1) for p in range(2, 7)} | {("x", 1), ("x", 3)}
    assert {(r.element_id, r.left, r.right) for r in find_divided(df, word_counts(df), find_furniture(df)).collect()} == {("x", "mani", "fold")}
    out = {r.element_id: r.text for r in repair_pages(df).collect()}
    assert out["b3"] == "The clerk moves the cabinet and the valve, says page 3." and out["x"] == "The external manifold is closed and locked."
    assert out["y"] == "On that day 587 minutes were 404 logged."


def test_misread_words_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows = [("d", "a", "paragraph", "A high- \nrccords clerk", 0, 1), ("d", "b", "paragraph", "the rccords rnanifold and rccords", 1, 1), ("d", "c", "paragraph", "man-\n rccords of it", 2, 1), ("d", "e", "paragraph", "x\x1crccords", 3, 1)]
    paged = spark.createDataFrame(rows, SCHEMA)
    wrong = spark.createDataFrame([("rccords", "records"), ("rnanifold", "manifold")], "word string, correction string")
    small = sorted(scans._misread_hits(paged, wrong).collect())
    monkeypatch.setattr(scans, "fits_broadcast", lambda df: False)
    assert small == sorted(scans._misread_hits(paged, wrong).collect())
    assert {(r.element_id, r.word) for r in small} == {("b", "rccords"), ("b", "rnanifold"), ("e", "rccords")}


def test_a_paragraph_over_four_pages(spark):
    texts = ["The clerk moves the cabi-", "net and the second valve of the", "old boiler to the high-pressure", "hall before noon."]
    rows = [("d", f"p{i}", "paragraph", t, 2 * i, i + 1) for i, t in enumerate(texts)] + [("d", f"n{i}", "text", f"- {i + 1} -", 2 * i + 1, i + 1) for i in range(4)]
    rows += [("w", f"w{i}", "paragraph", "The cabinet of the clerk.", i, None) for i in range(30)]
    out = [(r.element_id, r.text) for r in repair_pages(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert out == [("p0", "The clerk moves the cabinet and the second valve of the old boiler to the high-pressure hall before noon.")]


def test_a_lone_number_is_no_page_number(spark):
    rows = [("d", "a", "paragraph", "The count of that day was\n4", 0, 7), ("d", "b", "paragraph", "On the next one it was\n4", 1, 9), ("d", "c", "paragraph", "All is well.", 2, 9)]
    assert find_furniture(spark.createDataFrame(rows, SCHEMA)).count() == 0
    two = [("d", f"p{i}", "paragraph", f"The count of that day was\n{i - 3}", i, i) for i in (7, 8)]
    assert {r.element_id for r in find_furniture(spark.createDataFrame(two, SCHEMA)).collect()} == {"p7", "p8"}


def test_running_lines_repeat_fuzzily(spark):
    lines = {2: "Harbour Office Quarterly Notes", 3: "Harbour 0ffice Quartcrly Notes", 4: "Harbour Offixe Quarterly Notes", 5: "Plain words of the fifth page", 6: "Other words of the sixth page"}
    rows = [("d", f"t{p}", "text", line, 10 * p, p) for p, line in lines.items()] + [("d", f"b{p}", "paragraph", "All is well.", 10 * p + 1, p) for p in lines]
    assert {r.element_id for r in find_furniture(spark.createDataFrame(rows, SCHEMA)).collect()} == {"t2", "t3", "t4"}
