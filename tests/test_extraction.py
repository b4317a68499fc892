"""Extraction, statistics and structure."""

import hashlib

from docloom.operators.extraction import distinct_elements, document_statistics, empty_extractions, extract_lines, label_kind, quoteable_text, structure_analysis, table_rows
from pyspark.sql import functions as F


def restated(doc, text):
    out, section = [], []
    for n, line in enumerate((text or "").splitlines(), 1):
        if line.strip():
            kind = "heading" if len(line) <= 100 and (line.isupper() or line.endswith(":")) else "paragraph"
            section = [line.strip()] if kind == "heading" else section
            out.append((doc, hashlib.sha256(f"{doc}:{n}:{kind}:None:{line}".encode()).hexdigest()[:20], kind, line, n, section))
    return out


def test_lines(spark):
    texts = {"a": "TITLE\n\nFirst line.\n  Notes:\nTitle: \n repeated\n repeated\n", "b": "", "c": None, "d": "x\x0b Y Z\r\nÄÖ:\n \t\n1234", "e": "A" * 101 + "\n" + "B" * 100, "f": "no heading"}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string").selectExpr("*", "1 AS ord", "'x' AS pos")
    got = [(r.doc_id, r.element_id, r.element_type, r.text, r.ord, r.section_path) for r in extract_lines(df).orderBy("doc_id", "ord").collect()]
    assert got == [row for d, t in texts.items() for row in restated(d, t)]
    assert extract_lines(df.limit(0)).count() == 0


def elements(spark):
    rows = [("d", "1", "heading", "TITLE", 1, 1, None), ("d", "2", "paragraph", "two words", 2, 3, None), ("d", "3", "table", None, 3, None, [["a", "b"], ["c"]]), ("d", "4", "text", "  ", 4, None, None), ("e", "5", "text", " ", 1, None, None), ("d", "2", "paragraph", "two words", 2, 3, None)]
    return spark.createDataFrame(rows, "doc_id string, element_id string, element_type string, text string, ord int, page_number int, table_rows array<array<string>>")


def test_statistics(spark):
    own = distinct_elements(elements(spark))
    (row,) = document_statistics(own).collect()
    assert (row.doc_id, row.page_count, row.character_count, row.word_count, row.element_count, row.heading_count, row.table_count, row.table_row_count, row.non_empty_element_count, row.quality) == ("d", 3, 14, 3, 4, 1, 1, 2, 3, "suspicious")
    assert len(row.warnings) == 1
    docs = spark.createDataFrame([("d",), ("e",), ("f",)], "doc_id string")
    assert {r.doc_id for r in empty_extractions(docs, own).collect()} == {"e", "f"}
    shape = structure_analysis(document_statistics(own)).first()
    assert shape.section_count == 1 and shape.structure_summary == "Structured content detected"


def test_tables_and_labels(spark):
    own = elements(spark).where("element_id = '3'").select(quoteable_text().alias("q")).first()
    assert own.q == "a | b\nc"
    row = spark.range(1).select(table_rows(F.lit("a | b\n\n c|d ")), *[label_kind(F.lit(x)) for x in ("section_header", "page_list", "table_caption", "code", "paragraph", "footnote", None)]).first()
    assert row[0] == [["a", "b"], ["c", "d"]]
    assert list(row)[1:] == ["heading", "list_item", "table", "code_block", "paragraph", "text", "text"]
