"""Validation, duplicates, grounding and quality."""

import json
import random
from difflib import SequenceMatcher

import pytest

from docloom.functions.text import _normal
from docloom.operators import validation as V
from docloom.operators.quality import quality_summary, record_summaries, report_document

SCHEMA = "job_id string, rec_pos int, instruction string, input_text string, output_text string, context string, expected_output string, category string, difficulty string, source_refs array<string>, evidence array<struct<source_ref:string,quote:string>>, metadata map<string,string>"


def record(pos, job="j", refs=("s1",), quotes=(("s1", "grounded statement"),), **fields):
    base = {"instruction": f"Explain point {pos}", "context": f"Context of {pos}", "expected_output": f"Answer {pos} in words", "category": "general", "difficulty": "easy"} | fields
    return (job, pos, base["instruction"], base["context"], base["expected_output"], base["context"], base["expected_output"], base["category"], base["difficulty"], list(refs) if refs is not None else None, [{"source_ref": a, "quote": b} for a, b in quotes] if quotes is not None else None, {})


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("s1", "A  GROUNDED\nstatement “quoted” about straße."), ("s2", "Other unit")], "source_ref string, source_text string")


def evidence_of(records):
    return records.selectExpr("job_id", "rec_pos", "posexplode(evidence) AS (ev_pos, e)").selectExpr("job_id", "rec_pos", "ev_pos", "e.source_ref", "e.quote")


def test_evidence_codes(spark, sources):
    quotes = [("s1", "grounded STATEMENT"), ("s1", '"quoted" about STRASSE'), ("s1", "  "), ("s1", None), ("s1", "abcd"), ("s1", "x" * 501), ("s2", "grounded statement"), ("zz", "grounded statement"), (None, "grounded statement"), ("s1", "absent words")]
    rows = evidence_of(make(spark, [record(0, quotes=quotes)]))
    got = [r.code for r in V.evidence_checks(rows, sources).orderBy("ev_pos").collect()]
    assert got == [None, None, "EVIDENCE_EMPTY", "EVIDENCE_EMPTY", "EVIDENCE_TOO_SHORT", "EVIDENCE_TOO_LONG"] + ["EVIDENCE_NOT_FOUND"] * 4


def test_field_and_reference_issues(spark, sources):
    rows = [record(0), record(1, instruction=" "), record(2, context="x" * 4001), record(3, difficulty="extreme"), record(4, instruction="Same ", context=" SAME"), record(5, category=None, difficulty=None), record(6, refs=()), record(7, refs=("s1", "no", "no", "nope")), record(8, refs=None)]
    records = make(spark, rows)
    fields = sorted((r.rec_pos, r.code, r.field) for r in V.field_issues(records).collect())
    assert fields == [(1, "EMPTY_REQUIRED_FIELD", "instruction"), (2, "FIELD_TOO_LONG", "context"), (3, "INVALID_DIFFICULTY", "difficulty"), (4, "CONTEXT_EQUALS_INSTRUCTION", "context"), (5, "EMPTY_REQUIRED_FIELD", "category"), (5, "INVALID_DIFFICULTY", "difficulty")]
    refs = sorted((r.rec_pos, r.code, r.ref) for r in V.reference_issues(records, sources, "source_ref").collect())
    assert refs == [(6, "MISSING_SOURCE_REF", ""), (7, "INVALID_SOURCE_REF", "no"), (7, "INVALID_SOURCE_REF", "nope"), (8, "MISSING_SOURCE_REF", "")]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(6)
    words = ["pump", "valve", "archive", "team", "restart", "cabinet", "hall", "limit"]
    rows, pos = [], 0
    for base in range(12):
        text = " ".join(rng.choices(words, k=25))
        for edit in range(4):
            changed = text.split()
            for _ in range(edit):
                changed[rng.randrange(25)] = rng.choice(words)
            rows.append(record(pos, job=f"j{base % 3}", instruction=" ".join(changed), context=text))
            pos += 1
    rows.append(record(pos, job="j0", instruction=rows[0][2].upper(), context=rows[0][5], expected_output=rows[0][6]))
    records = make(spark, rows)
    marks = {(r.job_id, r.rec_pos): r.is_duplicate for r in V.exact_duplicates(records).collect()}
    assert [k for k, v in marks.items() if v] == [("j0", pos)]
    texts = {}
    for r in rows:
        if not marks[(r[0], r[1])]:
            texts.setdefault(r[0], []).append((r[1], _normal("|".join((r[2], r[5], r[6], r[7], r[8])))))
    expected = {(job, a, b) for job, own in texts.items() for a, x in own for b, y in own if a < b and SequenceMatcher(None, x, y).ratio() >= 0.92}
    got = [(r.job_id, r.left_pos, r.right_pos) for r in V.near_duplicates(records).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected


@pytest.mark.parametrize("threshold", [0.5, 0.7, 1.0])
def test_near_duplicates_at_other_thresholds(spark, monkeypatch, threshold):
    monkeypatch.setattr(V, "MEET", 3)  # so that every class is spread
    rng = random.Random(8)
    words = ["pump", "valve", "archive", "team", "restart", "cabinet"]
    rows = [record(i, job=f"j{i % 2}", instruction=" ".join(rng.choices(words, k=12)), context="Context") for i in range(40)]
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append((r[1], _normal("|".join((r[2], r[5], r[6], r[7], r[8])))))
    expected = {(job, a, b) for job, own in texts.items() for a, x in own for b, y in own if a < b and SequenceMatcher(None, x, y).ratio() >= threshold}
    got = [(r.job_id, r.left_pos, r.right_pos) for r in V.near_duplicates(make(spark, rows), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    with pytest.raises(ValueError):
        V.near_duplicates(make(spark, rows), 0)


def test_jobs_without_records(spark, sources):
    jobs = spark.createDataFrame([("j",), ("empty",), ("empty",)], "job_id string")
    found = V.check_records(make(spark, [record(0)]), sources, jobs)
    assert [(r.job_id, r.code, r.severity, r.record_id) for r in found.issues.collect()] == [("empty", "ZERO_RECORDS", "error", None)]
    summary = quality_summary(found.records, found.grounding, found.issues, found.near, marks=found.marks, jobs=jobs)
    assert {r.job_id: (r.status, r.generated, r.errors) for r in summary.collect()} == {"j": ("passed", 1, 0), "empty": ("failed", 0, 1)}
    kept = found.records.withColumn("record_id", V.record_name())
    out = {r.job_id: json.loads(r.report) for r in report_document(summary, found.grounding, found.issues, record_summaries(found.per_record, found.issues, kept)).collect()}
    assert out["empty"]["issues"][0]["message"] == V.MESSAGES["ZERO_RECORDS"] and out["empty"]["grounding"]["status"] == "failed"
    assert out["j"]["records"]["recordSummaries"] == [{"recordId": "record-1", "groundingStatus": "passed", "sourceRefs": 1, "evidenceItems": 1, "verifiedEvidenceItems": 1, "issueCodes": []}]


def test_messages_name_fields_and_records(spark, sources):
    found = V.check_records(make(spark, [record(0, instruction=" "), record(1, quotes=(("s1", "x"),))]), sources)
    assert {(r.rec_pos, r.message, r.record_id) for r in found.issues.collect()} == {(0, "A required field has no content: instruction.", "record-1"), (1, "A quote has fewer than 5 characters.", "record-2")}


def parts(spark, sources, rows, mode="compat"):
    records = make(spark, rows)
    evidence = evidence_of(records)
    grounding = V.grounding_summary(records, V.record_grounding(records, evidence, sources), mode)
    near = V.near_duplicates(records)
    issues = V.issue_order(V.all_issues(records, evidence, sources, near))
    return records, grounding, near, issues


def test_duplicates_count_before_removal_unless_asked_otherwise(spark, sources):
    rows = [record(0), record(1, instruction="EXPLAIN  point 0", context="Context of 0", expected_output="Answer 0 in words")]
    _, grounding, _, issues = parts(spark, sources, rows)
    row = grounding.first()
    assert (row.total_records, row.grounded_records, row.status, row.grounding_percent) == (1, 2, "failed", 200.0)
    assert [(r.code, r.rec_pos) for r in issues.collect()] == [("EXACT_DUPLICATE", 1)]
    after = parts(spark, sources, rows, "post_dedup")[1].first()
    assert (after.grounded_records, after.status, after.grounding_percent) == (1, "passed", 100.0)
    with pytest.raises(ValueError):
        parts(spark, sources, rows, "other")


@pytest.mark.parametrize(
    "rows, status",
    [
        ([record(0)], "passed"),
        ([record(0, context="Explain point 0")], "passed_with_warnings"),
        ([record(0, quotes=(("s1", "absent words"),))], "failed"),
        ([record(0, quotes=())], "failed"),
        ([record(0), record(1, difficulty="x")], "failed"),
    ],
)
def test_status(spark, sources, rows, status):
    records, grounding, near, issues = parts(spark, sources, rows)
    summary = quality_summary(records, grounding, issues, near).first()
    assert summary.status == status
    report = json.loads(report_document(quality_summary(records, grounding, issues, near), grounding, issues).first().report)
    assert report["status"] == status and report["records"]["generated"] == len(rows)
    assert set(report["quality"]["difficulty_distribution"]) == {"easy", "medium", "hard"}


def test_record_summaries(spark, sources):
    records, _, near, issues = parts(spark, sources, [record(0), record(1, quotes=(("s1", "absent words"), ("s1", "x"))), record(2, instruction="EXPLAIN point 0", context="Context of 0", expected_output="Answer 0 in words")])
    per_record = V.record_grounding(records, evidence_of(records), sources)
    kept = V.exact_duplicates(records).where("NOT is_duplicate")
    out = {r.rec_pos: r for r in record_summaries(per_record, issues, kept).collect()}
    assert set(out) == {0, 1} and out[0].grounding_status == "passed" and out[0].issue_codes == []
    assert (out[1].grounding_status, out[1].evidence_items, out[1].verified, out[1].issue_codes) == ("failed", 2, 0, ["EVIDENCE_NOT_FOUND", "EVIDENCE_TOO_SHORT"])


def test_empty(spark, sources):
    records, grounding, near, issues = parts(spark, sources, [])
    assert grounding.count() == near.count() == issues.count() == quality_summary(records, grounding, issues, near).count() == 0
    assert V.structural_errors(make(spark, [record(0, instruction="")])).first().field == "instruction"
