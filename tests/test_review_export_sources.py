"""Review, export, file sources and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import export, review
from docloom.sources.files import drop_stale_uploads, extract_files, read_files
from docloom.streaming.elements import arrivals, drop_redelivered, stream_elements, write_stream

ISSUE = {"code": "WEAK_CONTEXT", "severity": "blocking", "record_ids": ["r1"], "message": "m", "suggested_action": "a"}


def body(**change):
    return json.dumps({"issues": [ISSUE | change], "summary": "s"})


VALID = [json.dumps({"issues": [], "summary": ""}), body(), json.dumps({"choices": [{"message": {"content": "```json\n" + body() + "\n```"}}]}), json.dumps({"issues": [ISSUE], "summary": "x" * 600}), json.dumps([{"id": "x", "choices": [{"message": {"content": body()}}]}]), "Here: " + body() + " done"]
INVALID = ["", "[]", json.dumps({"issues": []}), json.dumps({"issues": [], "summary": "s", "grade": 5}), body(code="NEW"), body(severity="low"), body(record_ids=["r9"]), body(message=" "), body(message="m" * 321), body(suggested_action="a" * 241), body(extra=1), json.dumps({"issues": [ISSUE] * 26, "summary": "s"}), json.dumps({"issues": [], "summary": 5}), json.dumps({"issues": [], "summary": {"a": 1}}), json.dumps({"issues": [{k: v for k, v in ISSUE.items() if k != "message"}], "summary": "s"})]


def test_strict_parsing(spark):
    df = spark.createDataFrame(list(enumerate([*VALID, *INVALID])), "n int, o string")
    out = {r.n: r.p for r in review.parse_review(df, F.array(F.lit("r1"), F.lit("r2")), "o").collect()}
    assert [out[i].error for i in range(len(VALID))] == [None] * len(VALID)
    assert [out[len(VALID) + i].error for i in range(len(INVALID))] == ["QUALITY_REVIEW_INVALID"] * len(INVALID)
    assert len(out[3].summary) == 500 and out[1].issues[0].record_ids == ["r1"]


def test_summary_ignores_the_models_severity_and_caps(spark):
    issues = spark.createDataFrame([("j", 1, i, "AMBIGUOUS_INSTRUCTION" if i == 0 else "WEAK_CONTEXT") for i in range(20)] + [("j", 2, i, "SOURCE_SUPPORT_CONCERN") for i in range(9)], "job_id string, batch int, pos int, code string")
    summaries = spark.createDataFrame([("j", 2, "two"), ("j", 1, "one"), ("k", 1, "")], "job_id string, batch int, summary string")
    out = {r.job_id: r for r in review.summarize_review(issues, summaries).collect()}
    assert (out["j"].issues_found, out["j"].blocking_issues, out["j"].warnings, out["j"].summary) == (25, 6, 19, "one two")
    assert out["k"].summary == review.NO_ISSUES and not out["k"].revision_required


def test_review_batches_follow_the_fold(spark):
    rows = []
    for i, n in enumerate((3000, 900, 1200, 5000, 10, 10)):
        rows.append(("j", i, "q\n" + "x" * n, "in\"", "out\\", {"record_id": f"r{i}", "note": "\u0001 \t"}, "é", "", "general", "easy", ["s1", "s2"][: i % 3], [("s1", "quote")] * (i % 2)))
    schema = "job_id string, rec_pos int, instruction string, input_text string, output_text string, metadata map<string,string>, context string, expected_output string, category string, difficulty string, source_refs array<string>, evidence array<struct<source_ref:string,quote:string>>"
    df = spark.createDataFrame(rows, schema)
    prompts = spark.createDataFrame([("j", "p" * 300), ("other", "p")], "job_id string, prompt string")
    got = [r.review_batch for r in review.review_batches(review.review_costs(df), prompts, 2048).orderBy("rec_pos").collect()]
    tokens = lambda text: max(1, (len(text) + 3) // 4)
    fixed = tokens(review.SYSTEM + "p" * 300)
    batch, total, held, expected = 1, fixed + tokens(json.dumps(review.review_schema(), sort_keys=True)), 0, []
    for row in rows:
        values = dict(zip(["instruction", "input", "output", "metadata", "context", "expected_output", "category", "difficulty", "source_refs"], row[2:11]))
        whole = json.dumps(values | {"evidence": [{"source_ref": r, "quote": q} for r, q in row[11]]}, ensure_ascii=False)
        cost = tokens(whole)
        if held and total + cost > 1024:
            batch, total, held = batch + 1, fixed, 0
        held, total = held + 1, total + cost
        expected.append(batch)
    assert got == expected
    assert [r.cost for r in review.review_costs(df).orderBy("rec_pos").limit(1).collect()] == [tokens(json.dumps(dict(zip(["instruction", "input", "output", "metadata", "context", "expected_output", "category", "difficulty", "source_refs"], rows[0][2:11])) | {"evidence": []}, ensure_ascii=False))]


def test_top_issues(spark):
    issues = spark.createDataFrame([("j", 2 - i // 4, i % 4) for i in range(8)] + [("k", 1, 0)], "job_id string, batch int, pos int")
    assert sorted((r.job_id, r.batch, r.pos) for r in review.top_issues(issues).collect()) == [("j", 1, 0), ("j", 1, 1), ("j", 1, 2), ("j", 1, 3), ("j", 2, 0), ("k", 1, 0)]


def test_revision(spark):
    rows = [("j", i, f"text {i}", {"record_id": f"r{i}"}) for i in range(4)]
    records = spark.createDataFrame(rows, "job_id string, rec_pos int, instruction string, metadata map<string,string>")
    issues = spark.createDataFrame([("j", ["r1", "r3", "none"])], "job_id string, record_ids array<string>")
    affected = review.affected_records(records, issues)
    assert sorted(r.rec_pos for r in affected.collect()) == [1, 3]
    asked = affected.select("job_id", "rec_pos", F.lit(4).alias("total"))
    given = lambda n: spark.createDataFrame([("j", i) for i in range(n)], "job_id string, new_pos int")
    pos = lambda n: [(r.rec_pos, r.new_pos, r.error) for r in review.pair_replacements(asked, given(n)).orderBy("rec_pos").collect()]
    assert pos(2) == [(1, 0, None), (3, 1, None)] and pos(4) == [(1, 1, None), (3, 3, None)]
    assert {e for _, _, e in pos(3)} == {"QUALITY_REVISION_INVALID"}
    new = spark.createDataFrame([("j", 1, "new", "A,B")], "job_id string, rec_pos int, instruction string, reason_codes string")
    out = {r.rec_pos: r for r in review.apply_replacements(records, new, ("instruction",)).collect()}
    assert out[1].instruction == "new" and out[0].instruction == "text 0"
    assert out[1].metadata == {"record_id": "r1", "original_record_id": "r1", "revision_attempt": "1", "revision_reason_codes": "A,B", "replaced_by": "r1"} and out[0].metadata == {"record_id": "r0"}


def test_csv_and_package(spark, tmp_path):
    rows = [(0, "=1+1", "in", "-out", {"b": "2", "a": "1"}, "+c", "@e", "=cat", "easy", ["s1"], [("s1", 'say "x",\r\nnow')]), (1, None, "", " =x", {}, None, "é", "k", "hard", None, None)]
    df = spark.createDataFrame(rows, "rec_pos int, instruction string, input_text string, output_text string, metadata map<string,string>, context string, expected_output string, category string, difficulty string, source_refs array<string>, evidence array<struct<source_ref:string,quote:string>>")
    out = export.csv_projection(df.coalesce(1)).collect()
    assert out[0][:3] == ("'=1+1", "in", "'-out") and out[0].category == "=cat" and out[0].metadata == '{"a":"1","b":"2"}'
    assert json.loads(out[0].evidence) == [{"quote": 'say "x",\r\nnow', "source_ref": "s1"}] and out[1].source_refs == "[]"
    assert export.csv_projection(df, strict_guard=True).collect()[1].output == "' =x"
    export.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"', multiLine=True, lineSep="\r\n").count()
    raw = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("part-*"))
    assert raw.startswith(b"instruction,input,output,metadata") and b"\r\n" in raw and back >= 2
    path = tmp_path / "dataset.json"
    assert export.write_json_array(df, path) == 2 and [r["rec_pos"] for r in json.loads(path.read_text())] == [0, 1]
    archive = export.package(path, tmp_path / "p.zip", "{}", "{}", report_json="{}")
    assert set(zipfile.ZipFile(archive).namelist()) == {"dataset/dataset.json", "dataset/manifest.json", "manifest.json", "metadata.json", "README.txt", "validation-report.json"}
    export.write_json_lines(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2


def test_metadata_and_diagnostics(spark):
    manifests = spark.createDataFrame([("j", '{"format": "csv", "record_count": 4, "validation_status": "failed"}'), ("k", "{}")], "job_id string, manifest string")
    reports = spark.createDataFrame([("j", json.dumps({"status": "passed", "quality": {"final_record_count": 3, "near_duplicate_pairs": 1}, "grounding": {"status": "passed", "grounded_records": 3}}))], "job_id string, report string")
    reviews = spark.createDataFrame([("k", json.dumps({"revisionAttempted": True, "status": "passed"}))], "job_id string, review string")
    out = {r.job_id: json.loads(r.metadata) for r in export.package_metadata(manifests, reports, reviews).collect()}
    assert len(export.METADATA_FIELDS) == 24 and all(list(m) == [f[0] for f in export.METADATA_FIELDS] for m in out.values())
    j, k = out["j"], out["k"]
    assert (j["format"], j["recordCount"], j["finalRecordCount"], j["validationStatus"], j["groundedRecords"], j["nearDuplicateCount"], j["reviewStatus"], j["revisionCount"]) == ("csv", 4, 3, "passed", 3, 1, "not_evaluated", 0)
    assert (k["validationStatus"], k["groundingStatus"], k["revisionAttempted"], k["revisionCount"], k["reviewStatus"]) == (None, "not_evaluated", True, 1, "passed")
    assert json.loads(export.package_metadata(manifests, reports).where("job_id = 'k'").first().metadata)["revisionAttempted"] is False
    row = spark.sql("SELECT map('polls', '3', 'secret', 'x') AS m").select(export.diagnostics(F.col("m")).alias("d")).first()
    assert row.d == {"polls": 3}
    issues = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "n int, record_ids array<string>")
    assert [r.n for r in review.issues_of(issues, F.array(F.lit("b"))).collect()] == [1]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfTITLE\nline \xc3\xa9")
    (tmp_path / "b.txt").write_bytes(b"caf\xe9 \x80")
    (tmp_path / "c.txt").write_bytes(b"bad \x81")
    (tmp_path / "d.txt").write_bytes(b"")
    (tmp_path / "e.exe").write_bytes(b"x")
    (tmp_path / "f.pdf").write_bytes(b"not a pdf")
    (tmp_path / "g.docx").write_bytes(b"items")

    class Item(dict):
        pass

    def convert(content, kind):
        if kind == ".pdf":
            raise ValueError("broken")
        head = Item(label="section_header", text=" Head ")
        yield from [head, head, Item(label="table", text="a | b\nc|d", page=2), Item(label="text", text="  ")]

    (tmp_path / "below" / "deep").mkdir(parents=True)
    (tmp_path / "below" / "deep" / "h.txt").write_bytes(b"")
    files = read_files(spark, str(tmp_path))
    elements, failures = extract_files(files, convert)
    names = {r.doc_id: r.source_filename for r in files.collect()}
    got = sorted((names[r.doc_id], r.ord, r.element_type, r.text) for r in elements.collect())
    assert got == [("a.txt", 1, "heading", "TITLE"), ("a.txt", 2, "paragraph", "line é"), ("b.txt", 1, "paragraph", "café €"), ("g.docx", 1, "heading", "Head"), ("g.docx", 3, "table", "a | b\nc | d")]
    assert {(names[r.doc_id], r.code) for r in failures.collect()} == {("c.txt", "EXTRACTION_FAILED"), ("d.txt", "EMPTY_FILE"), ("h.txt", "EMPTY_FILE"), ("e.exe", "UNSUPPORTED_DOCUMENT"), ("f.pdf", "CORRUPT_DOCUMENT")}
    assert {r.code for r in extract_files(files)[1].collect()} >= {"EXTRACTOR_UNAVAILABLE"}


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([("d", "TITLE\nline"), ("e", None)], "doc_id string, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    stream = stream_elements(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")))
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    rows = spark.sql("SELECT 'd' AS doc_id, explode(array('1', '2', '1')) AS element_id, 'text' AS element_type, 'abc' AS text, timestamp'2024-01-01' AS ingested_at")
    rows.write.parquet(str(tmp_path / "els"))
    arriving = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "els"))
    write_stream(drop_redelivered(arriving), str(tmp_path / "once"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2
    query = arrivals(arriving).writeStream.format("memory").queryName("arrivals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("arrivals").first().elements == 3


@pytest.mark.parametrize("name", ["document_statistics", "extract_elements", "validation_reports"])
def test_queries_run(spark, name):
    import os

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stale_uploads_and_packages(tmp_path):
    import os

    for name, age in (("old", 30), ("new", 1)):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1_000_000 - age * 3600, 1_000_000 - age * 3600))
    (tmp_path / "folder").mkdir()
    assert drop_stale_uploads(tmp_path, now=1_000_000) == 1 and sorted(p.name for p in tmp_path.iterdir()) == ["folder", "new"]
    assert drop_stale_uploads(tmp_path / "none") == 0
    job = "a" * 32
    (tmp_path / job).mkdir()
    assert export.ready_package(tmp_path, job, "completed") is None
    (tmp_path / job / "dataset.zip").write_text("x")
    assert export.ready_package(tmp_path, job, "completed") and export.ready_package(tmp_path, job, "running") is None and export.ready_package(tmp_path, "../x", "completed") is None


def test_sizes(spark):
    from docloom.functions.text import human_size

    rows = spark.createDataFrame([(0,), (1023,), (1536,), (5 * 1024 * 1024,)], "n long").select(human_size(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == ["0 B", "1023 B", "1.5 KB", "5.0 MB"]
