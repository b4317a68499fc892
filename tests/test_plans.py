"""Job providers, review and revision."""

import json

import pytest

from docloom.plans.generation import GenerationError
from docloom.plans.jobs import Jobs
from docloom.plans.pipeline import RevisionPolicy, finish
from docloom.plans.provider import JobProvider, ProviderOptions, build_request, schema_digest
from docloom.plans.stages import Converters
from tests.test_validation import SCHEMA, record


class FakeClock:
    def __init__(self):
        self.now = 0.0

    def monotonic(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def provider(answers, **options):
    calls = []

    def transport(method, url, body):
        calls.append((method, url.rsplit("/", 2)[-2] if "status" in url or "cancel" in url else url.rsplit("/", 1)[-1]))
        if url.endswith("/run"):
            return 200, {"id": "job1"}
        answer = answers.pop(0) if len(answers) > 1 else answers[0]
        if isinstance(answer, Exception):
            raise answer
        return answer

    return JobProvider(ProviderOptions("https://service", "m", **options), transport, FakeClock()), calls


def test_submits_once_and_polls_through_failures():
    p, calls = provider([(503, {}), (200, {"status": "IN_QUEUE"}), OSError(), (429, {}), (200, {"status": "IN_PROGRESS"}), (200, {"status": "COMPLETED", "output": {"records": []}})])
    assert json.loads(p.generate([], {}, 10)) == {"records": []}
    assert calls.count(("POST", "run")) == 1 and p.counters["retries"] == 3 and p.counters["polls"] == 6 and p.counters["completed"] == 1 and p.counters["failed"] == 0


def test_time_limits_count_from_the_submission():
    answers = [(200, {"status": "IN_QUEUE"})] * 20 + [(200, {"status": "IN_PROGRESS"})]
    p, _ = provider(answers, queue_seconds=30, execution_seconds=60)
    with pytest.raises(GenerationError) as e:
        p.generate([], {}, 10)
    assert e.value.code == "PROVIDER_EXECUTION_TIMEOUT" and 90 < p.clock.now < 95 and p.counters["failed"] == 1


def test_jobs():
    jobs = Jobs(files={"f": "upload"})
    assert jobs.start("a", "f").status == "queued" and jobs.start("b", "f") is None and jobs.get("b") is None
    assert jobs.update("a", status="generating", percent=50).percent == 50 and jobs.update("a", percent=40).percent == 50
    assert jobs.cancel("a").error == "GENERATION_CANCELLED" and jobs.update("a", status="completed").status == "cancelled" and jobs.cancelled("a")
    assert jobs.start("b", "f").job_id == "b" and jobs.update("zz") is None
    with pytest.raises(KeyError):
        jobs.start("c", "none")


def test_converters_by_type():
    converters = Converters()
    converters.register(lambda content, kind: iter([{"text": "one"}]), ".PDF", ".docx")
    assert list(converters(b"", ".pdf")) == [{"text": "one"}]
    with pytest.raises(ValueError):
        converters(b"", ".odt")


@pytest.mark.parametrize(
    "answers, code",
    [([(401, {})], "PROVIDER_AUTH_FAILED"), ([(404, {})], "PROVIDER_REQUEST_INVALID"), ([(500, {})], "PROVIDER_ERROR"), ([(200, {"status": "FAILED"})], "PROVIDER_FAILED"), ([(200, {"status": "ODD"})], "PROVIDER_UNKNOWN_STATUS"), ([(200, {"status": "IN_QUEUE"})], "PROVIDER_QUEUE_TIMEOUT"), ([(200, {"status": "IN_PROGRESS"})], "PROVIDER_EXECUTION_TIMEOUT"), ([(200, [])], "PROVIDER_INVALID_RESPONSE")],
)
def test_failures(answers, code):
    p, calls = provider(answers)
    with pytest.raises(GenerationError) as e:
        p.generate([], {}, 10)
    assert e.value.code == code and calls.count(("POST", "run")) == 1


def test_options_and_request():
    for bad in ({"endpoint": "", "model": "m"}, {"endpoint": "x", "model": "m", "max_model_len": "0"}, {"endpoint": "x", "model": "m", "poll_seconds": "soon"}):
        with pytest.raises(GenerationError):
            ProviderOptions.from_mapping(bad)
    options = ProviderOptions.from_mapping({"endpoint": "x", "model": "m", "records_per_batch": "2"})
    assert options.records_per_batch == 2 and build_request(options, [], {}, 5)["input"]["openai_input"]["temperature"] == 0.2
    assert schema_digest({"b": 1, "a": 2}) == schema_digest({"a": 2, "b": 1})


def test_cancelling():
    p, calls = provider([(200, {"status": "IN_QUEUE"})])
    p.cancelled = lambda: p.counters["polls"] >= 2
    with pytest.raises(GenerationError) as e:
        p.generate([], {}, 10)
    assert e.value.code == "GENERATION_CANCELLED" and ("POST", "cancel") in calls


class Script:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), 0

    def generate(self, messages, schema, max_tokens):
        self.calls += 1
        return json.dumps(self.answers.pop(0))


ISSUE = {"code": "AMBIGUOUS_INSTRUCTION", "severity": "warning", "record_ids": ["r1"], "message": "m", "suggested_action": "a"}
CLEAN = {"issues": [], "summary": "fine"}
NEW = {"instruction": "A clear question", "context": "Context", "expected_output": "Answer", "category": "general", "difficulty": "easy", "source_refs": ["s1"], "evidence": [{"source_ref": "s1", "quote": "grounded statement"}]}


@pytest.fixture(scope="module")
def dataset(spark):
    rows = [(*record(i)[:-1], {"record_id": f"r{i}"}) for i in range(3)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("s1", "A grounded statement.")], "source_ref string, source_text string")


def test_review_without_findings(spark, dataset):
    p = Script(CLEAN)
    out = finish(spark, *dataset, "prompt", p)
    assert p.calls == 1 and out.review["issues_found"] == 0 and out.report["status"] == "passed_with_warnings" and out.records.count() == 3
    assert finish(spark, *dataset, "prompt").review is None


def test_no_revision_beyond_the_policy(spark, dataset):
    blocked = {"issues": [ISSUE], "summary": "one"}
    for options in ({"spent": 1}, {"policy": RevisionPolicy(allow_quality_revision=False)}):
        with pytest.raises(GenerationError) as e:
            finish(spark, *dataset, "prompt", Script(blocked), **options)
        assert e.value.code == "QUALITY_REVIEW_BLOCKED"


def test_one_targeted_revision(spark, dataset):
    p = Script({"issues": [ISSUE], "summary": "one"}, {"records": [NEW]}, CLEAN)
    out = finish(spark, *dataset, "prompt", p)
    rows = {r.metadata["record_id"]: r for r in out.records.collect()}
    assert p.calls == 3 and out.revised == ["r1"]
    assert rows["r1"].instruction == "A clear question" and rows["r1"].metadata["revision_reason_codes"] == "AMBIGUOUS_INSTRUCTION" and rows["r0"].instruction == "Explain point 0"


@pytest.mark.parametrize(
    "answers, code",
    [([{"issues": [ISSUE | {"record_ids": ["zz"]}], "summary": ""}], "QUALITY_REVIEW_INVALID"), ([{"issues": [ISSUE], "summary": ""}, {"records": [NEW, NEW]}], "QUALITY_REVISION_INVALID"), ([{"issues": [ISSUE], "summary": ""}, {"records": [NEW]}, {"issues": [ISSUE], "summary": ""}], "QUALITY_REVIEW_BLOCKED"), ([{"issues": [ISSUE], "summary": ""}, {"records": [NEW | {"evidence": [{"source_ref": "s1", "quote": "made up words"}]}]}], "VALIDATION_FAILED")],
)
def test_what_stops_a_dataset(spark, dataset, answers, code):
    with pytest.raises(GenerationError) as e:
        finish(spark, *dataset, "prompt", Script(*answers))
    assert e.value.code == code
