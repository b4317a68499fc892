"""Provider answers, aliases, assembly and the generation loop."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators.batching import BatchOptions
from docloom.operators.provider_output import normalize_records, output_shape, parse_outputs
from docloom.operators.resolve import assemble, resolve_aliases
from docloom.plans.generation import GenerationError, OfflineProvider, generate

RECORD = {"instruction": "I", "context": "C", "expected_output": "E", "category": "k", "difficulty": "hard", "source_refs": ["source_1"], "evidence": [{"source_ref": "source_1", "quote": "some text"}]}


def chat(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


BODY = json.dumps({"records": [RECORD]})
GOOD = [BODY, json.dumps([RECORD]), chat(BODY), "[" + chat(BODY) + "]", chat("```json\n" + BODY + "\n```"), chat("Here: " + BODY + " bye"), json.dumps({"choices": [{"text": BODY}]}), json.dumps({"choices": [{"message": {"content": "  "}, "output": BODY}]})]
GOOD += [json.dumps([{"id": "x", "choices": [{"message": {"content": BODY}}]}]), json.dumps({"id": "x", "model": "m", "choices": [{"message": {"role": "assistant", "content": BODY}}]}), json.dumps(BODY), json.dumps({"id": "x", "records": [RECORD], "error": "none"})]
BAD = {"": "STRUCTURED_OUTPUT_INVALID", "words": "STRUCTURED_OUTPUT_INVALID", json.dumps({"records": []}): "STRUCTURED_OUTPUT_INVALID", json.dumps({"choices": []}): "STRUCTURED_OUTPUT_INVALID", json.dumps({"error": {"message": "x"}}): "WORKER_ERROR", chat(""): "STRUCTURED_OUTPUT_INVALID", json.dumps({"choices": [{"message": {"reasoning": BODY}}]}): "STRUCTURED_OUTPUT_INVALID", None: "STRUCTURED_OUTPUT_INVALID"}
BAD |= {json.dumps([{"id": "x", "choices": [], "error": {"message": "x"}}]): "WORKER_ERROR", json.dumps({"id": "x", "error": {"message": "x"}, "choices": []}): "WORKER_ERROR"}
BAD |= {json.dumps(x): "STRUCTURED_OUTPUT_INVALID" for x in ([{"id": "x", "error": {"m": 1}}], [1, 2], [RECORD, "x"], [RECORD, None], [RECORD, {"id": 3}], {"records": {"a": 1}}, {"records": "x"}, {"choices": None}, {"choices": [{"message": {"content": 5}}]}, [[RECORD]], 5, None, {})}


def test_parsing(spark):
    df = spark.createDataFrame(list(enumerate([*GOOD, *BAD])), "n int, output string")
    out = {r.n: r for r in parse_outputs(df).collect()}
    assert all(out[i].error is None and out[i].item.instruction == "I" and out[i].item.evidence[0].quote == "some text" for i in range(len(GOOD)))
    assert [out[len(GOOD) + i].error for i in range(len(BAD))] == list(BAD.values())
    assert df.where("n = 2").select(output_shape(F.col("output")).alias("s")).first().s.choices == 1


def test_normalising(spark):
    item = {"instruction": "I", "input": "old", "output": "answer", "metadata": {"record_id": "evil", "note": "kept"}}
    df = spark.createDataFrame([("g", "f", json.dumps([item]))], "job_id string, doc_id string, output string")
    row = normalize_records(parse_outputs(df), F.col("job_id"), F.col("doc_id"), {"model": F.lit("m")}).first()
    assert (row.context, row.input_text, row.expected_output, row.output_text, row.category, row.difficulty) == ("old", "old", "answer", "answer", "general", "medium")
    assert row.metadata == {"note": "kept", "record_id": "g-1", "generation_id": "g", "file_id": "f", "model": "m"}


def test_aliases_are_local_to_their_batch(spark):
    units = spark.createDataFrame([("d", 1, 1, "e1", "Some  TEXT here"), ("d", 1, 2, "e2", "More"), ("d", 2, 1, "e3", "Third unit")], "doc_id string, batch_no int, alias_no int, element_id string, full_text string")
    q = lambda ref, quote: {"source_ref": ref, "quote": quote}
    rows = [
        ("d", 1, 0, ["source_1"], [q("source_1", "some text")]),
        ("d", 1, 1, ["source_1", "source_2"], [q("source_1", "some")]),
        ("d", 1, 2, ["source_3"], []),
        ("d", 2, 3, ["source_2"], []),
        ("d", 1, 4, [], [q("source_2", "absent words")]),
        ("d", 1, 5, [], [q("source_2", "")]),
        ("d", 2, 6, ["source_1", "source_1"], []),
        ("d", 2, 7, [], []),
    ]
    df = spark.createDataFrame(rows, "doc_id string, batch_no int, rec_in_batch int, source_refs array<string>, evidence array<struct<source_ref:string,quote:string>>")
    out = {r.rec_in_batch: r for r in resolve_aliases(df, units).collect()}
    assert out[0].source_refs == ["e1"] and out[0].evidence[0].source_ref == "e1" and out[0].batch_error is None
    assert [out[i].batch_error for i in range(1, 8)] == ["SOURCE_REF_EVIDENCE_MISMATCH", "UNKNOWN_OR_CROSS_BATCH_SOURCE_REF", "UNKNOWN_OR_CROSS_BATCH_SOURCE_REF", "BATCH_EVIDENCE_NOT_FOUND", None, None, None]
    assert out[6].source_refs == ["e3"] and out[7].source_refs == []


def test_assembly_numbers_and_cuts(spark):
    rows = [("g", b, i, {"record_id": f"g-{i + 1}", "x": "y"}, 3) for b in (2, 1) for i in range(2)]
    out = assemble(spark.createDataFrame(rows, "job_id string, batch_no int, rec_in_batch int, metadata map<string,string>, target int")).orderBy("rec_pos").collect()
    assert [(r.batch_no, r.rec_in_batch, r.metadata["record_id"], r.metadata["x"]) for r in out] == [(1, 0, "g-1", "y"), (1, 1, "g-2", "y"), (2, 0, "g-3", "y")]


class Flaky(OfflineProvider):
    def __init__(self, bad):
        self.bad, self.calls = bad, 0

    def generate(self, messages, schema, max_tokens):
        self.calls += 1
        return "no json" if self.calls in self.bad else super().generate(messages, schema, max_tokens)


@pytest.fixture(scope="module")
def unit_rows(spark):
    return spark.createDataFrame([("d", f"e{i}", "paragraph", f"Unit number {i} says something.", i, None) for i in range(13)], "doc_id string, element_id string, element_type string, text string, ord int, table_rows array<array<string>>")


def test_loop(spark, unit_rows):
    provider = Flaky(())
    records, run = generate(spark, "job", unit_rows, "Make 8 records", provider, BatchOptions(32768, 4, 4))
    out = records.orderBy("rec_pos").collect()
    assert run.batches == run.calls == provider.calls == 2 and run.repairs == 0
    assert [r.rec_pos for r in out] == list(range(8)) and [r.metadata["record_id"] for r in out] == [f"job-{i + 1}" for i in range(8)]
    assert out[0].source_refs == ["e0"] and out[4].source_refs == ["e8"]


def test_one_repair(spark, unit_rows):
    provider = Flaky((1,))
    records, run = generate(spark, "job", unit_rows, "Make 8 records", provider, BatchOptions(32768, 4, 4))
    assert (run.calls, run.repairs, records.count()) == (3, 1, 8)
    for bad in ((1, 2), (1, 3)):
        with pytest.raises(GenerationError) as e:
            generate(spark, "job", unit_rows, "Make 8 records", Flaky(bad), BatchOptions(32768, 4, 4))
        assert e.value.code == "STRUCTURED_OUTPUT_INVALID"


def test_cancel(spark, unit_rows):
    provider = Flaky(())
    with pytest.raises(GenerationError) as e:
        generate(spark, "job", unit_rows, "Make 8 records", provider, cancelled=lambda: provider.calls >= 1)
    assert e.value.code == "GENERATION_CANCELLED" and provider.calls == 1


class Loose(OfflineProvider):
    """Cites well, but says nothing of a category in the first answer."""

    def __init__(self):
        self.asked = []

    def generate(self, messages, schema, max_tokens):
        self.asked.append(messages)
        answer = super().generate(messages, schema, max_tokens)
        return answer.replace('\\"category\\": \\"general\\"', '\\"category\\": \\" \\"') if len(self.asked) == 1 else answer


def test_a_batch_that_is_not_grounded_is_repaired_with_its_answer(spark, unit_rows):
    provider = Loose()
    records, run = generate(spark, "job", unit_rows, "Make 8 records", provider, BatchOptions(32768, 4, 4))
    assert (run.calls, run.repairs, run.repair_reason, records.count()) == (3, 1, "BATCH_GROUNDING_FAILED", 8)
    assert "Answer given before:" in provider.asked[-1][-1]["content"] and "choices" in provider.asked[-1][-1]["content"]
