"""From elements to a validated dataset, with a generation provider on the driver.

Calls to a provider cost money and must not be repeated, so they happen on the driver, once for each
batch, and their outputs are stored before Spark parses them; nothing lazy can call a provider again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import requested_count
from docloom.operators.batching import BatchOptions, batch_units, context_batches, empty_batches
from docloom.operators.provider_output import normalize_records, parse_outputs
from docloom.operators.resolve import assemble, resolve_aliases
from docloom.operators.validation import grounding_summary, record_grounding, structural_errors
from docloom.session import cut_lineage

RAW = "job_id string, doc_id string, batch_no int, attempt int, output string"


class Provider(Protocol):
    """What generates records or reviews; implementations own their retries, and never submit twice."""

    def generate(self, messages: list[dict[str, str]], schema: dict, max_tokens: int) -> str: ...


class GenerationError(RuntimeError):
    """A failed generation with a code that callers may show."""

    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass
class Run:
    """What a generation did."""

    batches: int = 0
    calls: int = 0
    repairs: int = 0
    repair_reason: str | None = None
    progress: list[tuple[int, str]] = field(default_factory=list)


class OfflineProvider:
    """A deterministic provider without a model: one record for each of the first units of a batch, quoting the unit."""

    def generate(self, messages: list[dict[str, str]], schema: dict, max_tokens: int) -> str:
        prompt = messages[-1]["content"]
        asked = int(re.search(r"records: (\d+)", prompt).group(1)) if re.search(r"records: (\d+)", prompt) else 1
        units = re.findall(r"\[(source_\d+)\]\n(.*?)(?=\n\n\[source_\d+\]\n|\Z)", prompt, re.S)
        records = []
        for alias, text in units:
            quote = text.strip()[:200].strip()
            if len(quote) >= 5 and len(records) < asked:
                records.append({"instruction": f"What does the passage under {alias} say?", "context": quote, "expected_output": quote, "category": "general", "difficulty": "easy", "source_refs": [alias], "evidence": [{"source_ref": alias, "quote": quote}]})
        return json.dumps({"choices": [{"message": {"content": json.dumps({"records": records})}}]})


def record_schema() -> dict:
    """JSON schema of a provider's answer; the names are fixed values of the contract."""
    text = {"type": "string"}
    evidence = {"type": "object", "properties": {"source_ref": text, "quote": text}, "required": ["source_ref", "quote"], "additionalProperties": False}
    fields = {"instruction": text, "context": text, "expected_output": text, "category": text, "difficulty": {"type": "string", "enum": ["easy", "medium", "hard"]}, "source_refs": {"type": "array", "items": text}, "evidence": {"type": "array", "items": evidence}}
    record = {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}
    return {"type": "object", "properties": {"records": {"type": "array", "items": record}}, "required": ["records"], "additionalProperties": False}


#: Characters of an invalid answer that a repair shows (a fixed value of the contract).
SHOWN_ANSWER = 12_000


def batch_messages(prompt: str, text: str, batch_id: str, asked: int, repair: str | None = None, answer: str = "") -> list[dict[str, str]]:
    """Messages that ask for the records of a batch, or for a repair of the answer given before."""
    task = f"{prompt}\nBatch: {batch_id}\nrecords: {asked}\nCite units by the names in brackets and quote them word for word.\n\n{text}"
    messages = [{"role": "system", "content": "Write dataset records from the given units only, as JSON of the given schema."}, {"role": "user", "content": task}]
    return messages if repair is None else [*messages, {"role": "user", "content": f"The answer was not valid ({repair}). Give the whole answer again.\nrecords: {asked}\n\n{text}\n\nAnswer given before:\n{answer[:SHOWN_ANSWER]}"}]


def _parsed(raw: DataFrame, units: DataFrame) -> DataFrame:
    """Resolved records of the last attempt of each batch, and an error a batch may have."""
    latest = raw.groupBy("job_id", "doc_id", "batch_no").agg(F.max_by("output", "attempt").alias("output"))
    parsed = cut_lineage(parse_outputs(latest))
    failed = parsed.where(F.col("error").isNotNull()).select("job_id", "batch_no", "error")
    cites = F.coalesce(F.col("item.source_refs").isNotNull() | F.col("item.evidence").isNotNull(), F.lit(False))
    citing = parsed.where(cites).select("job_id", "batch_no").distinct()
    records = normalize_records(parsed, F.col("job_id"), F.col("doc_id"), {"provider": F.lit("offline")})
    resolved = cut_lineage(resolve_aliases(records, units))
    gate = resolved.where(F.col("batch_error").isNotNull()).select("job_id", "batch_no", F.col("batch_error").alias("error"))
    numbered = resolved.withColumn("rec_pos", F.col("rec_in_batch"))
    blank = structural_errors(numbered).join(numbered.select("job_id", "rec_pos", "batch_no").distinct(), ["job_id", "rec_pos"]).select("job_id", "batch_no", F.concat(F.lit("missing "), "field").alias("error"))
    # a batch whose records cite anything must be grounded as a whole
    own = numbered.withColumn("job_id", F.concat_ws("/", "job_id", "batch_no"))
    evidence = own.select("job_id", "rec_pos", F.posexplode("evidence").alias("ev_pos", "e")).select("job_id", "rec_pos", "ev_pos", "e.source_ref", "e.quote")
    sources = units.groupBy(F.col("element_id").alias("source_ref")).agg(F.min("full_text").alias("source_text"))
    grounding = grounding_summary(own, record_grounding(own, evidence, sources)).where("status = 'failed'").select(F.col("job_id").alias("__batch"))
    loose = citing.join(grounding, F.concat_ws("/", "job_id", "batch_no") == F.col("__batch"), "left_semi").select("job_id", "batch_no", F.lit("BATCH_GROUNDING_FAILED").alias("error"))
    return resolved.withColumn("error", F.lit(None).cast("string")).unionByName(failed.unionByName(gate).unionByName(blank).unionByName(loose), allowMissingColumns=True)


def generate(spark: SparkSession, job_id: str, elements: DataFrame, prompt: str, provider: Provider, options: BatchOptions = BatchOptions(), max_records: int = 20, cancelled: Callable[[], bool] = lambda: False, on_progress: Callable[[int, str], None] = lambda percent, step: None) -> tuple[DataFrame, Run]:
    """(records, run) of one document: plan, one call a batch, parse, resolve, gate, at most one repair in all, assemble.

    Raises GenerationError with STRUCTURED_OUTPUT_INVALID if a batch stays invalid or a second one is,
    EMPTY_DATASET without a usable record, GENERATION_CANCELLED if cancelled between calls. Batches of
    one document are few, so their texts come to the driver one at a time.
    """
    target = spark.range(1).select(requested_count(F.lit(prompt), max_records)).first()[0]
    options = BatchOptions(options.max_model_len, options.records_per_batch, target)
    units = cut_lineage(batch_units(elements, options))
    docs = elements.select("doc_id").distinct()
    plan = cut_lineage(context_batches(units, options).unionByName(empty_batches(docs, units, options)))
    run, rows = Run(batches=plan.count()), []

    def call(batch, attempt: int, repair: str | None = None) -> None:
        if cancelled():
            raise GenerationError("GENERATION_CANCELLED")
        before = next((row[-1] for row in rows if row[2] == batch.batch_no), "")
        messages = batch_messages(prompt, batch.text, batch.batch_id, batch.requested_records, repair, before)
        output = provider.generate(messages, record_schema(), min(8192, options.max_model_len // 4))
        run.calls += 1
        rows.append((job_id, batch.doc_id, batch.batch_no, attempt, output))

    ordered: Iterable = list(plan.orderBy("batch_no").toLocalIterator())
    for i, batch in enumerate(ordered):
        # fixed values: a generation's batches lie between 35 and 75 percent
        run.progress.append((max([int(35 + i / max(1, run.batches) * 40), *(p for p, _ in run.progress)]), f"batch {i + 1} of {run.batches}"))
        on_progress(*run.progress[-1])
        call(batch, 1)
    result = cut_lineage(_parsed(spark.createDataFrame(rows, RAW), units))
    # a blank or ungrounded batch may have several errors; one of them is told
    broken = {r.batch_no: r.error for r in result.where(F.col("error").isNotNull()).groupBy("batch_no").agg(F.min("error").alias("error")).collect()}
    if len(broken) > 1:
        raise GenerationError("STRUCTURED_OUTPUT_INVALID", "more than one batch is invalid")
    for number, error in broken.items():
        run.repairs, run.repair_reason = 1, error[:240]
        call(next(b for b in ordered if b.batch_no == number), 2, error)
        result = cut_lineage(_parsed(spark.createDataFrame(rows, RAW), units))
        if result.where(F.col("error").isNotNull()).limit(1).count():
            raise GenerationError("STRUCTURED_OUTPUT_INVALID", error[:160])
    records = assemble(result.withColumn("target", F.lit(target)), "job_id").drop("error", "batch_error")
    if not records.limit(1).count():
        raise GenerationError("EMPTY_DATASET")
    return records, run
