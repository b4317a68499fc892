"""Validation, review, one revision, and revalidation of a generated dataset."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import review as R
from docloom.operators.provider_output import normalize_records, parse_outputs
from docloom.operators.quality import quality_summary, record_summaries, report_document
from docloom.operators.validation import check_records, record_name
from docloom.plans.generation import GenerationError, Provider, record_schema
from docloom.session import cut_lineage

_FIELDS = ("instruction", "input_text", "output_text", "context", "expected_output", "category", "difficulty", "source_refs", "evidence")


@dataclass
class Outcome:
    """A dataset with its report and what the review did."""

    records: DataFrame
    report: dict
    review: dict | None = None
    review_calls: int = 0
    revised: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class RevisionPolicy:
    """How often a dataset may be repaired or revised in all, and whether a review may ask for it."""

    max_revision_attempts: int = 1
    allow_quality_revision: bool = True


def validate(records: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept records, reports): exact duplicates removed, and the validation report of each job as JSON."""
    found = check_records(cut_lineage(records), sources)
    kept = found.records.join(found.marks.where(~F.col("is_duplicate")).drop("is_duplicate"), ["job_id", "rec_pos"])
    summaries = record_summaries(found.per_record, found.issues, kept.withColumn("record_id", record_name()))
    summary = quality_summary(found.records, found.grounding, found.issues, found.near, marks=found.marks)
    return kept, report_document(summary, found.grounding, found.issues, summaries)


def _one_job(records: DataFrame) -> list:
    """The records of one job, which a request bounds, in order."""
    return records.orderBy("rec_pos").collect()


def run_review(spark: SparkSession, records: DataFrame, report: dict, prompt: str, provider: Provider, max_model_len: int) -> tuple[DataFrame, dict, int]:
    """(issues, summary, calls): one call a review batch; a result that breaks the contract raises QUALITY_REVIEW_INVALID."""
    schema = R.review_schema()
    payload = cut_lineage(R.review_payload(records))
    prompts = records.select("job_id").distinct().withColumn("prompt", F.lit(prompt))
    batches = R.review_batches(R.review_costs(records), prompts, max_model_len)
    texts = {}
    for row in _one_job(payload.join(batches, ["job_id", "rec_pos"])):
        texts.setdefault(row.review_batch, []).append(json.loads(row.payload))
    ids = [p["record_id"] for own in texts.values() for p in own]
    counts = {f: {r.value: r.n for row in R.frequencies(records, f).collect() for r in row.counts} for f in ("category", "difficulty")}
    summary = {"schema_version": report["schema_version"], "grounding_status": report["grounding"]["status"], "grounded_records": report["grounding"]["grounded_records"], "category_counts": counts["category"], "difficulty_distribution": counts["difficulty"], "duplicate_warnings": report["duplicates"]}
    outputs = []
    for number, own in sorted(texts.items()) or [(1, [])]:
        body = json.dumps({"records": own, "validation_summary": summary}, ensure_ascii=False, sort_keys=True)
        messages = [{"role": "system", "content": R.SYSTEM}, {"role": "user", "content": f"{prompt}\nReview batch {number}, {len(own)} records\n\n{body}"}]
        outputs.append((number, provider.generate(messages, schema, min(2048, max_model_len // 8))))
    known = F.array(*[F.lit(i) for i in ids]).cast("array<string>")
    parsed = cut_lineage(R.parse_review(spark.createDataFrame(outputs, "batch int, output string"), known))
    if parsed.where(F.col("p.error").isNotNull()).limit(1).count():
        raise GenerationError("QUALITY_REVIEW_INVALID")
    issues = cut_lineage(parsed.select("batch", F.posexplode("p.issues").alias("pos", "i")).select(F.lit("job").alias("job_id"), "batch", "pos", "i.code", "i.record_ids", "i.message", "i.suggested_action"))
    result = R.summarize_review(issues, parsed.select(F.lit("job").alias("job_id"), "batch", F.col("p.summary").alias("summary"))).first().asDict()
    return issues, result | {"review_batch_count": len(outputs)}, len(outputs)


def revise(spark: SparkSession, records: DataFrame, issues: DataFrame, prompt: str, provider: Provider, max_tokens: int) -> tuple[DataFrame, list[str]]:
    """(records, revised ids): one replacement for each record that an issue names, in their places; others stay as they are.

    Refs of replacements are element ids already. A wrong number of replacements raises
    QUALITY_REVISION_INVALID, as does a review that names no record.
    """
    job = records.select("job_id").first().job_id
    named = issues.withColumn("job_id", F.lit(job))
    affected = cut_lineage(R.affected_records(records, named))
    rows = _one_job(affected)
    if not rows:
        raise GenerationError("QUALITY_REVISION_INVALID", "no record to revise")
    findings = [r.asDict() for r in issues.select("code", "record_ids", "message", "suggested_action").collect()]
    units = "\n".join(dict.fromkeys(f"[{e.source_ref}]\n{e.quote}" for r in _one_job(records) for e in r.evidence or ()))
    body = json.dumps({"records": [{f: r[f] for f in ("instruction", "context", "expected_output", "category", "difficulty", "source_refs")} | {"evidence": [e.asDict() for e in r.evidence]} for r in rows], "issues": findings}, ensure_ascii=False)
    output = provider.generate([{"role": "system", "content": "Replace each given record by a better one, as JSON of the given schema."}, {"role": "user", "content": f"{prompt}\n\n{body}\n\nUnits that may be cited, and quotes from them:\n{units}"}], record_schema(), max_tokens)
    parsed = parse_outputs(spark.createDataFrame([(job, output)], "job_id string, output string"))
    if parsed.where(F.col("error").isNotNull()).limit(1).count():
        raise GenerationError("QUALITY_REVISION_INVALID", "no records in the answer")
    given = cut_lineage(normalize_records(parsed, F.col("job_id"), F.lit(""), {}).withColumnRenamed("rec_in_batch", "new_pos"))
    placed = cut_lineage(R.pair_replacements(affected.select("job_id", "rec_pos", F.lit(records.count()).alias("total")), given.select("job_id", "new_pos")))
    if placed.where(F.col("error").isNotNull()).limit(1).count():
        raise GenerationError("QUALITY_REVISION_INVALID", "not one replacement a record")
    ids = F.try_element_at("metadata", F.lit("record_id"))
    codes = named.select("job_id", "code", F.explode("record_ids").alias("rid")).join(affected.select("job_id", "rec_pos", ids.alias("rid")), ["job_id", "rid"]).groupBy("job_id", "rec_pos").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("reason_codes"))
    new = placed.join(given.select("job_id", "new_pos", *_FIELDS), ["job_id", "new_pos"]).join(codes, ["job_id", "rec_pos"], "left")
    return R.apply_replacements(records, new, _FIELDS), [r.metadata.get("record_id", "") for r in rows]


def finish(spark: SparkSession, records: DataFrame, sources: DataFrame, prompt: str, provider: Provider | None = None, max_model_len: int = 32768, policy: RevisionPolicy = RevisionPolicy(), spent: int = 0, on_state: Callable[[str, int], None] = lambda state, percent: None) -> Outcome:
    """Validate a job's records, review them where there is a provider, revise within the policy, and validate again.

    ``spent`` counts the repairs of the generation, which share the policy's budget with revisions.
    ``on_state`` hears of each step with the percentage done. Raises VALIDATION_FAILED where the
    records fail, and QUALITY_REVIEW_BLOCKED where blocking issues cannot be or were not revised away.
    """

    def gate(rows: DataFrame) -> tuple[DataFrame, dict]:
        kept, reports = validate(rows, sources)
        found = reports.first()
        report = json.loads(found.report) if found else {"status": "failed"}
        if report["status"] == "failed":
            raise GenerationError("VALIDATION_FAILED")
        return cut_lineage(kept), report

    kept, report = gate(records)
    out = Outcome(kept, report)
    if provider is None:
        return out
    on_state("reviewing", 84)
    issues, out.review, out.review_calls = run_review(spark, kept, report, prompt, provider, max_model_len)
    if out.review["revision_required"]:
        if spent >= policy.max_revision_attempts or not policy.allow_quality_revision:
            raise GenerationError("QUALITY_REVIEW_BLOCKED", "no revision is left")
        on_state("revising", 89)
        changed, out.revised = revise(spark, kept, issues, prompt, provider, min(4096, max_model_len // 4))
        on_state("revalidating", 93)
        out.records, out.report = gate(changed)
        _, out.review, calls = run_review(spark, out.records, out.report, prompt, provider, max_model_len)
        out.review_calls += calls
        if out.review["revision_required"]:
            raise GenerationError("QUALITY_REVIEW_BLOCKED")
    out.report["qualityReview"] = out.review
    return out
