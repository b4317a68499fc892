"""Quality report of each job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import normalize_source, strip
from docloom.operators.validation import DIFFICULTIES, NEAR_DUPLICATE, exact_duplicates

SCHEMA_VERSION = "2.0"


def quality_summary(records: DataFrame, grounding: DataFrame, issues: DataFrame, near: DataFrame, normalize=normalize_source, marks: DataFrame | None = None, jobs: DataFrame | None = None) -> DataFrame:
    """Counters and status of each job: failed over passed_with_warnings over passed.

    Difficulties have a column each, so that absent ones count zero. All inputs are aggregated by
    job before they are joined. ``marks`` has duplicates found before; with ``jobs`` (job_id), jobs
    without records have a row of zeros.
    """
    marks = exact_duplicates(records, normalize) if marks is None else records.join(marks, ["job_id", "rec_pos"])
    category = strip(F.coalesce("category", F.lit("")))
    kept = ~F.col("is_duplicate")
    counts = marks.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("generated"),
        F.count_if(kept).alias("final"),
        F.count_if(~kept).alias("exact_duplicates_removed"),
        F.countDistinct(F.when(kept & (category != ""), category)).alias("category_count"),
        *[F.count_if(kept & (F.col("difficulty") == d)).alias(f"{d}_count") for d in DIFFICULTIES],
    )
    if jobs is not None:
        counts = jobs.select("job_id").distinct().join(counts, "job_id", "left").fillna(0)
    by_severity = issues.groupBy("job_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    pairs = near.groupBy("job_id").agg(F.count(F.lit(1)).alias("near_duplicate_pairs"))
    out = counts.join(by_severity, "job_id", "left").join(pairs, "job_id", "left").join(grounding.select("job_id", F.col("grounded_records").alias("valid"), F.col("status").alias("grounding_status")), "job_id", "left")
    out = out.fillna(0, ["errors", "warnings", "near_duplicate_pairs", "valid"]).fillna("failed", ["grounding_status"])
    status = F.when((F.col("errors") > 0) | (F.col("grounding_status") == "failed"), "failed").when(F.col("warnings") > 0, "passed_with_warnings").otherwise("passed")
    return out.withColumn("invalid", F.greatest(F.lit(0), F.col("final") - F.col("valid"))).withColumn("schema_valid", F.col("errors") == 0).withColumn("status", status)


def record_summaries(grounding: DataFrame, issues: DataFrame, kept: DataFrame) -> DataFrame:
    """(job_id, rec_pos, grounding_status, source_refs, evidence_items, verified, issue_codes) of each kept record, codes in report order.

    ``grounding`` is by record, ``issues`` is numbered, ``kept`` has the records that stay, once each, with
    record_id where it is wanted.
    """
    codes = issues.where(F.col("rec_pos").isNotNull()).groupBy("job_id", "rec_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("issue_pos", "code"))), lambda i: i.code).alias("issue_codes"))
    name = [c for c in ("record_id",) if c in kept.columns]
    joined = grounding.join(kept.select("job_id", "rec_pos", *name), ["job_id", "rec_pos"]).join(codes, ["job_id", "rec_pos"], "left")
    passed = (F.col("verified") > 0) & (F.col("errors") == 0)
    return joined.select("job_id", "rec_pos", *name, F.when(passed, "passed").otherwise("failed").alias("grounding_status"), F.col("refs").alias("source_refs"), "evidence_items", "verified", F.coalesce("issue_codes", F.array().cast("array<string>")).alias("issue_codes"))


def validation_overview(summary: DataFrame) -> DataFrame:
    """The part of a quality summary that a caller of a job sees."""
    return summary.select("job_id", "status", "schema_valid", "generated", "final", "valid", "invalid", "exact_duplicates_removed", "near_duplicate_pairs", "warnings")


_ISSUE = "array<struct<issue_pos:int,code:string,severity:string,message:string,record_id:string,field:string>>"
_SUMMARY = "array<struct<rec_pos:int,recordId:string,groundingStatus:string,sourceRefs:int,evidenceItems:bigint,verifiedEvidenceItems:bigint,issueCodes:array<string>>>"


def report_document(summary: DataFrame, grounding: DataFrame, issues: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(job_id, report): the validation report of each job as JSON; absent values stay as nulls.

    ``summaries`` are the record summaries with record_id. A report is one document, so it holds all
    issues of its job; issues and summaries are put in order inside the array, not by a sort of rows.
    """
    listed = issues.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("issue_pos", "code", "severity", "message", "record_id", "field"))).alias("issues"))
    totals = grounding.withColumnRenamed("status", "g_status")
    whole = summary.join(totals, "job_id", "left").fillna(0, [c for c, t in totals.dtypes if t in ("bigint", "int", "double")]).fillna("failed", ["g_status"]).join(listed, "job_id", "left")
    if summaries is not None:
        each = F.struct("rec_pos", F.col("record_id").alias("recordId"), F.col("grounding_status").alias("groundingStatus"), F.col("source_refs").alias("sourceRefs"), F.col("evidence_items").alias("evidenceItems"), F.col("verified").alias("verifiedEvidenceItems"), F.col("issue_codes").alias("issueCodes"))
        whole = whole.join(summaries.groupBy("job_id").agg(F.array_sort(F.collect_list(each)).alias("summaries")), "job_id", "left")
    else:
        whole = whole.withColumn("summaries", F.lit(None).cast(_SUMMARY))
    shown = F.transform(F.coalesce("issues", F.array().cast(_ISSUE)), lambda i: F.struct(i.code.alias("code"), i.severity.alias("severity"), i.message.alias("message"), i.record_id.alias("record_id"), i.field.alias("field")))
    per_record = F.transform(F.coalesce("summaries", F.array().cast(_SUMMARY)), lambda r: F.struct(r.recordId.alias("recordId"), r.groundingStatus.alias("groundingStatus"), r.sourceRefs.alias("sourceRefs"), r.evidenceItems.alias("evidenceItems"), r.verifiedEvidenceItems.alias("verifiedEvidenceItems"), r.issueCodes.alias("issueCodes")))
    difficulties = F.create_map(*[x for d in DIFFICULTIES for x in (F.lit(d), F.col(f"{d}_count"))])
    report = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.col("status"),
        F.col("schema_valid"),
        F.struct("generated", "final", "valid", "invalid", per_record.alias("recordSummaries")).alias("records"),
        F.struct(F.col("g_status").alias("status"), "total_records", "grounded_records", "ungrounded_records", F.col("total_evidence").alias("total_evidence_items"), F.col("verified_evidence").alias("verified_evidence_items"), F.col("failed_evidence").alias("failed_evidence_items"), "grounding_percent").alias("grounding"),
        F.struct(F.col("exact_duplicates_removed").alias("exactDuplicatesRemoved"), F.col("near_duplicate_pairs").alias("nearDuplicatePairs"), F.lit(NEAR_DUPLICATE).alias("nearDuplicateThreshold"), F.lit("SequenceMatcher").alias("method")).alias("duplicates"),
        F.struct(
            F.col("status"),
            F.col("schema_valid"),
            F.col("generated").alias("total_generated_records"),
            F.col("final").alias("final_record_count"),
            F.col("valid").alias("valid_records"),
            F.col("invalid").alias("invalid_records"),
            "category_count",
            difficulties.alias("difficulty_distribution"),
            "exact_duplicates_removed",
            "near_duplicate_pairs",
            F.filter(shown, lambda i: i.severity == "warning").alias("warnings"),
        ).alias("quality"),
        shown.alias("issues"),
    )
    return whole.select("job_id", F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))
