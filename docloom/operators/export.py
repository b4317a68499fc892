"""Records to files."""

from __future__ import annotations

import json
import re
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the CSV file, in order.
CSV_COLUMNS = ("instruction", "input", "output", "metadata", "context", "expected_output", "category", "difficulty", "source_refs", "evidence")
_GUARDED = ("instruction", "input", "output", "context", "expected_output")


def safe_cell(value: Column, strict: bool = False) -> Column:
    """A cell that no spreadsheet takes for a formula; ``strict`` also guards against leading blanks."""
    return F.when(value.rlike(r"^[\t\r\n ]*[=+\-@]" if strict else r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def csv_projection(records: DataFrame, strict_guard: bool = False) -> DataFrame:
    """The CSV columns: five guarded texts, nested values as JSON with sorted keys. Nulls become empty."""
    source = {"input": "input_text", "output": "output_text"}
    plain = lambda c: F.coalesce(F.col(source.get(c, c)), F.lit(""))
    out = []
    for c in CSV_COLUMNS:
        if c == "metadata":
            entries = F.array_sort(F.map_entries(F.coalesce(F.col(c), F.create_map().cast("map<string,string>"))))
            out.append(F.to_json(F.map_from_entries(entries)).alias(c))
        elif c == "source_refs":
            out.append(F.to_json(F.coalesce(F.col(c), F.array().cast("array<string>"))).alias(c))
        elif c == "evidence":
            items = F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<source_ref:string,quote:string>>")), lambda e: F.struct(e.quote.alias("quote"), e.source_ref.alias("source_ref")))
            out.append(F.to_json(items, {"ignoreNullFields": "false"}).alias(c))
        else:
            out.append((safe_cell(plain(c), strict_guard) if c in _GUARDED else plain(c)).alias(c))
    return records.select(*out)


def write_csv(records: DataFrame, path: str, strict_guard: bool = False) -> None:
    """CSV files with a header, quotes doubled and CRLF line ends, one per partition."""
    csv_projection(records, strict_guard).write.mode("overwrite").options(header=True, escape='"', lineSep="\r\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(path)


def write_json_lines(records: DataFrame, path: str) -> None:
    """JSON lines, one file per partition; the form for datasets of any size."""
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_array(records: DataFrame, path: Path) -> int:
    """One pretty JSON array of a single dataset in rec_pos order, streamed to the driver a partition at a time; returns its length."""
    n = 0
    with path.open("w", encoding="utf-8") as out:
        out.write("[")
        for row in records.orderBy("rec_pos").toLocalIterator():
            body = json.dumps(row.asDict(recursive=True), indent=2, default=str)
            out.write(("," if n else "") + "\n  " + body.replace("\n", "\n  "))
            n += 1
        out.write("\n]" if n else "]")
    return n


def manifest(jobs: DataFrame, created_at: Column, versions: dict[str, str]) -> DataFrame:
    """(job_id, manifest): what a package says about its making, as JSON; the clock is given."""
    fields = F.struct("job_id", F.col("doc_id").alias("file_id"), *(c for c in ("source_file", "validation_status") if c in jobs.columns), F.col("output_format").alias("format"), "record_count", created_at.cast("string").alias("created_at"), *[F.lit(v).alias(k) for k, v in versions.items()])
    return jobs.select("job_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("manifest"))


#: Keys of a provider's metrics that a diagnosis may show.
DIAGNOSTICS = ("submitted", "created", "completed", "failed", "polls", "retries", "cancels")


def diagnostics(metrics: Column) -> Column:
    """Those metrics of a map that may be shown, as whole numbers."""
    return F.transform_values(F.map_filter(metrics, lambda k, v: k.isin(*DIAGNOSTICS)), lambda k, v: v.cast("int"))


# The flat fields of a package's metadata and where each comes from: a path in the manifest, report or review, and what stands for a missing one.
METADATA_FIELDS = (
    ("datasetName", "", "dataset"), ("sourceFile", "manifest.source_file", None), ("recordCount", "manifest.record_count", None), ("format", "manifest.format", None), ("generatedAt", "manifest.created_at", None),
    ("schemaVersion", "manifest.schema_version", None), ("generationMode", "manifest.phase", None), ("provider", "manifest.provider", None), ("model", "manifest.model", None), ("promptVersion", "manifest.prompt_version", None),
    ("validationStatus", "report.status", "manifest.validation_status"), ("groundingStatus", "report.grounding.status", "not_evaluated"), ("groundedRecords", "report.grounding.grounded_records", 0),
    ("finalRecordCount", "report.quality.final_record_count", "manifest.record_count"), ("exactDuplicatesRemoved", "report.quality.exact_duplicates_removed", 0), ("nearDuplicateCount", "report.quality.near_duplicate_pairs", 0),
    ("qualityReviewVersion", "review.reviewVersion", None), ("reviewProvider", "review.provider", None), ("reviewModel", "review.model", None), ("reviewPromptVersion", "review.promptVersion", None),
    ("reviewStatus", "review.status", "not_evaluated"), ("revisionAttempted", "review.revisionAttempted", False), ("revisionSucceeded", "review.revisionSucceeded", False), ("revisionCount", "review.revisionAttempted", 0),
)


def package_metadata(manifests: DataFrame, reports: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """(job_id, metadata): one flat JSON document a job of METADATA_FIELDS, from its manifest, report and review as JSON.

    ``manifests`` has job_id and manifest, ``reports`` job_id and report, ``reviews`` job_id and
    review; jobs without a report or review get what stands for the missing values.
    """
    joined = manifests.join(reports.select("job_id", "report"), "job_id", "left")
    joined = joined.join(reviews.select("job_id", "review"), "job_id", "left") if reviews is not None else joined.withColumn("review", F.lit(None).cast("string"))
    parts = joined.select("job_id", *[F.try_parse_json(c).alias(c) for c in ("manifest", "report", "review")])

    def at(path: str) -> Column:
        source, _, inside = path.partition(".")
        return F.try_variant_get(source, f"$.{inside}", "variant")

    def field(name: str, path: str, other: object) -> Column:
        if not path:
            return F.parse_json(F.lit(json.dumps(other)))
        if name == "revisionCount":
            return F.parse_json(F.when(F.coalesce(F.try_variant_get("review", "$.revisionAttempted", "boolean"), F.lit(False)), "1").otherwise("0"))
        rest = at(other) if isinstance(other, str) and other.startswith("manifest.") else F.parse_json(F.lit(json.dumps(other)))
        return F.coalesce(at(path), rest)

    return parts.select("job_id", F.to_json(F.struct(*[field(*f).alias(f[0]) for f in METADATA_FIELDS]), {"ignoreNullFields": "false"}).alias("metadata"))


def ready_package(folder: Path, job_id: str, status: str) -> Path | None:
    """The archive of a job that a caller may have: of a completed job with a well-formed id, and only where it exists."""
    archive = folder / job_id / "dataset.zip"
    return archive if re.fullmatch("[A-Za-z0-9]{32}", job_id) and status == "completed" and archive.is_file() else None


def package(dataset: Path, destination: Path, manifest_json: str, metadata_json: str, report_json: str | None = None, review_json: str | None = None) -> Path:
    """A ZIP file of one dataset with its manifest, metadata and read-me, and the report and review where given."""
    with zipfile.ZipFile(destination, "w", zipfile.ZIP_DEFLATED) as out:
        out.write(dataset, f"dataset/{dataset.name}")
        out.writestr("dataset/manifest.json", manifest_json)
        out.writestr("manifest.json", manifest_json)
        out.writestr("metadata.json", metadata_json)
        out.writestr("README.txt", f"Dataset package: dataset/{dataset.name} with its manifest and metadata.\n")
        if report_json is not None:
            out.writestr("validation-report.json", report_json)
        if review_json is not None:
            out.writestr("quality-review.json", review_json)
    return destination
