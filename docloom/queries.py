"""Queries over the project's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import batch_progress, download_name, extension, human_size, is_job_id, normalize_source, normalize_source_native, requested_count, safe_filename, semantic_text
from docloom.operators import batching, export, extraction, provider_output, quality, resolve, review, validation
from docloom.session import cut_lineage, read_table
from docloom.sources import files

OPTIONS = batching.BatchOptions(max_model_len=1024, records_per_batch=4, record_limit=14)


def _elements(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Elements once each, with the given columns or all; only those are shuffled."""
    table = read_table(spark, sf, "elements")
    return extraction.distinct_elements(table.select("doc_id", "element_id", "ingested_at", *columns) if columns else table)


def _records(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Records once each, with the given columns or all; only those are shuffled."""
    table = read_table(spark, sf, "records")
    return validation.distinct_records(table.select("record_id", "job_id", "rec_pos", "ingested_at", *columns) if columns else table)


def _evidence(records: DataFrame) -> DataFrame:
    return records.select("job_id", "rec_pos", F.posexplode("evidence").alias("ev_pos", "e")).select("job_id", "rec_pos", "ev_pos", "e.source_ref", "e.quote")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return _elements(spark, sf, "element_type", "text", "table_rows").groupBy(F.col("element_id").alias("source_ref")).agg(F.min(extraction.quoteable_text()).alias("source_text"))


def extract_elements(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract_lines(read_table(spark, sf, "documents")).select("doc_id", "element_id", "element_type", "ord", "text")


def section_paths(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract_lines(read_table(spark, sf, "documents")).select("doc_id", "ord", F.coalesce(F.get("section_path", F.lit(0)), F.lit("")).alias("section"))


def document_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.document_statistics(_elements(spark, sf, "element_type", "text", "page_number", "table_rows")).drop("warnings").fillna(0, ["page_count"])


def structure_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.structure_analysis(extraction.document_statistics(_elements(spark, sf, "element_type", "text", "page_number", "table_rows"))).fillna(0, ["available_page_count"])


def batch_plan(spark: SparkSession, sf: str) -> DataFrame:
    return batching.batch_units(_elements(spark, sf, "element_type", "text", "ord", "table_rows"), OPTIONS).select("doc_id", "element_id", "ord", "batch_no", "alias_no", "tokens")


def context_batches(spark: SparkSession, sf: str) -> DataFrame:
    units = batching.batch_units(_elements(spark, sf, "element_type", "text", "ord", "table_rows"), OPTIONS)
    return batching.context_batches(units, OPTIONS).select("doc_id", "batch_no", "batch_id", "estimated_input_tokens", "requested_records", F.size("source_element_ids").alias("units"), F.md5("text").alias("text_md5"))


def requested_counts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "jobs").distinct().select("job_id", requested_count(F.col("prompt"), 20).alias("requested"))


def alias_units(spark: SparkSession, sf: str) -> DataFrame:
    batches = read_table(spark, sf, "context_batches").select("batch_key", F.posexplode("source_element_ids").alias("pos", "element_id"))
    known = read_table(spark, sf, "elements").select("element_id").distinct().withColumn("known", F.lit(True))
    return batches.join(known, "element_id", "left").select("batch_key", F.concat(F.lit("source_"), (F.col("pos") + 1).cast("string")).alias("alias"), "element_id", F.coalesce("known", F.lit(False)).alias("known"))


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", F.md5(normalize_source("text")).alias("norm_md5"))


def structural_errors(spark: SparkSession, sf: str) -> DataFrame:
    return validation.structural_errors(_records(spark, sf, "instruction", "input_text", "output_text"))


def field_issues(spark: SparkSession, sf: str) -> DataFrame:
    return validation.field_issues(_records(spark, sf, "instruction", "input_text", "output_text", "context", "expected_output", "category", "difficulty")).select("job_id", "rec_pos", "code", "severity", "field")


def reference_issues(spark: SparkSession, sf: str) -> DataFrame:
    return validation.reference_issues(_records(spark, sf, "source_refs"), read_table(spark, sf, "elements"))


def evidence_checks(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf, "evidence")
    return validation.evidence_checks(_evidence(records), _sources(spark, sf)).select("job_id", "rec_pos", "ev_pos", F.coalesce("code", F.lit("VERIFIED")).alias("code"))


def evidence_checks_native(spark: SparkSession, sf: str) -> DataFrame:
    checked = validation.evidence_checks(_evidence(_records(spark, sf, "evidence")), _sources(spark, sf), normalize_source_native)
    return checked.select("job_id", "rec_pos", "ev_pos", F.coalesce("code", F.lit("VERIFIED")).alias("code"))


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return validation.exact_duplicates(_records(spark, sf, "instruction", "input_text", "output_text", "context", "expected_output", "category", "difficulty")).select("job_id", "rec_pos", "fingerprint", "is_duplicate")


def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return validation.near_duplicates(_records(spark, sf, "instruction", "input_text", "output_text", "context", "expected_output", "category", "difficulty"))


def _grounding(spark: SparkSession, sf: str, normalize=normalize_source) -> tuple[DataFrame, DataFrame]:
    records = _records(spark, sf)
    return records, validation.record_grounding(records, _evidence(records), _sources(spark, sf), normalize)


def grounding_summary(spark: SparkSession, sf: str) -> DataFrame:
    return validation.grounding_summary(*_grounding(spark, sf))


def grounding_summary_native(spark: SparkSession, sf: str) -> DataFrame:
    records, grounding = _grounding(spark, sf, normalize_source_native)
    return validation.grounding_summary(records, grounding, normalize=normalize_source_native).drop("grounding_percent")


def grounding_after_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return validation.grounding_summary(*_grounding(spark, sf), mode="post_dedup")


def _checked(spark: SparkSession, sf: str, near: DataFrame | None = None) -> validation.Checked:
    """All checks of the records, with every job of the table, also those without records."""
    records = cut_lineage(_records(spark, sf))
    return validation.check_records(records, _sources(spark, sf), read_table(spark, sf, "jobs"), near)


def _given_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that SQL can find, in the place of near-duplicate ones: equal instructions in a job."""
    one = _records(spark, sf, "instruction").where(F.col("instruction").isNotNull()).select("job_id", F.col("rec_pos").alias("left_pos"), "instruction")
    return one.join(one.withColumnRenamed("left_pos", "right_pos"), ["job_id", "instruction"]).where("left_pos < right_pos").select("job_id", "left_pos", "right_pos")


def _summary(found: validation.Checked, spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_summary(found.records, found.grounding, found.issues, found.near, marks=found.marks, jobs=read_table(spark, sf, "jobs"))


def _kept(found: validation.Checked) -> DataFrame:
    return found.records.join(found.marks.where(~F.col("is_duplicate")).select("job_id", "rec_pos"), ["job_id", "rec_pos"], "left_semi").withColumn("record_id", validation.record_name())


def quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(_checked(spark, sf), spark, sf)


def quality_summary_given(spark: SparkSession, sf: str) -> DataFrame:
    """The quality summary with given pairs, so that SQL can check it."""
    return _summary(_checked(spark, sf, _given_pairs(spark, sf)), spark, sf)


def record_summaries(spark: SparkSession, sf: str) -> DataFrame:
    found = _checked(spark, sf, _given_pairs(spark, sf))  # pairs have no part in a record's summary
    return quality.record_summaries(found.per_record, found.issues, _kept(found)).withColumn("issue_codes", F.array_join("issue_codes", ","))


def validation_overview(spark: SparkSession, sf: str) -> DataFrame:
    """What a caller sees of the quality summary with given pairs."""
    return quality.validation_overview(quality_summary_given(spark, sf))


def validation_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues in report order with given pairs."""
    issues = _checked(spark, sf, _given_pairs(spark, sf)).issues
    return issues.select("job_id", "issue_pos", F.coalesce("rec_pos", F.lit(-1)).alias("rec_pos"), "code", "severity", F.coalesce("field", F.lit("")).alias("field"), F.coalesce("record_id", F.lit("")).alias("record_id"))


def validation_reports(spark: SparkSession, sf: str) -> DataFrame:
    found = _checked(spark, sf)
    return quality.report_document(_summary(found, spark, sf), found.grounding, found.issues, quality.record_summaries(found.per_record, found.issues, _kept(found)))


def provider_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as answers of twelve shapes, good and bad, and what the parser makes of them."""
    records = _records(spark, sf).withColumn("instruction", F.coalesce("instruction", F.lit("")))
    item = F.struct("instruction", F.lit("C").alias("context"))
    body = F.to_json(F.struct(F.array(item).alias("records")))
    said = lambda text: F.to_json(F.struct(F.lit("x").alias("id"), F.array(F.struct(F.struct(F.lit("assistant").alias("role"), text.alias("content")).alias("message"))).alias("choices")))
    failed = F.lit('{"id": "x", "error": {"message": "m"}}')
    shapes = [
        body, F.concat(F.lit("["), said(body), F.lit("]")), F.to_json(F.struct(F.lit("x").alias("id"), F.array(F.struct(body.alias("text"))).alias("choices"))), failed, F.to_json(F.array(item)), said(F.concat(F.lit("```json\n"), body, F.lit("\n```"))),
        F.lit("[1, 2]"), F.lit('{"id": "x", "choices": []}'), F.to_json(F.struct(F.array(F.struct(F.struct(body.alias("reasoning")).alias("message"))).alias("choices"))), F.concat(F.lit("["), failed, F.lit("]")), said(F.concat(F.lit("Here: "), body, F.lit(" done"))), F.concat(F.lit("["), F.to_json(item), F.lit(', {"id": 3}]')),
    ]
    raw = records.select("record_id", F.get(F.array(*shapes), (F.col("record_id") % len(shapes)).cast("int")).alias("output"))
    return provider_output.parse_outputs(raw).select("record_id", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("item.instruction", F.lit("")).alias("instruction"))


def csv_projection(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf)
    return export.csv_projection(records)


def provider_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as chat results and parsed back."""
    records = _records(spark, sf)
    item = F.struct("instruction", "context", "expected_output", "category", "difficulty", "source_refs", "evidence")
    content = F.to_json(F.struct(F.array(item).alias("records")))
    fence = F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("```json\n"), content, F.lit("\n```"))).when(F.col("record_id") % 3 == 1, F.concat(F.lit("Here it is: "), content)).otherwise(content)
    raw = records.select("record_id", F.to_json(F.struct(F.array(F.struct(F.struct(fence.alias("content")).alias("message"))).alias("choices"))).alias("output"))
    parsed = provider_output.normalize_records(provider_output.parse_outputs(raw), F.lit("g"), F.lit("f"), {})
    return parsed.select("record_id", "instruction", "context", "expected_output", "category", "difficulty", F.size("source_refs").alias("refs"), F.size("evidence").alias("evidence_items"))


def assembled_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records taken in batches of four, cut at what their job asked for."""
    asked = read_table(spark, sf, "jobs").groupBy("job_id").agg(F.max(requested_count(F.col("prompt"), 20)).alias("target"))
    batches = _records(spark, sf, "metadata").withColumn("batch_no", F.floor(F.col("rec_pos") / 4).cast("int") + 1).withColumn("rec_in_batch", F.col("rec_pos") % 4).drop("rec_pos")
    out = resolve.assemble(batches.join(asked, "job_id"))
    return out.select("record_id", "job_id", "rec_pos", F.element_at("metadata", "record_id").alias("name"))


def category_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    counts = review.frequencies(_records(spark, sf, "category"), "category").select("job_id", F.inline("counts"))
    return counts.select("job_id", F.col("value").alias("category"), "n")


def review_batches(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf)
    return review.review_batches(review.review_costs(records), read_table(spark, sf, "jobs").select("job_id", "prompt"), 4096)


def review_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Review findings derived from the records, summarised by the application's rules."""
    codes = F.array(*map(F.lit, review.CODES))
    found = _records(spark, sf, "category").select("job_id", F.lit(1).alias("batch"), F.col("rec_pos").alias("pos"), F.get(codes, (F.col("record_id") % len(review.CODES)).cast("int")).alias("code"))
    summaries = found.select("job_id", "batch").distinct().select("job_id", "batch", F.concat(F.lit("Reviewed "), "job_id").alias("summary"))
    return review.summarize_review(found, summaries).withColumn("codes", F.array_join("codes", ","))


def revised_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of an unknown difficulty replaced by ones of the default."""
    records = _records(spark, sf).withColumn("difficulty", F.coalesce("difficulty", F.lit("")))
    wrong = records.where(~F.col("difficulty").isin(*validation.DIFFICULTIES)).select("job_id", "rec_pos", F.lit("medium").alias("difficulty"), F.lit("DIFFICULTY_MISMATCH").alias("reason_codes"))
    out = review.apply_replacements(records, wrong, ("difficulty",))
    return out.select("record_id", "difficulty", F.coalesce(F.try_element_at("metadata", F.lit("revision_reason_codes")), F.lit("")).alias("reason"))


def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    names = read_table(spark, sf, "normalized_documents").select("doc_id", "source_filename").distinct()
    safe = safe_filename(F.col("source_filename"))
    return names.select("doc_id", safe.alias("safe_name"), extension(safe).alias("extension"), download_name(F.col("source_filename")).alias("download"))


def semantic_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf, "instruction", "input_text", "output_text", "context", "expected_output", "category", "difficulty").select("record_id", F.md5(semantic_text()).alias("semantic_md5"))


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    counts = _records(spark, sf, "category").groupBy("job_id").agg(F.count(F.lit(1)).alias("record_count"))
    jobs = read_table(spark, sf, "jobs").distinct().join(counts, "job_id")
    return export.manifest(jobs, F.col("created_at"), {"schema_version": quality.SCHEMA_VERSION})


def package_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Flat package metadata of every job, with a report of its status and record counts and no review."""
    made = manifests(spark, sf)
    counts = _records(spark, sf, "category").groupBy("job_id").agg(F.count(F.lit(1)).alias("final_record_count"))
    reports = counts.select("job_id", F.to_json(F.struct(F.lit("passed").alias("status"), F.struct("final_record_count").alias("quality"))).alias("report"))
    return export.package_metadata(made, reports)


def resolved_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records with their refs written as the aliases of their job's units, and resolved again."""
    listed = read_table(spark, sf, "context_batches").select("job_id", "batch_no", F.posexplode("source_element_ids").alias("pos", "element_id"))
    first = listed.groupBy("job_id", "element_id").agg(F.min(F.struct("batch_no", "pos")).alias("at"))
    numbered = first.withColumn("alias_no", F.row_number().over(Window.partitionBy("job_id").orderBy("at")))
    units = numbered.join(_sources(spark, sf).withColumnRenamed("source_ref", "element_id"), "element_id").select("job_id", "alias_no", "element_id", F.col("source_text").alias("full_text"))
    names = numbered.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("element_id", F.concat(F.lit("source_"), F.col("alias_no").cast("string"))))).alias("names"))
    alias = lambda ref: F.coalesce(F.try_element_at("names", F.coalesce(ref, F.lit(""))), F.lit("source_0"))
    records = _records(spark, sf, "source_refs", "evidence").join(names, "job_id").select("job_id", F.col("rec_pos").alias("rec_in_batch"), F.transform("source_refs", alias).alias("source_refs"), F.transform("evidence", lambda e: F.struct(alias(e.source_ref).alias("source_ref"), e.quote.alias("quote"))).alias("evidence"))
    out = resolve.resolve_aliases(records, units, ("job_id",))
    return out.select("job_id", F.col("rec_in_batch").alias("rec_pos"), F.coalesce("batch_error", F.lit("")).alias("error"), F.when(F.col("batch_error").isNull(), F.array_join("source_refs", ",")).otherwise("").alias("refs"))


def label_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of elements by labels made of their types."""
    rows = read_table(spark, sf, "elements").select("element_id", "element_type").distinct()
    return rows.select("element_id", extraction.label_kind(F.col("element_type")).alias("kind"), extraction.label_kind(F.concat(F.lit("Section_"), F.upper("element_type"))).alias("section_kind"))


def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and cells of tables, read back from their quotable text."""
    tables = _elements(spark, sf, "element_type", "text", "table_rows").where("element_type = 'table'")
    cells = extraction.table_rows(extraction.quoteable_text())
    return tables.select("element_id", F.size(cells).alias("n_rows"), F.md5(F.array_join(F.transform(cells, lambda row: F.array_join(row, "¦")), "\n")).alias("cells_md5"))


def record_names(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf, "metadata").select("record_id", validation.record_name().alias("name"), is_job_id(F.col("job_id")).alias("job_id_valid"))


def document_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", human_size(F.col("n_chars")).alias("size"))


def batch_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The number and total of progress texts made of context batches."""
    batches = read_table(spark, sf, "context_batches")
    totals = batches.groupBy("job_id").agg(F.max("batch_no").alias("last"))
    step = batch_progress(F.concat(F.lit("batch "), F.col("batch_no").cast("string"), F.lit(" of "), F.col("last").cast("string")))
    return batches.join(totals, "job_id").select("batch_key", step.alias("step")).select("batch_key", "step.number", "step.total")


def review_parses(spark: SparkSession, sf: str) -> DataFrame:
    """Review results of six shapes, good and bad, made of the records, and what the strict parser makes of them."""
    name = F.col("record_id").cast("string")
    issue = lambda code, who: F.struct(F.lit(code).alias("code"), F.lit("warning").alias("severity"), F.array(who).alias("record_ids"), F.lit("m").alias("message"), F.lit("a").alias("suggested_action"))
    result = lambda issues, summary, *more: F.to_json(F.struct(F.array(*issues).alias("issues"), summary.alias("summary"), *more))
    said = F.concat(F.lit("Reviewed "), name)
    good = result([issue("WEAK_CONTEXT", name)], said)
    shapes = [good, result([issue("WEAK_CONTEXT", F.lit("none"))], said), result([issue("WEAK_CONTEXT", name)], said, F.lit(5).alias("grade")), result([issue("NEW_CODE", name)], said), result([issue("WEAK_CONTEXT", name)], F.lit(7)), F.to_json(F.struct(F.lit("x").alias("id"), F.array(F.struct(F.struct(good.alias("content")).alias("message"))).alias("choices")))]
    raw = _records(spark, sf, "category").select("record_id", F.get(F.array(*shapes), (F.col("record_id") % len(shapes)).cast("int")).alias("output"))
    parsed = review.parse_review(raw, F.array(name))
    return parsed.select("record_id", F.coalesce("p.error", F.lit("")).alias("error"), F.coalesce(F.size("p.issues"), F.lit(0)).alias("issues"), F.coalesce("p.summary", F.lit("")).alias("summary"))


def top_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The first five of the findings of :func:`review_summary`, as a page shows them."""
    found = _records(spark, sf, "category").select("job_id", F.lit(1).alias("batch"), F.col("rec_pos").alias("pos"), "record_id")
    return review.top_issues(found).select("job_id", "pos", "record_id")


def replacement_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Records of an unknown difficulty with replacements by position: as many as asked for, a full dataset, or one too many, by the job's id."""
    records = _records(spark, sf, "difficulty")
    totals = records.groupBy("job_id").agg(F.count(F.lit(1)).cast("int").alias("total"))
    affected = records.where(~F.coalesce("difficulty", F.lit("")).isin(*validation.DIFFICULTIES)).join(totals, "job_id").select("job_id", "rec_pos", "total")
    asked = affected.groupBy("job_id").agg(F.count(F.lit(1)).cast("int").alias("asked"), F.max("total").alias("total"))
    first = F.substring("job_id", 1, 1)
    given = F.when(first < "8", F.col("asked")).when(first < "c", F.col("total")).otherwise(F.col("asked") + 1)
    replacements = asked.select("job_id", F.explode(F.sequence(F.lit(0), given - 1)).alias("new_pos"))
    return review.pair_replacements(affected, replacements).select("job_id", "rec_pos", F.coalesce("new_pos", F.lit(-1)).cast("int").alias("new_pos"), F.coalesce("error", F.lit("")).alias("error"))


def decoded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts written as bytes, as UTF-8 with a mark or in a one-byte charset where it has all their characters, and decoded."""
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))
    narrow = F.col("text").rlike(r"^[\x00-\x7F\x{A0}-\x{FF}]*$")
    content = F.when(F.col("doc_id") % 2 == 0, marked).when(narrow, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    texts = read_table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", content.alias("content"))
    return texts.select("doc_id", F.md5(files.decode_text(F.col("content"))).alias("text_md5"))


def report_fields(spark: SparkSession, sf: str) -> DataFrame:
    """What stands in the validation reports, with given pairs, read back from their JSON."""
    found = _checked(spark, sf, _given_pairs(spark, sf))
    reports = quality.report_document(_summary(found, spark, sf), found.grounding, found.issues, quality.record_summaries(found.per_record, found.issues, _kept(found)))
    at = lambda path: F.get_json_object("report", f"$.{path}")
    return reports.select("job_id", at("status").alias("status"), at("records.final").cast("long").alias("final"), F.json_array_length(at("records.recordSummaries")).alias("summaries"), at("grounding.grounding_percent").cast("double").alias("grounding_percent"), F.json_array_length(at("issues")).alias("issues"), F.json_array_length(at("quality.warnings")).alias("warnings"), at("quality.difficulty_distribution.easy").cast("long").alias("easy"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        document_statistics, structure_analysis, extract_elements, section_paths, batch_plan, context_batches, requested_counts, alias_units, normalize_text, structural_errors, field_issues, reference_issues,
        evidence_checks, evidence_checks_native, exact_duplicates, near_duplicates, grounding_summary, grounding_summary_native, grounding_after_dedup, quality_summary, quality_summary_given, record_summaries, validation_overview, validation_issues, validation_reports,
        csv_projection, provider_parse, provider_shapes, assembled_records, category_frequencies, review_batches, review_summary, revised_records, safe_names, semantic_texts, manifests, package_metadata,
        resolved_records, label_kinds, table_cells, record_names, document_sizes, batch_steps, review_parses, top_issues, replacement_pairs, decoded_texts, report_fields,
    )
}
