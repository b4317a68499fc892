"""Quality review of records by a model: payload, strict parsing, severity, and applying revisions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import chars_to_tokens, json_text_length, strip
from docloom.operators.provider_output import assistant_content, unfenced

# Fixed values of the review contract.
CODES = ("REPETITIVE_RECORDS", "LOW_INSTRUCTION_DIVERSITY", "WEAK_CONTEXT", "WEAK_EXPECTED_OUTPUT", "AMBIGUOUS_INSTRUCTION", "DIFFICULTY_MISMATCH", "CATEGORY_INCONSISTENCY", "REDUNDANT_TEST_CASE", "SOURCE_SUPPORT_CONCERN", "OVERLY_BROAD_ANSWER", "OVERLY_TRIVIAL_RECORD", "POOR_DATASET_COVERAGE", "OTHER_BOUNDED_QUALITY_ISSUE")
BLOCKING = ("AMBIGUOUS_INSTRUCTION", "SOURCE_SUPPORT_CONCERN")
SEVERITIES = ("warning", "blocking")
MAX_ISSUES, MAX_MESSAGE, MAX_ACTION, MAX_SUMMARY = 25, 320, 240, 500
NO_ISSUES = "No actionable quality issues were identified."
_ISSUE_KEYS = ("code", "severity", "record_ids", "message", "suggested_action")


def review_payload(records: DataFrame) -> DataFrame:
    """(job_id, rec_pos, payload): each record's eight reviewed fields as JSON."""
    record_id = F.coalesce(F.try_element_at("metadata", F.lit("record_id")), F.lit(""))
    fields = F.struct(record_id.alias("record_id"), "instruction", "context", "expected_output", "category", "difficulty", "source_refs", "evidence")
    return records.select("job_id", "rec_pos", F.to_json(fields, {"ignoreNullFields": "false"}).alias("payload"))


def frequencies(records: DataFrame, field: str) -> DataFrame:
    """(job_id, counts): how often each value of a field occurs in a job, sorted by value."""
    per = records.groupBy("job_id", F.coalesce(field, F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("counts"))


def review_schema() -> dict:
    """JSON schema of a review; names and limits are fixed values of the contract."""
    text = lambda n: {"type": "string", "minLength": 1, "maxLength": n}
    fields = {"code": {"type": "string", "enum": sorted(CODES)}, "severity": {"type": "string", "enum": list(SEVERITIES)}, "record_ids": {"type": "array", "items": {"type": "string"}, "maxItems": 20}, "message": text(MAX_MESSAGE), "suggested_action": text(MAX_ACTION)}
    issue = {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}
    return {"type": "object", "properties": {"issues": {"type": "array", "maxItems": MAX_ISSUES, "items": issue}, "summary": {"type": "string", "maxLength": MAX_SUMMARY}}, "required": ["issues", "summary"], "additionalProperties": False}


#: Task of the reviewer; it counts in every batch.
SYSTEM = "Review the dataset records and give findings as JSON of the given schema."

# The fields of a record as one JSON document, in order, and the columns that hold them.
RECORD_FIELDS = {"instruction": "instruction", "input": "input_text", "output": "output_text", "metadata": "metadata", "context": "context", "expected_output": "expected_output", "category": "category", "difficulty": "difficulty", "source_refs": "source_refs", "evidence": "evidence"}


def record_json_length() -> Column:
    """Characters of a whole record as JSON with ", " and ": " between its parts, metadata included."""
    comma = lambda n: F.lit(2) * F.greatest(F.lit(0), n - 1)
    total = lambda values: F.aggregate(values, F.lit(0), lambda acc, n: acc + n)
    texts = F.coalesce("source_refs", F.array().cast("array<string>"))
    quotes = F.coalesce("evidence", F.array().cast("array<struct<source_ref:string,quote:string>>"))
    entries = F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    lengths = {
        "metadata": F.lit(2) + comma(F.size(entries)) + total(F.transform(entries, lambda e: json_text_length(e.key) + 2 + json_text_length(e.value))),
        "source_refs": F.lit(2) + comma(F.size(texts)) + total(F.transform(texts, json_text_length)),
        "evidence": F.lit(2) + comma(F.size(quotes)) + total(F.transform(quotes, lambda e: F.lit(len('{"source_ref": , "quote": }')) + json_text_length(e.source_ref) + json_text_length(e.quote))),
    }
    frame = sum(len(name) + 4 for name in RECORD_FIELDS) + 2 * (len(RECORD_FIELDS) - 1) + 2
    return sum((lengths.get(name, json_text_length(F.col(column))) for name, column in RECORD_FIELDS.items()), F.lit(frame))


def review_costs(records: DataFrame) -> DataFrame:
    """(job_id, rec_pos, cost): estimated tokens of each record."""
    return records.select("job_id", "rec_pos", chars_to_tokens(record_json_length()).alias("cost"))


def review_batches(costs: DataFrame, prompts: DataFrame, max_model_len: int, system: str = SYSTEM) -> DataFrame:
    """(job_id, rec_pos, review_batch): records packed in order into review batches by estimated tokens.

    ``prompts`` (job_id, prompt) has a row a job; without one the prompt is empty. The system text and
    the prompt count in every batch, the schema in the first only. The rule needs the sum of the
    record before, so a job is one sorted run; it sees only sizes and holds three integers.
    """
    budget = max(1024, int(max_model_len * 0.5))
    schema = max(1, (len(json.dumps(review_schema(), sort_keys=True)) + 3) // 4)
    asked = prompts.groupBy("job_id").agg(F.max(F.length("prompt")).alias("chars"))
    priced = costs.join(asked, "job_id", "left").select("job_id", "rec_pos", "cost", chars_to_tokens(F.coalesce("chars", F.lit(0)) + len(system)).alias("fixed"))
    kind = costs.schema["job_id"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, number, held, tokens = object(), 0, 0, 0
        for batch in batches:
            numbers = []
            for key, cost, fixed in zip(batch["job_id"], batch["cost"], batch["fixed"]):
                if key != job:
                    job, number, held, tokens = key, 1, 0, fixed + schema
                elif held and tokens + cost > budget:
                    number, held, tokens = number + 1, 0, fixed
                held, tokens = held + 1, tokens + cost
                numbers.append(number)
            yield pd.DataFrame({"job_id": batch["job_id"], "rec_pos": batch["rec_pos"], "review_batch": numbers})

    ordered = priced.repartition("job_id").sortWithinPartitions("job_id", "rec_pos")
    return ordered.mapInPandas(fold, f"job_id {kind}, rec_pos int, review_batch int")


def top_issues(issues: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` issues of each job by batch and pos, as a job's page shows them."""
    order = Window.partitionBy("job_id").orderBy("batch", "pos")
    return issues.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def severity_of(code: Column) -> Column:
    """The application's severity of a code; what a model says is ignored."""
    return F.when(code.isin(*BLOCKING), "blocking").otherwise("warning")


def parse_review(results: DataFrame, known_ids: Column, output: str = "output") -> DataFrame:
    """``results`` without the output but with p, a struct(issues, summary, error): a review result, or why it is not valid.

    Only the two top-level keys and the five keys of an issue are allowed, codes and severities must
    be known, record ids must be of the dataset, and texts must keep their limits. The summary is cut.
    """
    read = assistant_content(results, output).withColumn("__body", unfenced(F.col("content")))
    body = F.col("__body")
    keys = F.json_object_keys(body)
    raw = F.from_json(F.get_json_object(body, "$.issues"), "array<string>")
    shape = "struct<code:string,severity:string,record_ids:array<string>,message:string,suggested_action:string>"
    issues = F.transform(raw, lambda x: F.from_json(x, shape))
    # a summary that is no text is none
    said = F.try_variant_get(F.try_parse_json(F.get_json_object(body, "$")), "$.summary", "variant")
    summary = F.when(F.schema_of_variant(said) == "STRING", F.get_json_object(body, "$.summary"))
    bad_keys = F.exists(raw, lambda x: (F.size(F.array_except(F.coalesce(F.json_object_keys(x), F.array(F.lit("?"))), F.array(*map(F.lit, _ISSUE_KEYS)))) > 0) | (F.coalesce(F.size(F.json_object_keys(x)), F.lit(0)) != 5))
    bad_code = F.exists(issues, lambda i: ~F.coalesce(i.code.isin(*CODES), F.lit(False)) | ~F.coalesce(i.severity.isin(*SEVERITIES), F.lit(False)))
    bad_ids = F.exists(issues, lambda i: i.record_ids.isNull() | (F.size(F.array_except(F.coalesce(i.record_ids, F.array().cast("array<string>")), known_ids)) > 0))
    too_long = lambda t, n: t.isNull() | (strip(F.coalesce(t, F.lit(""))) == "") | (F.length(t) > n)
    bad_text = F.exists(issues, lambda i: too_long(i.message, MAX_MESSAGE) | too_long(i.suggested_action, MAX_ACTION))
    outer = keys.isNull() | (F.size(F.array_except(keys, F.array(F.lit("issues"), F.lit("summary")))) > 0) | raw.isNull() | summary.isNull()
    invalid = F.when(outer, True).when(F.size(raw) > MAX_ISSUES, True).when(bad_keys | bad_code | bad_ids | bad_text, True).otherwise(False)
    result = F.struct(F.when(~invalid, issues).alias("issues"), F.when(~invalid, F.substring(summary, 1, MAX_SUMMARY)).alias("summary"), F.when(invalid, "QUALITY_REVIEW_INVALID").alias("error"))
    return read.select(*[c for c in results.columns if c != output], result.alias("p"))


def summarize_review(issues: DataFrame, summaries: DataFrame, cap: int = MAX_ISSUES) -> DataFrame:
    """Review counters of each job: issues in batch order up to the cap, by severity, distinct codes, and the joined summary.

    ``issues`` has job_id, batch, pos and code; ``summaries`` has job_id, batch and summary.
    """
    order = Window.partitionBy("job_id").orderBy("batch", "pos")
    kept = issues.withColumn("n", F.row_number().over(order)).where(F.col("n") <= min(cap, MAX_ISSUES)).withColumn("severity", severity_of(F.col("code")))
    counts = kept.groupBy("job_id").agg(F.count(F.lit(1)).alias("issues_found"), F.count_if(F.col("severity") == "blocking").alias("blocking_issues"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.array_sort(F.collect_set("code")).alias("codes"))
    text = summaries.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "summary"))), lambda s: s.summary), " ").alias("joined"))
    out = text.join(counts, "job_id", "left").fillna(0, ["issues_found", "blocking_issues", "warnings"])
    cut = F.substring("joined", 1, MAX_SUMMARY)
    return out.select("job_id", "issues_found", "blocking_issues", "warnings", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), (F.col("blocking_issues") > 0).alias("revision_required"), F.when(cut == "", NO_ISSUES).otherwise(cut).alias("summary"))


def affected_records(records: DataFrame, issues: DataFrame) -> DataFrame:
    """Records that an issue names, in dataset order by rec_pos; ``issues`` has job_id and record_ids."""
    named = issues.select("job_id", F.explode("record_ids").alias("record_id")).distinct()
    return records.withColumn("__id", F.try_element_at("metadata", F.lit("record_id"))).join(named.withColumnRenamed("record_id", "__id"), ["job_id", "__id"], "left_semi").drop("__id")


def issues_of(issues: DataFrame, record_ids: Column) -> DataFrame:
    """The issues that name any of the given records."""
    return issues.where(F.arrays_overlap("record_ids", record_ids))


def pair_replacements(affected: DataFrame, replacements: DataFrame) -> DataFrame:
    """(job_id, rec_pos, new_pos, error): affected records with their replacements by position.

    A full-length answer is taken at the affected positions; otherwise there must be as many
    replacements as affected records. ``affected`` has job_id, rec_pos and total (records of the
    job); ``replacements`` has job_id and new_pos (from 0).
    """
    order = Window.partitionBy("job_id").orderBy("rec_pos")
    given = replacements.groupBy("job_id").agg(F.count(F.lit(1)).alias("given"))
    asked = affected.groupBy("job_id").agg(F.count(F.lit(1)).alias("asked"))
    rows = affected.withColumn("nth", F.row_number().over(order) - 1).join(given, "job_id", "left").join(asked, "job_id").fillna(0, ["given"])
    full = F.col("given") == F.col("total")
    wrong = ~full & (F.col("given") != F.col("asked"))
    return rows.select("job_id", "rec_pos", F.when(~wrong, F.when(full, F.col("rec_pos")).otherwise(F.col("nth"))).alias("new_pos"), F.when(wrong, "QUALITY_REVISION_INVALID").alias("error"))


def apply_replacements(records: DataFrame, replacements: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Records with the given fields of their replacements (job_id, rec_pos, fields), others as they are; a replaced record keeps its metadata with its lineage added."""
    new = replacements.select("job_id", "rec_pos", F.lit(True).alias("__new"), F.coalesce("reason_codes", F.lit("")).alias("__codes") if "reason_codes" in replacements.columns else F.lit("").alias("__codes"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = records.join(new, ["job_id", "rec_pos"], "left")
    record_id = F.coalesce(F.try_element_at("metadata", F.lit("record_id")), F.lit(""))
    lineage = {"record_id": record_id, "original_record_id": record_id, "revision_attempt": F.lit("1"), "revision_reason_codes": F.col("__codes"), "replaced_by": record_id}
    kept = F.map_filter("metadata", lambda k, v: ~k.isin(*lineage))
    metadata = F.when(F.col("__new"), F.map_concat(kept, F.create_map(*[x for k, v in lineage.items() for x in (F.lit(k), v)]))).otherwise(F.col("metadata"))
    return joined.select(*[metadata.alias(c) if c == "metadata" else F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in records.columns])
