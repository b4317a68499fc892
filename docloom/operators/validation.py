"""Schema, grounding and duplicate checks of records against their source elements."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.functions.text import is_blank, normalize_source, percent, semantic_text, strip
from docloom.session import cut_lineage

# Fixed values of the record contract.
MIN_QUOTE, MAX_QUOTE, MAX_FIELD = 5, 500, 4000
DIFFICULTIES = ("easy", "medium", "hard")
NEAR_DUPLICATE = 0.92
ERRORS = ("ZERO_RECORDS", "EMPTY_REQUIRED_FIELD", "FIELD_TOO_LONG", "INVALID_DIFFICULTY", "MISSING_SOURCE_REF", "INVALID_SOURCE_REF", "MISSING_EVIDENCE", "EVIDENCE_EMPTY", "EVIDENCE_TOO_SHORT", "EVIDENCE_TOO_LONG", "EVIDENCE_NOT_FOUND", "RECORD_UNGROUNDED")


def effective(new: str, old: str) -> Column:
    """A field, or the older one it replaces where it is empty."""
    return F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old), F.lit(""))


def record_name() -> Column:
    """The record's own id in its metadata, else its number."""
    return F.coalesce(F.nullif(F.try_element_at("metadata", F.lit("record_id")), F.lit("")), F.concat(F.lit("record-"), (F.col("rec_pos") + 1).cast("string")))


def distinct_records(records: DataFrame) -> DataFrame:
    """Records with redelivered rows once, the earliest arrival. Maps keep no record from being a group's value."""
    rest = [c for c in records.columns if c != "record_id"]
    order = F.struct(*[c for c in ("ingested_at", "rec_pos") if c in rest])
    return records.groupBy("record_id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("record_id", "r.*")


def structural_errors(records: DataFrame) -> DataFrame:
    """(job_id, rec_pos, field) of records without an instruction, input or output."""
    fields = F.array(*[F.when(is_blank(F.col(column)), F.lit(name)) for name, column in (("instruction", "instruction"), ("input", "input_text"), ("output", "output_text"))])
    return records.select("job_id", "rec_pos", F.explode(F.array_compact(fields)).alias("field"))


def _issue(code: str, field: str, when: Column) -> Column:
    severity = "error" if code in ERRORS else "warning"
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field")))


def field_issues(records: DataFrame) -> DataFrame:
    """(job_id, rec_pos, issue_pos, code, severity, field) for what a record's own fields show, in the order of the checks."""
    context, answer = effective("context", "input_text"), effective("expected_output", "output_text")
    out = []
    for name, value in (("instruction", F.coalesce("instruction", F.lit(""))), ("context", context), ("expected_output", answer), ("category", F.coalesce("category", F.lit("")))):
        out.append(F.coalesce(_issue("EMPTY_REQUIRED_FIELD", name, is_blank(value)), _issue("FIELD_TOO_LONG", name, F.length(value) > MAX_FIELD)))
    out.append(_issue("INVALID_DIFFICULTY", "difficulty", ~F.coalesce("difficulty", F.lit("")).isin(*DIFFICULTIES)))
    fold = lambda c: F.replace(F.lower(strip(c)), F.lit("ß"), F.lit("ss"))
    out.append(_issue("CONTEXT_EQUALS_INSTRUCTION", "context", fold(context) == fold(F.coalesce("instruction", F.lit("")))))
    return records.select("job_id", "rec_pos", F.posexplode(F.array_compact(F.array(*out))).alias("issue_pos", "x")).select("job_id", "rec_pos", "issue_pos", "x.*")


def reference_issues(records: DataFrame, elements: DataFrame, key: str = "element_id") -> DataFrame:
    """(job_id, rec_pos, ref, code): records without a ref, and one row for each distinct unknown ref."""
    none = F.coalesce(F.size("source_refs"), F.lit(-1)) <= 0
    missing = records.where(none).select("job_id", "rec_pos", F.lit("").alias("ref"), F.lit("MISSING_SOURCE_REF").alias("code"))
    refs = records.select("job_id", "rec_pos", F.explode(F.array_distinct("source_refs")).alias("ref"))
    unknown = refs.join(elements.select(F.col(key).alias("ref")).distinct(), "ref", "left_anti").select("job_id", "rec_pos", "ref", F.lit("INVALID_SOURCE_REF").alias("code"))
    return missing.unionByName(unknown)


def evidence_checks(evidence: DataFrame, sources: DataFrame, normalize=normalize_source) -> DataFrame:
    """Evidence rows with code: null where the quote is in its source, else what is wrong first.

    ``evidence`` has source_ref and quote; ``sources`` has source_ref and source_text, one row a ref.
    The ref is a join key, so the containment test runs on matched pairs only; quotes that fail by
    length need no source. Sources of no evidence are left out before they are normalised.
    """
    quote = strip(F.coalesce("quote", F.lit("")))
    size = F.length(quote)
    by_length = F.when(size == 0, "EVIDENCE_EMPTY").when(size < MIN_QUOTE, "EVIDENCE_TOO_SHORT").when(size > MAX_QUOTE, "EVIDENCE_TOO_LONG")
    used = sources.join(evidence.select("source_ref").distinct(), "source_ref", "left_semi").select("source_ref", normalize(F.col("source_text")).alias("norm_source"))
    joined = evidence.withColumn("norm_quote", normalize(quote)).join(used, "source_ref", "left")
    lost = F.when(F.col("norm_source").isNull() | ~F.contains("norm_source", "norm_quote"), "EVIDENCE_NOT_FOUND")
    return joined.withColumn("code", F.coalesce(by_length, lost)).drop("norm_source", "norm_quote")


def fingerprint(normalize=normalize_source) -> Column:
    """SHA-256 of a record's normalised semantic text."""
    return F.sha2(normalize(semantic_text()), 256)


def exact_duplicates(records: DataFrame, normalize=normalize_source) -> DataFrame:
    """Records with fingerprint and is_duplicate: true for all but the first of a job with that fingerprint.

    The first is found by partial aggregation and joined back, so a fingerprint that a third of all
    rows share is no hot window.
    """
    marked = records.withColumn("fingerprint", fingerprint(normalize))
    first = marked.groupBy("job_id", "fingerprint").agg(F.min("rec_pos").alias("first_pos"))
    return marked.join(first, ["job_id", "fingerprint"]).withColumn("is_duplicate", F.col("rec_pos") > F.col("first_pos")).drop("first_pos")


def similarity_ratio(threshold: float):
    """A function of two texts: their matching-blocks ratio in this order (it is not symmetric), 0 where a bound already excludes ``threshold``."""

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            matcher = SequenceMatcher(None, x, y)
            out.append(matcher.ratio() if matcher.quick_ratio() >= threshold else 0.0)
        return pd.Series(out, dtype="float64")

    # said to be nondeterministic so that a filter on its result does not compute it a second time
    return F.pandas_udf(ratio, T.DoubleType()).asNondeterministic()


#: Records of one job and length class that meet in one task at most; beyond, they are spread.
MEET = 2_000
#: Groups of characters counted for the bound on shared characters.
_CHARACTERS = ("e", "t", "a", "o", "i", "n", "s", "r", "h", "l", "d", "c", "u", "m", "p", " ")


def near_duplicates(records: DataFrame, threshold: float = NEAR_DUPLICATE, marks: DataFrame | None = None) -> DataFrame:
    """(job_id, left_pos, right_pos, ratio) of near-duplicate records of a job, exact duplicates left out.

    Three bounds that lose no pair come before the ratio: the shorter text has at least
    threshold / (2 - threshold) of the longer one's length, texts of a pair share most characters by
    a few counts, and by all counts (tested in the function). Length classes of one step make the
    first an equi-join, so only texts of like length meet; they meet without their texts, which are
    joined to the pairs that are left. A job with many records of a class is spread over as many
    tasks as its left side needs, each with a part of it, so none is hot.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    marks = exact_duplicates(records) if marks is None else records.join(marks, ["job_id", "rec_pos"])
    norms = cut_lineage(marks.where(~F.col("is_duplicate")).select("job_id", "rec_pos", normalize_source(semantic_text()).alias("norm")))
    if threshold == 1:
        return _rated(norms, norms.select("job_id", F.col("rec_pos").alias("left_pos"), F.sha2("norm", 256).alias("h")).join(norms.select("job_id", F.col("rec_pos").alias("right_pos"), F.sha2("norm", 256).alias("h")), ["job_id", "h"]).where("left_pos < right_pos").drop("h"), threshold)
    step = F.lit(-1.0) * F.log(F.lit(threshold / (2 - threshold)))
    counted = [F.length("norm") - F.length(F.replace("norm", F.lit(c), F.lit(""))) for c in _CHARACTERS]
    sized = norms.select("job_id", "rec_pos", F.length("norm").alias("n"), F.array(*counted).alias("c")).withColumn("size_class", F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / step).cast("int"))
    parts = sized.groupBy("job_id", "size_class").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("parts"))
    left = sized.select("job_id", F.col("rec_pos").alias("left_pos"), F.col("n").alias("n_a"), F.col("c").alias("c_a"), "size_class").join(parts, ["job_id", "size_class"])
    left = left.withColumn("part", F.pmod(F.xxhash64("left_pos"), F.col("parts")).cast("int")).select("job_id", "left_pos", "n_a", "c_a", "part", F.explode(F.array(F.col("size_class") - 1, F.col("size_class"), F.col("size_class") + 1)).alias("size_class"), F.col("size_class").alias("own"))
    near = parts.select("job_id", F.col("size_class").alias("own"), F.col("parts").alias("parts"))
    right = sized.select("job_id", F.col("rec_pos").alias("right_pos"), F.col("n").alias("n_b"), F.col("c").alias("c_b"), "size_class", F.explode(F.array(F.col("size_class") - 1, F.col("size_class"), F.col("size_class") + 1)).alias("own"))
    right = right.join(near, ["job_id", "own"]).select("job_id", "right_pos", "n_b", "c_b", "size_class", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    close = 2 * F.least("n_a", "n_b") >= F.lit(threshold) * (F.col("n_a") + F.col("n_b"))
    # characters that the counts show to be unshared: half of their sum is missing from the blocks
    apart = sum((F.abs(F.col("c_a")[i] - F.col("c_b")[i]) for i in range(len(_CHARACTERS))), F.lit(0))
    shared = F.col("n_a") + F.col("n_b") - apart >= F.lit(threshold) * (F.col("n_a") + F.col("n_b"))
    pairs = left.join(right, ["job_id", "size_class", "own", "part"]).where((F.col("left_pos") < F.col("right_pos")) & close & shared).select("job_id", "left_pos", "right_pos")
    return _rated(norms, pairs, threshold)


def _rated(norms: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    of = lambda side: norms.select("job_id", F.col("rec_pos").alias(f"{side}_pos"), F.col("norm").alias(f"norm_{side}"))
    texts = pairs.join(of("left"), ["job_id", "left_pos"]).join(of("right"), ["job_id", "right_pos"])
    rated = texts.select("job_id", "left_pos", "right_pos", similarity_ratio(threshold)("norm_left", "norm_right").alias("ratio"))
    return rated.where(F.col("ratio") >= threshold)


def record_grounding(records: DataFrame, evidence: DataFrame, sources: DataFrame, normalize=normalize_source, checked: DataFrame | None = None) -> DataFrame:
    """(job_id, rec_pos, refs, evidence_items, verified, errors, grounded) of each record; ``checked`` has evidence checks made before."""
    checked = evidence_checks(evidence, sources, normalize) if checked is None else checked
    per = checked.groupBy("job_id", "rec_pos").agg(F.count(F.lit(1)).alias("evidence_items"), F.count_if(F.col("code").isNull()).alias("verified"), F.count_if(F.col("code").isNotNull()).alias("evidence_errors"))
    own = field_issues(records).where("severity = 'error'").groupBy("job_id", "rec_pos").agg(F.count(F.lit(1)).alias("field_errors"))
    refs = reference_issues(records, sources, "source_ref").groupBy("job_id", "rec_pos").agg(F.count(F.lit(1)).alias("ref_errors"))
    base = records.select("job_id", "rec_pos", F.coalesce(F.size(F.array_distinct("source_refs")), F.lit(0)).alias("refs"))
    joined = base.join(per, ["job_id", "rec_pos"], "left").join(own, ["job_id", "rec_pos"], "left").join(refs, ["job_id", "rec_pos"], "left").fillna(0)
    missing = F.when(F.col("evidence_items") == 0, 1).otherwise(0)
    errors = F.col("evidence_errors") + F.col("field_errors") + F.col("ref_errors") + missing
    return joined.select("job_id", "rec_pos", "refs", "evidence_items", "verified", errors.alias("errors"), ((errors == 0) & (F.col("verified") > 0) & (F.col("refs") > 0)).alias("grounded"))


def grounding_summary(records: DataFrame, grounding: DataFrame, mode: str = "compat", normalize=normalize_source, marks: DataFrame | None = None) -> DataFrame:
    """Grounding counters and status of each job.

    In the mode "compat" grounded records and evidence are counted before exact duplicates are
    removed, so a grounded duplicate fails its job; "post_dedup" counts what remains.
    """
    if mode not in ("compat", "post_dedup"):
        raise ValueError(f"unknown mode {mode}")
    marks = exact_duplicates(records, normalize).select("job_id", "rec_pos", "is_duplicate") if marks is None else marks
    joined = grounding.join(marks, ["job_id", "rec_pos"])
    counted = F.lit(True) if mode == "compat" else ~F.col("is_duplicate")
    total = lambda c: F.sum(F.when(counted, F.col(c)).otherwise(0))
    out = joined.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("generated_records"),
        F.count_if(~F.col("is_duplicate")).alias("total_records"),
        F.count_if(counted & F.col("grounded")).alias("grounded_records"),
        total("evidence_items").alias("total_evidence"),
        total("verified").alias("verified_evidence"),
    )
    passed = (F.col("total_records") > 0) & (F.col("grounded_records") == F.col("total_records")) & (F.col("verified_evidence") == F.col("total_evidence"))
    return out.select(
        "*",
        F.greatest(F.lit(0), F.col("total_records") - F.col("grounded_records")).alias("ungrounded_records"),
        F.greatest(F.lit(0), F.col("total_evidence") - F.col("verified_evidence")).alias("failed_evidence"),
        percent(F.col("grounded_records"), F.col("total_records")).alias("grounding_percent"),
        F.when(passed, "passed").otherwise("failed").alias("status"),
    )


#: What each code says; a field's name follows where the code is about one of several.
MESSAGES = {
    "ZERO_RECORDS": "There is no record in the dataset.",
    "EMPTY_REQUIRED_FIELD": "A required field has no content",
    "FIELD_TOO_LONG": f"A field has more than {MAX_FIELD} characters",
    "INVALID_DIFFICULTY": "The difficulty is none of easy, medium and hard.",
    "CONTEXT_EQUALS_INSTRUCTION": "The context repeats the instruction.",
    "MISSING_SOURCE_REF": "The record names no source unit.",
    "INVALID_SOURCE_REF": "The record names a unit that was not extracted.",
    "MISSING_EVIDENCE": "The record has no evidence.",
    "EVIDENCE_EMPTY": "A quote is empty.",
    "EVIDENCE_TOO_SHORT": f"A quote has fewer than {MIN_QUOTE} characters.",
    "EVIDENCE_TOO_LONG": f"A quote has more than {MAX_QUOTE} characters.",
    "EVIDENCE_NOT_FOUND": "A quote does not stand in the unit it names.",
    "RECORD_UNGROUNDED": "No verified quote supports the record.",
    "EXACT_DUPLICATE": "The record repeats an earlier one and was removed.",
    "NEAR_DUPLICATE": "Some records are nearly the same.",
}


def message_of(code: Column, field: Column) -> Column:
    """The message of an issue, with its field where the code needs one."""
    table = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    text = F.try_element_at(table, code)
    return F.when(code.isin("EMPTY_REQUIRED_FIELD", "FIELD_TOO_LONG"), F.concat(text, F.lit(": "), field, F.lit("."))).otherwise(text)


def all_issues(records: DataFrame, evidence: DataFrame, sources: DataFrame, near: DataFrame, normalize=normalize_source, marks: DataFrame | None = None, checked: DataFrame | None = None, jobs: DataFrame | None = None) -> DataFrame:
    """Issues of each job in report order: duplicates where they stand, each kept record's own, then one for near duplicates.

    Issues of a removed duplicate are left out but for the removal. ``source_rank`` orders the checks
    within a record. ``marks`` and ``checked`` have duplicates and evidence checks made before; with
    ``jobs`` (job_id), a job without records has an issue as well.
    """
    marks = exact_duplicates(records, normalize) if marks is None else marks
    checked = evidence_checks(evidence, sources, normalize) if checked is None else checked
    at = ["job_id", "rec_pos"]
    names = records.select(*at, record_name().alias("record_id"))
    kept = marks.where(~F.col("is_duplicate")).select(*at)
    row = lambda rank, pos, code, severity, field: [F.lit(rank).alias("source_rank"), pos.alias("pos"), code.alias("code"), severity.alias("severity"), field.alias("field")]
    error, warning = F.lit("error"), F.lit("warning")
    own = field_issues(records).select(*at, *row(1, F.col("issue_pos"), F.col("code"), F.col("severity"), F.col("field")))
    refs = reference_issues(records, sources, "source_ref").select(*at, *row(2, F.lit(0), F.col("code"), error, F.lit("source_refs")))
    none = records.join(evidence.select(*at).distinct(), at, "left_anti").select(*at, *row(3, F.lit(0), F.lit("MISSING_EVIDENCE"), error, F.lit("evidence")))
    bad = checked.where(F.col("code").isNotNull()).select(*at, *row(3, F.col("ev_pos"), F.col("code"), error, F.lit("evidence")))
    inside = own.unionByName(refs).unionByName(none).unionByName(bad).join(kept, at, "left_semi")
    removed = marks.where("is_duplicate").select(*at, *row(0, F.lit(0), F.lit("EXACT_DUPLICATE"), warning, F.lit(None).cast("string")))
    named = removed.unionByName(inside).join(names, at)
    whole = lambda df, rank, code, severity: df.select("job_id", F.lit(None).cast("int").alias("rec_pos"), *row(rank, F.lit(0), F.lit(code), severity, F.lit(None).cast("string")), F.lit(None).cast("string").alias("record_id"))
    out = named.unionByName(whole(near.select("job_id").distinct(), 9, "NEAR_DUPLICATE", warning))
    if jobs is not None:
        out = out.unionByName(whole(jobs.select("job_id").distinct().join(records.select("job_id").distinct(), "job_id", "left_anti"), 0, "ZERO_RECORDS", error))
    return out.withColumn("message", message_of(F.col("code"), F.col("field")))


def issue_order(issues: DataFrame) -> DataFrame:
    """Issues numbered in the order of each job's report; a job's issues are bounded by its records."""
    order = Window.partitionBy("job_id").orderBy(F.col("rec_pos").asc_nulls_last(), "source_rank", "pos", "code")
    return issues.withColumn("issue_pos", F.row_number().over(order) - 1)


@dataclass(frozen=True)
class Checked:
    """Everything that is found about the records of all jobs, each part computed once."""

    records: DataFrame
    marks: DataFrame
    near: DataFrame
    per_record: DataFrame
    grounding: DataFrame
    issues: DataFrame


def check_records(records: DataFrame, sources: DataFrame, jobs: DataFrame | None = None, near: DataFrame | None = None, normalize=normalize_source) -> Checked:
    """Duplicates, evidence, grounding and issues of ``records``; fingerprints and quotes are normalised once.

    ``near`` has near-duplicate pairs found before, with job_id. An empty table gives empty parts, but
    for the issues of ``jobs`` without records.
    """
    evidence = records.select("job_id", "rec_pos", F.posexplode("evidence").alias("ev_pos", "e")).select("job_id", "rec_pos", "ev_pos", "e.source_ref", "e.quote")
    marks = cut_lineage(exact_duplicates(records, normalize).select("job_id", "rec_pos", "is_duplicate"))
    checked = cut_lineage(evidence_checks(evidence, sources, normalize).select("job_id", "rec_pos", "ev_pos", "code"))
    near = cut_lineage(near_duplicates(records, marks=marks)) if near is None else near
    per_record = cut_lineage(record_grounding(records, evidence, sources, normalize, checked))
    grounding = grounding_summary(records, per_record, normalize=normalize, marks=marks)
    issues = cut_lineage(issue_order(all_issues(records, evidence, sources, near, normalize, marks, checked, jobs)))
    return Checked(records, marks, near, per_record, grounding, issues)
