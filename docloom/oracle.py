"""SQL that checks the core queries, for DuckDB over the same tables."""

from __future__ import annotations

import json
import unicodedata

from docloom.functions.text import RECORD_COUNT
from docloom.operators import review
from docloom.operators.export import METADATA_FIELDS
from docloom.operators.validation import MAX_FIELD, MAX_QUOTE, MIN_QUOTE
from docloom.queries import OPTIONS

_WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NOT_WS = "[^" + _WS[1:]
_BREAK = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _norm(x: str) -> str:
    quotes = f"replace(replace(replace(coalesce({x}, ''), '“', '\"'), '”', '\"'), '’', '''')"
    return f"replace(lower(trim(regexp_replace({quotes}, '{_WS}+', ' ', 'g'))), 'ß', 'ss')"


# compatibility forms of the blocks that texts use, from the Unicode tables: characters of one and of several
_FORMS = {chr(c): form for lo, hi in ((0xA0, 0x24FF), (0xFB00, 0xFB06), (0xFF01, 0xFFEE)) for c in range(lo, hi + 1) if (form := unicodedata.normalize("NFKC", chr(c))) not in (chr(c), "'")}
_ONE = {c: f for c, f in _FORMS.items() if len(f) == 1}


def _norm_full(x: str) -> str:
    """The exact comparison form: compatibility forms, then the rest as in :func:`_norm`."""
    out = f"translate(coalesce({x}, ''), '{''.join(_ONE)}', '{''.join(_ONE.values()).replace(chr(39), chr(39) * 2)}')"
    for c, form in _FORMS.items():
        if len(form) > 1 and (c < "\u0180" or "\u2000" <= c <= "\u218F" or c >= "\uFB00"):
            out = f"replace({out}, '{c}', '{form}')"
    return _norm(f"nfc_normalize({out})")


_ELEMENTS = """el AS (SELECT doc_id, element_id, min_by(element_type, ingested_at) AS element_type, min_by(text, ingested_at) AS text, min_by(ord, ingested_at) AS ord, min_by(page_number, ingested_at) AS page_number, min_by(table_rows, ingested_at) AS table_rows
  FROM (SELECT doc_id, element_id, element_type, coalesce(text, '') AS text, ord, coalesce(page_number, -1) AS page_number, coalesce(table_rows, []) AS table_rows, ingested_at FROM elements) GROUP BY doc_id, element_id)"""
_RECORDS = "rec AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at, rec_pos) = 1)"
_QUOTE = "CASE WHEN element_type = 'table' AND len(table_rows) > 0 THEN array_to_string(list_transform(table_rows, lambda r: array_to_string(r, ' | ')), chr(10)) ELSE text END"
_SEMANTIC = "concat_ws('|', coalesce(instruction, ''), coalesce(nullif(context, ''), input_text, ''), coalesce(nullif(expected_output, ''), output_text, ''), coalesce(category, ''), coalesce(difficulty, ''))"


def _finger(norm=_norm) -> str:
    return f"fp AS (SELECT job_id, rec_pos, sha256({norm(_SEMANTIC)}) AS fingerprint FROM rec), dup AS (SELECT *, rec_pos > min(rec_pos) OVER (PARTITION BY job_id, fingerprint) AS is_duplicate FROM fp)"


_LINES = f"""ls AS (SELECT doc_id, string_split_regex(text, '{_BREAK}') AS l FROM documents WHERE text IS NOT NULL),
li AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS ord, unnest(l) AS text FROM ls),
ln AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, text, CASE WHEN length(text) <= 100 AND ((upper(text) = text AND lower(text) <> text AND NOT contains(text, 'ß')) OR text LIKE '%:') THEN 'heading' ELSE 'paragraph' END AS element_type FROM li WHERE regexp_matches(text, '{_NOT_WS}'))"""

_STATS = f"""{_ELEMENTS},
ev AS (SELECT *, regexp_matches(text, '{_NOT_WS}') OR len(table_rows) > 0 AS useful FROM el),
st AS (SELECT doc_id, CAST(greatest(max(page_number), 0) AS INTEGER) AS page_count,
 CAST(sum(CASE WHEN useful THEN length(text) ELSE 0 END) AS BIGINT) AS character_count,
 CAST(sum(CASE WHEN useful THEN len(regexp_extract_all(text, '{_NOT_WS}+')) ELSE 0 END) AS BIGINT) AS word_count,
 count(*) AS element_count, CAST(count_if(element_type = 'heading') AS BIGINT) AS heading_count, CAST(count_if(element_type = 'paragraph') AS BIGINT) AS paragraph_count, CAST(count_if(element_type = 'list_item') AS BIGINT) AS list_item_count, CAST(count_if(element_type = 'table') AS BIGINT) AS table_count,
 CAST(sum(len(table_rows)) AS BIGINT) AS table_row_count, CAST(count_if(useful) AS BIGINT) AS non_empty_element_count FROM ev GROUP BY doc_id HAVING CAST(count_if(useful) AS BIGINT) > 0)"""

_PLAN = f"""{_ELEMENTS},
un AS (SELECT doc_id, element_id, ord, {_strip(_QUOTE)} AS full_text FROM el),
us AS (SELECT doc_id, element_id, ord, full_text, greatest(1, (length(full_text) + 3) // 4) AS whole, row_number() OVER (PARTITION BY doc_id ORDER BY ord, element_id) AS i FROM un WHERE length(full_text) > 0),
f AS (SELECT doc_id, element_id, ord, i, 1 AS batch_no, 1 AS alias_no, least(whole, {OPTIONS.budget}) AS tokens, least(whole, {OPTIONS.budget}) AS run FROM us WHERE i = 1
 UNION ALL
 SELECT u.doc_id, u.element_id, u.ord, u.i, CASE WHEN o THEN f.batch_no + 1 ELSE f.batch_no END, CASE WHEN o THEN 1 ELSE f.alias_no + 1 END, least(u.whole, {OPTIONS.budget}), CASE WHEN o THEN 0 ELSE f.run END + least(u.whole, {OPTIONS.budget})
 FROM f JOIN us u ON u.doc_id = f.doc_id AND u.i = f.i + 1, LATERAL (SELECT f.run + u.whole > {OPTIONS.budget} OR f.alias_no >= {OPTIONS.unit_cap} AS o) x)"""

_EVIDENCE = "evd AS (SELECT job_id, rec_pos, unnest(range(0, len(evidence))) AS ev_pos, unnest(evidence) AS e FROM rec)"


def _checks(norm=_norm) -> str:
    return f"""{_ELEMENTS}, {_RECORDS}, {_EVIDENCE},
src AS (SELECT element_id AS source_ref, min({_QUOTE}) AS source_text FROM el GROUP BY element_id),
used AS (SELECT source_ref, {norm('source_text')} AS norm_source FROM src WHERE source_ref IN (SELECT e.source_ref FROM evd)),
chk AS (SELECT job_id, rec_pos, CAST(ev_pos AS INTEGER) AS ev_pos, CASE WHEN length(q) = 0 THEN 'EVIDENCE_EMPTY' WHEN length(q) < {MIN_QUOTE} THEN 'EVIDENCE_TOO_SHORT' WHEN length(q) > {MAX_QUOTE} THEN 'EVIDENCE_TOO_LONG'
 WHEN norm_source IS NULL OR NOT contains(norm_source, {norm('q')}) THEN 'EVIDENCE_NOT_FOUND' ELSE 'VERIFIED' END AS code
 FROM (SELECT job_id, rec_pos, ev_pos, e.source_ref AS source_ref, {_strip("coalesce(e.quote, '')")} AS q FROM evd) LEFT JOIN used USING (source_ref))"""


_CONTEXT = "coalesce(nullif(context, ''), input_text, '')"
_ANSWER = "coalesce(nullif(expected_output, ''), output_text, '')"
_FOLD = lambda x: f"replace(lower({_strip(x)}), 'ß', 'ss')"


def _field(name: str, value: str) -> str:
    return f"SELECT job_id, rec_pos, CASE WHEN NOT regexp_matches({value}, '{_NOT_WS}') THEN 'EMPTY_REQUIRED_FIELD' ELSE 'FIELD_TOO_LONG' END AS code, 'error' AS severity, '{name}' AS field FROM rec WHERE NOT regexp_matches({value}, '{_NOT_WS}') OR length({value}) > {MAX_FIELD}"


_FIELD_ISSUES = " UNION ALL ".join(
    [
        _field("instruction", "coalesce(instruction, '')"),
        _field("context", _CONTEXT),
        _field("expected_output", _ANSWER),
        _field("category", "coalesce(category, '')"),
        "SELECT job_id, rec_pos, 'INVALID_DIFFICULTY', 'error', 'difficulty' FROM rec WHERE coalesce(difficulty, '') NOT IN ('easy', 'medium', 'hard')",
        f"SELECT job_id, rec_pos, 'CONTEXT_EQUALS_INSTRUCTION', 'warning', 'context' FROM rec WHERE {_FOLD(_CONTEXT)} = {_FOLD(chr(99) + 'oalesce(instruction, ' + chr(39) * 2 + ')')}",
    ]
)
_REF_ISSUES = """SELECT job_id, rec_pos, '' AS ref, 'MISSING_SOURCE_REF' AS code FROM rec WHERE coalesce(len(source_refs), 0) = 0
UNION ALL SELECT DISTINCT job_id, rec_pos, ref, 'INVALID_SOURCE_REF' FROM (SELECT job_id, rec_pos, unnest(source_refs) AS ref FROM rec) WHERE ref NOT IN (SELECT element_id FROM elements)"""

_NAMES = """n AS (SELECT DISTINCT doc_id, source_filename FROM normalized_documents),
b AS (SELECT doc_id, regexp_extract(regexp_replace(coalesce(nullif(source_filename, ''), 'document'), '/+$', ''), '([^/]*)$', 1) AS base, regexp_extract(regexp_replace(coalesce(nullif(source_filename, ''), 'dataset'), '/+$', ''), '([^/]*)$', 1) AS dbase FROM n),
s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(base, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+', ''), '[._]+$', '') AS slug, regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(dbase, '.\\.[^.]+$') THEN regexp_replace(dbase, '\\.[^.]+$', '') ELSE dbase END, '[^A-Za-z0-9_-]+', '-', 'g'), '^[-_]+', ''), '[-_]+$', '') AS stem FROM b)"""

_CODES = "['REPETITIVE_RECORDS', 'LOW_INSTRUCTION_DIVERSITY', 'WEAK_CONTEXT', 'WEAK_EXPECTED_OUTPUT', 'AMBIGUOUS_INSTRUCTION', 'DIFFICULTY_MISMATCH', 'CATEGORY_INCONSISTENCY', 'REDUNDANT_TEST_CASE', 'SOURCE_SUPPORT_CONCERN', 'OVERLY_BROAD_ANSWER', 'OVERLY_TRIVIAL_RECORD', 'POOR_DATASET_COVERAGE', 'OTHER_BOUNDED_QUALITY_ISSUE']"

_CELLS = {"instruction": "instruction", "input": "input_text", "output": "output_text", "context": "context", "expected_output": "expected_output"}
_GUARDED = ", ".join(f"CASE WHEN regexp_matches(coalesce({c}, ''), '^[=+@-]') THEN '''' || {c} ELSE coalesce({c}, '') END AS {n}" for n, c in _CELLS.items())

_PERCENT = ", CASE WHEN total_records = 0 THEN 0.0 ELSE round_even(grounded_records / total_records * 100, 1) END AS grounding_percent"


def _by_record(norm) -> str:
    """g: every record with its refs, evidence, verified quotes, other errors, and whether it repeats one before."""
    return f"""{_checks(norm)}, {_finger(norm)},
iss AS ({_FIELD_ISSUES}), ri AS ({_REF_ISSUES}),
e AS (SELECT job_id, rec_pos, count(*) AS n, CAST(count_if(code = 'VERIFIED') AS BIGINT) AS v FROM chk GROUP BY ALL),
r AS (SELECT rec.job_id, rec.rec_pos, coalesce(nullif(metadata['record_id'], ''), 'record-' || (rec.rec_pos + 1)) AS name, coalesce(len(list_distinct(source_refs)), 0) AS refs, coalesce(e.n, 0) AS n, coalesce(e.v, 0) AS v,
 (SELECT count(*) FROM iss WHERE iss.job_id = rec.job_id AND iss.rec_pos = rec.rec_pos AND severity = 'error') + (SELECT count(*) FROM ri WHERE ri.job_id = rec.job_id AND ri.rec_pos = rec.rec_pos) AS bad
 FROM rec LEFT JOIN e ON e.job_id = rec.job_id AND e.rec_pos = rec.rec_pos),
g AS (SELECT r.*, is_duplicate, n = v AND n > 0 AND bad = 0 AND refs > 0 AS grounded FROM r JOIN dup USING (job_id, rec_pos))"""


def _totals(counted: str) -> str:
    return f"""j AS (SELECT job_id, count(*) AS generated_records, CAST(count_if(NOT is_duplicate) AS BIGINT) AS total_records, CAST(count_if(grounded AND {counted}) AS BIGINT) AS grounded_records, CAST(sum(CASE WHEN {counted} THEN n ELSE 0 END) AS BIGINT) AS total_evidence, CAST(sum(CASE WHEN {counted} THEN v ELSE 0 END) AS BIGINT) AS verified_evidence FROM g GROUP BY job_id),
gr AS (SELECT *, greatest(0, total_records - grounded_records) AS ungrounded_records, greatest(0, total_evidence - verified_evidence) AS failed_evidence, CASE WHEN total_records > 0 AND grounded_records = total_records AND verified_evidence = total_evidence THEN 'passed' ELSE 'failed' END AS status FROM j)"""


def _grounding(norm, counted: str, more: str) -> str:
    return f"WITH {_by_record(norm)}, {_totals(counted)} SELECT *{more} FROM gr"


def _found() -> str:
    """issues of all jobs with the pairs of equal instructions as near duplicates, beside the parts of :func:`_by_record`."""
    order = "CASE field WHEN 'instruction' THEN 0 WHEN 'context' THEN 1 WHEN 'expected_output' THEN 2 WHEN 'category' THEN 3 WHEN 'difficulty' THEN 4 END"
    return f"""{_by_record(_norm_full)}, {_totals('true')},
near AS (SELECT a.job_id, count(*) AS pairs FROM rec a JOIN rec b ON a.job_id = b.job_id AND a.instruction = b.instruction AND a.rec_pos < b.rec_pos GROUP BY a.job_id),
own AS (SELECT job_id, rec_pos, 1 AS rank, CASE WHEN code = 'CONTEXT_EQUALS_INSTRUCTION' THEN 5 ELSE {order} END AS pos, code, severity, field FROM iss
 UNION ALL SELECT job_id, rec_pos, 2, 0, code, 'error', 'source_refs' FROM ri
 UNION ALL SELECT job_id, rec_pos, 3, 0, 'MISSING_EVIDENCE', 'error', 'evidence' FROM r WHERE n = 0
 UNION ALL SELECT job_id, rec_pos, 3, ev_pos, code, 'error', 'evidence' FROM chk WHERE code <> 'VERIFIED'),
issues AS (SELECT own.*, name AS record_id FROM own JOIN g USING (job_id, rec_pos) WHERE NOT is_duplicate
 UNION ALL SELECT job_id, rec_pos, 0, 0, 'EXACT_DUPLICATE', 'warning', '', name FROM g WHERE is_duplicate
 UNION ALL SELECT job_id, NULL, 9, 0, 'NEAR_DUPLICATE', 'warning', '', '' FROM near
 UNION ALL SELECT DISTINCT job_id, NULL, 0, 0, 'ZERO_RECORDS', 'error', '', '' FROM jobs WHERE job_id NOT IN (SELECT job_id FROM rec))"""


_QUALITY = f"""SELECT k.job_id, generated, final, exact_duplicates_removed, category_count, easy_count, medium_count, hard_count, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(near.pairs, 0) AS near_duplicate_pairs, coalesce(grounded_records, 0) AS valid, coalesce(gr.status, 'failed') AS grounding_status,
 greatest(0, final - coalesce(grounded_records, 0)) AS invalid, coalesce(errors, 0) = 0 AS schema_valid, CASE WHEN coalesce(errors, 0) > 0 OR coalesce(gr.status, 'failed') = 'failed' THEN 'failed' WHEN coalesce(warnings, 0) > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status
FROM (SELECT DISTINCT job_id, count(g.rec_pos) OVER w AS generated, CAST(count_if(NOT is_duplicate) OVER w AS BIGINT) AS final, CAST(count_if(is_duplicate) OVER w AS BIGINT) AS exact_duplicates_removed FROM (SELECT DISTINCT job_id FROM jobs) LEFT JOIN g USING (job_id) WINDOW w AS (PARTITION BY job_id)) k
LEFT JOIN (SELECT j0.job_id, count(DISTINCT CASE WHEN is_duplicate = false THEN nullif({_strip("coalesce(category, '')")}, '') END) AS category_count, CAST(count_if(is_duplicate = false AND difficulty = 'easy') AS BIGINT) AS easy_count, CAST(count_if(is_duplicate = false AND difficulty = 'medium') AS BIGINT) AS medium_count, CAST(count_if(is_duplicate = false AND difficulty = 'hard') AS BIGINT) AS hard_count
 FROM (SELECT DISTINCT job_id FROM jobs) j0 LEFT JOIN rec ON rec.job_id = j0.job_id LEFT JOIN g ON g.job_id = rec.job_id AND g.rec_pos = rec.rec_pos GROUP BY j0.job_id) c USING (job_id)
LEFT JOIN (SELECT job_id, CAST(count_if(severity = 'error') AS BIGINT) AS errors, CAST(count_if(severity = 'warning') AS BIGINT) AS warnings FROM issues GROUP BY job_id) i USING (job_id) LEFT JOIN near USING (job_id) LEFT JOIN gr USING (job_id)"""


_EVIDENCE_FRAME = len('{"source_ref": , "quote": }')


def _json_chars(x: str) -> str:
    x = f"coalesce({x}, '')"
    return f"""(length({x}) + 2 + length(regexp_replace({x}, '[^"\\\\\\n\\r\\t\\x08\\x0C]', '', 'g')) + 5 * length(regexp_replace({x}, '[^\\x00-\\x07\\x0B\\x0E-\\x1F]', '', 'g')))"""


def _review_sql() -> str:
    def of(column: str, each: str) -> str:
        return f"(2 + 2 * greatest(0, coalesce(len({column}), 0) - 1) + coalesce(list_sum(list_transform({column}, lambda x: {each})), 0))"

    special = {"metadata": of("map_entries(metadata)", f"{_json_chars('x.key')} + 2 + {_json_chars('x.value')}"), "source_refs": of("source_refs", _json_chars("x")), "evidence": of("evidence", f"{_EVIDENCE_FRAME} + {_json_chars('x.source_ref')} + {_json_chars('x.quote')}")}
    fields = " + ".join(f"{len(name) + 4} + {special.get(name) or _json_chars(column)}" for name, column in review.RECORD_FIELDS.items())
    schema = max(1, (len(json.dumps(review.review_schema(), sort_keys=True)) + 3) // 4)
    return f"""WITH RECURSIVE {_RECORDS}, p AS (SELECT job_id, max(length(prompt)) AS chars FROM jobs GROUP BY job_id),
c AS (SELECT rec.job_id, rec_pos, greatest(1, ({fields} + {2 + 2 * (len(review.RECORD_FIELDS) - 1)} + 3) // 4) AS cost, greatest(1, ({len(review.SYSTEM)} + coalesce(chars, 0) + 3) // 4) AS fixed, row_number() OVER (PARTITION BY rec.job_id ORDER BY rec_pos) AS i FROM rec LEFT JOIN p ON p.job_id = rec.job_id),
f AS (SELECT job_id, rec_pos, i, 1 AS review_batch, fixed + {schema} + cost AS total FROM c WHERE i = 1
 UNION ALL SELECT c.job_id, c.rec_pos, c.i, CASE WHEN f.total + c.cost > 2048 THEN f.review_batch + 1 ELSE f.review_batch END, CASE WHEN f.total + c.cost > 2048 THEN c.fixed ELSE f.total END + c.cost FROM f JOIN c ON c.job_id = f.job_id AND c.i = f.i + 1)
SELECT job_id, rec_pos, CAST(review_batch AS INTEGER) AS review_batch FROM f"""


_CREATED = "CAST(created_at AT TIME ZONE 'UTC' AS VARCHAR)"
_MANIFEST = f"""{_RECORDS}, m AS (SELECT j.job_id, output_format, record_count, {_CREATED} AS made, CAST(to_json({{'job_id': j.job_id, 'file_id': doc_id, 'format': output_format, 'record_count': record_count, 'created_at': {_CREATED}, 'schema_version': '2.0'}}) AS VARCHAR) AS manifest
 FROM (SELECT DISTINCT * FROM jobs) j JOIN (SELECT job_id, count(*) AS record_count FROM rec GROUP BY job_id) USING (job_id))"""
_KNOWN = {"datasetName": "'dataset'", "recordCount": "record_count", "format": "output_format", "generatedAt": "made", "schemaVersion": "'2.0'", "validationStatus": "'passed'", "finalRecordCount": "record_count"}
_METADATA = ", ".join(f"'{name}': " + _KNOWN.get(name, "NULL" if other is None else f"'{other}'" if isinstance(other, str) else json.dumps(other)) for name, _, other in METADATA_FIELDS)

ORACLE_SQL: dict[str, str] = {
    "document_statistics": f"WITH {_STATS} SELECT *, CASE WHEN character_count < 20 THEN 'suspicious' ELSE 'valid' END AS quality FROM st",
    "structure_analysis": f"WITH {_STATS} SELECT doc_id, heading_count AS section_count, heading_count, table_count, page_count AS available_page_count, character_count AS content_volume, CASE WHEN heading_count > 0 OR table_count > 0 THEN 'Structured content detected' ELSE 'Linear text content' END AS structure_summary FROM st",
    "extract_elements": f"WITH {_LINES} SELECT doc_id, substr(sha256(concat_ws(':', doc_id, ord, element_type, 'None', text)), 1, 20) AS element_id, element_type, ord, text FROM ln",
    "section_paths": f"WITH {_LINES} SELECT doc_id, ord, coalesce(last_value(CASE WHEN element_type = 'heading' THEN {_strip('text')} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM ln",
    "batch_plan": f"WITH RECURSIVE {_PLAN} SELECT doc_id, element_id, ord, CAST(batch_no AS INTEGER) AS batch_no, CAST(alias_no AS INTEGER) AS alias_no, CAST(tokens AS INTEGER) AS tokens FROM f",
    "context_batches": f"""WITH RECURSIVE {_PLAN},
g AS (SELECT f.doc_id, batch_no, sum(tokens) AS t, count(*) AS units, string_agg('[source_' || alias_no || ']' || chr(10) || CASE WHEN whole > {OPTIONS.budget} THEN substr(full_text, 1, {OPTIONS.budget * 4}) ELSE full_text END, chr(10) || chr(10) ORDER BY alias_no) AS text FROM f JOIN us ON us.doc_id = f.doc_id AND us.i = f.i GROUP BY f.doc_id, batch_no),
h AS (SELECT *, max(batch_no) OVER (PARTITION BY doc_id) AS last FROM g)
SELECT doc_id, CAST(batch_no AS INTEGER) AS batch_no, 'batch-' || batch_no AS batch_id, CAST(t AS INTEGER) AS estimated_input_tokens, CAST(CASE WHEN batch_no < last THEN greatest(1, least({OPTIONS.records_per_batch}, {OPTIONS.record_limit} - (batch_no - 1) * {OPTIONS.records_per_batch})) ELSE {min(OPTIONS.records_per_batch, OPTIONS.record_limit)} END AS INTEGER) AS requested_records, CAST(units AS INTEGER) AS units, md5(text) AS text_md5 FROM h""",
    "requested_counts": f"SELECT DISTINCT job_id, CAST(least(CASE WHEN regexp_extract(prompt, '{RECORD_COUNT}', 1) = '' THEN 4 ELSE CAST(regexp_extract(prompt, '{RECORD_COUNT}', 1) AS INTEGER) END, 20) AS INTEGER) AS requested FROM (SELECT DISTINCT * FROM jobs)",
    "alias_units": "SELECT batch_key, 'source_' || i AS alias, element_id, element_id IN (SELECT element_id FROM elements) AS known FROM (SELECT batch_key, unnest(range(1, len(source_element_ids) + 1)) AS i, unnest(source_element_ids) AS element_id FROM context_batches)",
    "normalize_text": f"SELECT doc_id, md5({_norm_full('text')}) AS norm_md5 FROM documents",
    "structural_errors": f"WITH {_RECORDS} SELECT job_id, rec_pos, unnest(list_filter([CASE WHEN NOT regexp_matches(coalesce(instruction, ''), '{_NOT_WS}') THEN 'instruction' END, CASE WHEN NOT regexp_matches(coalesce(input_text, ''), '{_NOT_WS}') THEN 'input' END, CASE WHEN NOT regexp_matches(coalesce(output_text, ''), '{_NOT_WS}') THEN 'output' END], lambda x: x IS NOT NULL)) AS field FROM rec",
    "field_issues": f"WITH {_RECORDS} {_FIELD_ISSUES}",
    "reference_issues": f"WITH {_RECORDS} {_REF_ISSUES}",
    "evidence_checks_native": f"WITH {_checks()} SELECT job_id, rec_pos, ev_pos, code FROM chk",
    "exact_duplicates": f"WITH {_RECORDS}, {_finger(_norm_full)} SELECT * FROM dup",
    "grounding_summary_native": _grounding(_norm, "true", ""),
    "grounding_summary": _grounding(_norm_full, "true", _PERCENT),
    "grounding_after_dedup": _grounding(_norm_full, "NOT is_duplicate", _PERCENT),
    "evidence_checks": f"WITH {_checks(_norm_full)} SELECT job_id, rec_pos, ev_pos, code FROM chk",
    "record_summaries": f"""WITH {_found()}
SELECT job_id, rec_pos, name AS record_id, CASE WHEN v > 0 AND n = v AND bad = 0 THEN 'passed' ELSE 'failed' END AS grounding_status, CAST(refs AS INTEGER) AS source_refs, n AS evidence_items, v AS verified,
 coalesce((SELECT string_agg(code, ',' ORDER BY rank, pos, code) FROM issues i WHERE i.job_id = g.job_id AND i.rec_pos = g.rec_pos), '') AS issue_codes FROM g WHERE NOT is_duplicate""",
    "validation_issues": f"""WITH {_found()}
SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY rec_pos NULLS LAST, rank, pos, code) - 1 AS INTEGER) AS issue_pos, coalesce(rec_pos, -1) AS rec_pos, code, severity, field, record_id FROM issues""",
    "quality_summary_given": f"WITH {_found()} {_QUALITY}",
    "validation_overview": f"WITH {_found()}, q AS ({_QUALITY}) SELECT job_id, status, schema_valid, generated, final, valid, invalid, exact_duplicates_removed, near_duplicate_pairs, warnings FROM q",
    "provider_shapes": f"WITH {_RECORDS} SELECT record_id, CASE WHEN record_id % 12 = 3 THEN 'WORKER_ERROR' WHEN record_id % 12 IN (6, 7, 8, 9, 11) THEN 'STRUCTURED_OUTPUT_INVALID' ELSE '' END AS error, CASE WHEN record_id % 12 IN (3, 6, 7, 8, 9, 11) THEN '' ELSE coalesce(instruction, '') END AS instruction FROM rec",
    "review_batches": _review_sql(),
    "manifests": f"WITH {_MANIFEST} SELECT job_id, manifest FROM m",
    "package_metadata": f"WITH {_MANIFEST} SELECT job_id, CAST(to_json({{{_METADATA}}}) AS VARCHAR) AS metadata FROM m",
    "csv_projection": f"""WITH {_RECORDS} SELECT {_GUARDED}, CAST(to_json(map_from_entries(list_sort(map_entries(metadata)))) AS VARCHAR) AS metadata, coalesce(category, '') AS category, coalesce(difficulty, '') AS difficulty,
 CAST(to_json(coalesce(source_refs, [])) AS VARCHAR) AS source_refs, CAST(to_json(list_transform(coalesce(evidence, []), lambda e: {{'quote': e.quote, 'source_ref': e.source_ref}})) AS VARCHAR) AS evidence FROM rec""",
    "provider_parse": f"WITH {_RECORDS} SELECT record_id, coalesce(instruction, '') AS instruction, coalesce(context, '') AS context, coalesce(expected_output, '') AS expected_output, coalesce(category, 'general') AS category, coalesce(difficulty, 'medium') AS difficulty, CAST(coalesce(len(source_refs), 0) AS INTEGER) AS refs, CAST(coalesce(len(evidence), 0) AS INTEGER) AS evidence_items FROM rec",
    "assembled_records": f"""WITH {_RECORDS}, a AS (SELECT job_id, max(least(CASE WHEN regexp_extract(prompt, '{RECORD_COUNT}', 1) = '' THEN 4 ELSE CAST(regexp_extract(prompt, '{RECORD_COUNT}', 1) AS INTEGER) END, 20)) AS target FROM jobs GROUP BY job_id),
n AS (SELECT record_id, job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY rec_pos) - 1 AS INTEGER) AS rec_pos, target FROM rec JOIN a USING (job_id))
SELECT record_id, job_id, rec_pos, job_id || '-' || (rec_pos + 1) AS name FROM n WHERE rec_pos < target""",
    "category_frequencies": f"WITH {_RECORDS} SELECT job_id, coalesce(category, '') AS category, count(*) AS n FROM rec GROUP BY ALL",
    "review_summary": f"""WITH {_RECORDS}, c AS (SELECT job_id, {_CODES}[record_id % 13 + 1] AS code, row_number() OVER (PARTITION BY job_id ORDER BY rec_pos) AS n FROM rec),
k AS (SELECT job_id, code, code IN ('AMBIGUOUS_INSTRUCTION', 'SOURCE_SUPPORT_CONCERN') AS b FROM c WHERE n <= 25)
SELECT job_id, count(*) AS issues_found, CAST(count_if(b) AS BIGINT) AS blocking_issues, CAST(count_if(NOT b) AS BIGINT) AS warnings, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, CAST(count_if(b) AS BIGINT) > 0 AS revision_required, 'Reviewed ' || job_id AS summary FROM k GROUP BY job_id""",
    "revised_records": f"WITH {_RECORDS} SELECT record_id, CASE WHEN coalesce(difficulty, '') IN ('easy', 'medium', 'hard') THEN difficulty ELSE 'medium' END AS difficulty, CASE WHEN coalesce(difficulty, '') IN ('easy', 'medium', 'hard') THEN '' ELSE 'DIFFICULTY_MISMATCH' END AS reason FROM rec",
    "safe_names": f"WITH {_NAMES} SELECT doc_id, CASE WHEN slug = '' THEN 'document' ELSE slug END AS safe_name, lower(regexp_extract(CASE WHEN slug = '' THEN 'document' ELSE slug END, '[^.](\\.[^.]+)$', 1)) AS extension, CASE WHEN stem = '' THEN 'dataset' ELSE stem END || '-dataset.zip' AS download FROM s",
    "semantic_texts": f"WITH {_RECORDS} SELECT record_id, md5({_SEMANTIC}) AS semantic_md5 FROM rec",
    "resolved_records": f"""WITH {_ELEMENTS}, {_RECORDS}, src AS (SELECT element_id, min({_QUOTE}) AS source_text FROM el GROUP BY element_id),
un AS (SELECT DISTINCT job_id, unnest(source_element_ids) AS element_id FROM context_batches), ut AS (SELECT job_id, element_id, source_text FROM un JOIN src USING (element_id)),
rr AS (SELECT * FROM rec WHERE job_id IN (SELECT job_id FROM un)),
a AS (SELECT x.job_id, rec_pos, bool_or(element_id IS NULL) AS bad, list_sort(list(DISTINCT element_id) FILTER (element_id IS NOT NULL)) AS ids FROM (SELECT job_id, rec_pos, unnest(source_refs) AS ref FROM rr) x LEFT JOIN ut ON ut.job_id = x.job_id AND element_id = ref GROUP BY ALL),
b AS (SELECT x.job_id, rec_pos, bool_or(element_id IS NULL) AS bad, list_sort(list(DISTINCT element_id) FILTER (element_id IS NOT NULL)) AS ids, bool_and(coalesce(contains({_norm_full('source_text')}, {_norm_full('e.quote')}), false)) AS held FROM (SELECT job_id, rec_pos, unnest(evidence) AS e FROM rr) x LEFT JOIN ut ON ut.job_id = x.job_id AND element_id = e.source_ref GROUP BY ALL),
j AS (SELECT rr.job_id, rr.rec_pos, coalesce(a.ids, []) AS ids, coalesce(b.ids, []) AS evidence_ids, CASE WHEN coalesce(a.bad, false) OR coalesce(b.bad, false) THEN 'UNKNOWN_OR_CROSS_BATCH_SOURCE_REF' WHEN len(a.ids) > 0 AND len(b.ids) > 0 AND a.ids <> b.ids THEN 'SOURCE_REF_EVIDENCE_MISMATCH' WHEN NOT coalesce(held, true) THEN 'BATCH_EVIDENCE_NOT_FOUND' ELSE '' END AS error
 FROM rr LEFT JOIN a ON a.job_id = rr.job_id AND a.rec_pos = rr.rec_pos LEFT JOIN b ON b.job_id = rr.job_id AND b.rec_pos = rr.rec_pos)
SELECT job_id, rec_pos, error, CASE WHEN error = '' THEN array_to_string(CASE WHEN len(evidence_ids) > 0 THEN evidence_ids ELSE ids END, ',') ELSE '' END AS refs FROM j""",
    "label_kinds": "SELECT DISTINCT element_id, CASE WHEN contains(element_type, 'table') THEN 'table' WHEN contains(element_type, 'section') OR contains(element_type, 'heading') THEN 'heading' WHEN contains(element_type, 'list') THEN 'list_item' WHEN contains(element_type, 'caption') THEN 'caption' WHEN contains(element_type, 'code') THEN 'code_block' WHEN contains(element_type, 'paragraph') THEN 'paragraph' ELSE 'text' END AS kind, CASE WHEN contains(element_type, 'table') THEN 'table' ELSE 'heading' END AS section_kind FROM elements",
    "table_cells": f"""WITH {_ELEMENTS}, t AS (SELECT element_id, list_transform(list_filter(string_split_regex({_QUOTE}, '{_BREAK}'), lambda l: regexp_matches(l, '{_NOT_WS}')), lambda l: array_to_string(list_transform(string_split(l, '|'), lambda c: {_strip('c')}), '¦')) AS r FROM el WHERE element_type = 'table')
SELECT element_id, CAST(len(r) AS INTEGER) AS n_rows, md5(array_to_string(r, chr(10))) AS cells_md5 FROM t""",
    "record_names": f"WITH {_RECORDS} SELECT record_id, coalesce(nullif(metadata['record_id'], ''), 'record-' || (rec_pos + 1)) AS name, regexp_full_match(job_id, '[A-Za-z0-9]{{32}}') AS job_id_valid FROM rec",
    "document_sizes": "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars / 1048576.0 * 10 + 0.5) / 10) END AS size FROM documents",
    "batch_steps": "SELECT batch_key, batch_no AS number, max(batch_no) OVER (PARTITION BY job_id) AS total FROM context_batches",
    "review_parses": f"WITH {_RECORDS} SELECT record_id, CASE WHEN record_id % 6 IN (0, 5) THEN '' ELSE 'QUALITY_REVIEW_INVALID' END AS error, CASE WHEN record_id % 6 IN (0, 5) THEN 1 ELSE 0 END AS issues, CASE WHEN record_id % 6 IN (0, 5) THEN 'Reviewed ' || record_id ELSE '' END AS summary FROM rec",
    "top_issues": f"WITH {_RECORDS} SELECT job_id, rec_pos AS pos, record_id FROM rec QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rec_pos) <= 5",
    "replacement_pairs": f"""WITH {_RECORDS}, a AS (SELECT job_id, rec_pos, difficulty, count(*) OVER (PARTITION BY job_id) AS total FROM rec),
b AS (SELECT job_id, rec_pos, total, row_number() OVER (PARTITION BY job_id ORDER BY rec_pos) - 1 AS nth, count(*) OVER (PARTITION BY job_id) AS asked FROM a WHERE coalesce(difficulty, '') NOT IN ('easy', 'medium', 'hard')),
c AS (SELECT *, CASE WHEN job_id < '8' THEN asked WHEN job_id < 'c' THEN total ELSE asked + 1 END AS given FROM b)
SELECT job_id, rec_pos, CAST(CASE WHEN given = total THEN rec_pos WHEN given = asked THEN nth ELSE -1 END AS INTEGER) AS new_pos, CASE WHEN given = total OR given = asked THEN '' ELSE 'QUALITY_REVISION_INVALID' END AS error FROM c""",
    "decoded_texts": "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL",
    "report_fields": f"""WITH {_found()}, q AS ({_QUALITY}), n AS (SELECT job_id, count(*) AS issues FROM issues GROUP BY job_id)
SELECT q.job_id, q.status, final, CAST(final AS INTEGER) AS summaries, CASE WHEN coalesce(total_records, 0) = 0 THEN 0.0 ELSE round_even(grounded_records / total_records * 100, 1) END AS grounding_percent, CAST(coalesce(issues, 0) AS INTEGER) AS issues, CAST(warnings AS INTEGER) AS warnings, easy_count AS easy FROM q LEFT JOIN gr USING (job_id) LEFT JOIN n USING (job_id)""",
}
