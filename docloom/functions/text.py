"""Text primitives as column expressions; Python runs only where no native form exists."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of letters or digits.
WORD = r"[\p{L}\p{N}]+"

# The 29 white-space characters and the line breaks of Unicode text processing.
BLANK = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LINE_BREAK = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def words(text: Column) -> Column:
    """Lower-case words of ``text`` in order; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def strip(text: Column) -> Column:
    """``text`` without Unicode white space at either end."""
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def is_blank(text: Column) -> Column:
    """Whether nothing but Unicode white space is in ``text``; null counts as blank."""
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{BLANK}]")


def lines(text: Column) -> Column:
    """The physical lines of ``text``."""
    return F.split(text, LINE_BREAK)


def word_count(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([^{BLANK}]+)"), F.lit(1)))


def chars_to_tokens(n: Column) -> Column:
    """Estimated tokens of ``n`` characters: one per four, rounded up, at least one."""
    return F.greatest(F.lit(1), F.floor((n + F.lit(3)) / F.lit(4)).cast("int"))


def estimate_tokens(text: Column) -> Column:
    """Estimated tokens of ``text``; null counts as empty."""
    return chars_to_tokens(F.length(F.coalesce(text, F.lit(""))))


def _normal(value: str) -> str:
    value = unicodedata.normalize("NFKC", value)
    for curly, plain in (("“", '"'), ("”", '"'), ("’", "'")):
        value = value.replace(curly, plain)
    return re.sub(r"\s+", " ", value).strip().casefold()


@F.pandas_udf(T.StringType())
def normalize_source(text: pd.Series) -> pd.Series:
    """Comparison form: compatibility normalisation, three quotes made plain, white space collapsed, case folded. Null counts as empty."""
    return text.map(lambda v: _normal(v or ""))


def normalize_source_native(text: Column) -> Column:
    """The same inside the JVM, equal for texts without compatibility characters; the sharp s is the one letter that case folding changes beyond lower case."""
    quoted = F.translate(F.coalesce(text, F.lit("")), "“”’", "\"\"'")
    return F.replace(F.lower(F.trim(F.regexp_replace(quoted, f"[{BLANK}]+", " "))), F.lit("ß"), F.lit("ss"))


def semantic_text() -> Column:
    """The fields by which two records are the same, joined by a pipe; context and answer fall back to the older columns."""
    fall_back = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old), F.lit(""))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws("|", empty("instruction"), fall_back("context", "input_text"), fall_back("expected_output", "output_text"), empty("category"), empty("difficulty"))


# Fixed value: pattern of a stated number of records: the number, at most 40 characters of one line, the noun.
RECORD_COUNT = r"(?i)\b(\d{1,3})\b[^\n]{0,40}?\b(?:records?|examples?|items?)\b"


def requested_count(prompt: Column, limit: int, default: int = 4) -> Column:
    """The number of records a prompt asks for, ``default`` if none, at most ``limit``."""
    found = F.regexp_extract(F.coalesce(prompt, F.lit("")), RECORD_COUNT, 1)
    return F.least(F.when(found == "", default).otherwise(found.cast("int")), F.lit(limit))


def json_text_length(text: Column) -> Column:
    """Characters of ``text`` as a JSON string with its quotes, where only what JSON requires is escaped; null counts as empty."""
    value = F.coalesce(text, F.lit(""))
    short = F.length(F.regexp_replace(value, r'[^"\\\n\r\t\x08\x0C]', ""))
    long = F.length(F.regexp_replace(value, r"[^\x00-\x07\x0B\x0E-\x1F]", ""))
    return F.length(value) + short + F.lit(5) * long + F.lit(2)


def human_size(size: Column) -> Column:
    """A number of bytes as B, KB or MB, with one place from a kilobyte on."""
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.format_string("%.1f KB", size / 1024)).otherwise(F.format_string("%.1f MB", size / (1024 * 1024)))


def batch_progress(text: Column) -> Column:
    """(number, total) of "batch N of M", null where the text says nothing of the kind."""
    n = lambda k: F.regexp_extract(text, r"batch (\d+) of (\d+)", k)
    return F.when(n(1) != "", F.struct(n(1).cast("int").alias("number"), n(2).cast("int").alias("total")))


def percent(part: Column, whole: Column) -> Column:
    """Percentage to one place, ties to even; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.bround(part / F.nullif(whole, F.lit(0)) * 100, 1))


def is_job_id(text: Column) -> Column:
    """Whether ``text`` is 32 letters or digits."""
    return F.coalesce(text, F.lit("")).rlike("^[A-Za-z0-9]{32}$")


def bounded(text: Column, n: int) -> Column:
    """The first ``n`` characters of an error text."""
    return F.substring(text, 1, n)


def base_name(name: Column) -> Column:
    """The part of a path after its last slash; null counts as "document"."""
    cut = F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit("document")), "/+$", "")
    return F.regexp_extract(cut, "([^/]*)$", 1)


def safe_filename(name: Column) -> Column:
    """A file name of ASCII letters, digits and ``._-`` only."""
    slug = F.regexp_replace(F.regexp_replace(base_name(name), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(slug == "", "document").otherwise(slug)


def extension(name: Column) -> Column:
    """The lower-case extension of a safe file name, with its dot; empty if it has none."""
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def download_name(name: Column) -> Column:
    """Name of the archive made from a source file."""
    stem = F.regexp_replace(base_name(F.coalesce(F.nullif(name, F.lit("")), F.lit("dataset"))), r"(?<=.)\.[^.]+$", "")
    slug = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9_-]+", "-"), "^[-_]+|[-_]+$", "")
    return F.concat(F.when(slug == "", "dataset").otherwise(slug), F.lit("-dataset.zip"))
