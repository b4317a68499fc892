"""Text primitives against plain Python."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T

SAMPLES = ["", " ", "Plain text", "  padded\t", "straße", "ﬁlm", "a b", "x y", "a\x1cb", "line\x0bbreak", "😀 emoji", "“curly” ’quotes’ ‘left", "ＦＵＬＬ", "a\r\nb\rc", "İstanbul", "…", None]


def exact(value):
    value = unicodedata.normalize("NFKC", value or "")
    for a, b in (("“", '"'), ("”", '"'), ("’", "'")):
        value = value.replace(a, b)
    return re.sub(r"\s+", " ", value).strip().casefold()


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")


def column(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_strip_lines_blank_words_tokens(samples):
    s = F.col("s")
    assert column(samples, T.strip(s)) == [None if v is None else v.strip() for v in SAMPLES]
    assert column(samples, T.is_blank(s)) == [not (v or "").strip() for v in SAMPLES]
    assert column(samples, T.word_count(s)) == [len(re.findall(r"\S+", v or "")) for v in SAMPLES]
    assert column(samples, T.estimate_tokens(s)) == [max(1, (len(v or "") + 3) // 4) for v in SAMPLES]
    got = column(samples, T.lines(s))
    assert [[x for x in g if x.strip()] for g in got if g is not None] == [[x for x in v.splitlines() if x.strip()] for v in SAMPLES if v is not None]


def test_normal_form(samples):
    assert column(samples, T.normalize_source("s")) == [exact(v) for v in SAMPLES]
    same = samples.where("i in (0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 13)")
    assert column(same, T.normalize_source_native(F.col("s"))) == column(same, T.normalize_source("s"))


def test_fingerprint_of_semantic_text(spark):
    rows = [("Do it", "", "old in", None, "old out", "general", "easy"), ("Do  IT", "old in", None, "old out", None, "general", "easy")]
    df = spark.createDataFrame(rows, "instruction string, context string, input_text string, expected_output string, output_text string, category string, difficulty string")
    out = [r[0] for r in df.select(F.sha2(T.normalize_source(T.semantic_text()), 256)).collect()]
    assert out == [hashlib.sha256(b"do it|old in|old out|general|easy").hexdigest()] * 2


@pytest.mark.parametrize("prompt, count", [("Create 14 records about X", 14), ("8 source-grounded examples", 8), ("99 items", 20), ("no number", 4), (None, 4), ("5 " + "x" * 50 + " records", 4), ("3\nrecords", 4), ("Give 0012 items", 4)])
def test_requested_count(spark, prompt, count):
    assert spark.createDataFrame([(prompt,)], "p string").select(T.requested_count(F.col("p"), 20)).first()[0] == count


def test_names(spark):
    rows = [("a/b/My file (1).PDF",), ("../x.txt",), ("",), (None,), ("ünï.docx",), ("...",), ("plain",), (".txt",)]
    df = spark.createDataFrame(rows, "n string")
    safe = T.safe_filename(F.col("n"))
    out = df.select(safe.alias("s"), T.extension(safe).alias("e"), T.download_name(F.col("n")).alias("d")).collect()
    assert [(r.s, r.e) for r in out][:4] == [("My_file_1_.PDF", ".pdf"), ("x.txt", ".txt"), ("document", ""), ("document", "")]
    assert [r.d for r in out][:4] == ["My-file-1-dataset.zip", "x-dataset.zip", "dataset-dataset.zip", "dataset-dataset.zip"]


def test_small_ones(spark):
    row = spark.range(1).select(T.percent(F.lit(1), F.lit(3)), T.percent(F.lit(1), F.lit(0)), T.percent(F.lit(1), F.lit(400)), T.is_job_id(F.lit("a" * 32)), T.is_job_id(F.lit("a" * 31 + "-")), T.batch_progress(F.lit("batch 2 of 5")), T.batch_progress(F.lit("done")), T.bounded(F.lit("abc"), 2)).first()
    assert row[:5] == (33.3, 0.0, 0.2, True, False) and tuple(row[5]) == (2, 5) and row[6] is None and row[7] == "ab"
