"""Problem 8: the mix meets its targets."""

from pathlib import Path

import pandas as pd
import pytest

from docloom.llm.mixing import TOKENIZER, count_tokens, mix, source_budgets

pytestmark = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no tokenizer files here")


def test_budgets_share_what_a_source_lacks():
    targets = pd.DataFrame({"source": ["a", "b", "none"], "target_share": [0.5, 0.3, 0.2], "max_repeats": [1, 1, 3]})
    totals = pd.DataFrame({"source": ["a", "b"], "have": [10.0, 1000.0], "docs": [1.0, 10.0]})
    out = source_budgets(totals, targets, 100.0).set_index("source")["want"]
    assert out["a"] == 10.0 and out["none"] == 0.0 and abs(out["b"] - 90.0) < 1e-9


def test_mix(spark):
    docs = [(i, f"word number {i} " * (1 + i % 9), "abc"[min(2, i % 7)]) for i in range(3000)]
    docs += [docs[0], (None, "x", "a"), (9000, None, "a"), (9001, "", "b"), (9002, "lost", None), (9003, "other text", "zz")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS id", "2 AS tokens", "'r' AS rate")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.15, 1), ("gone", 0.05, 2), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    copies, shares = mix(df, targets)
    got = {r.source: r for r in shares.collect()}
    total = sum(r.mixed_tokens for r in got.values())
    corpus = sum(r.tokens for r in count_tokens(df, "doc_id", "text", "source").collect())
    assert abs(total / corpus - 0.5) < 0.01
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(got[s].actual_share - share / 0.95) < 0.01
        assert got[s].most_copies <= got[s].max_repeats
    assert got["gone"].mixed_tokens == 0
    rows = copies.collect()
    assert len({r.id for r in rows}) == len(rows) and all(r.copies >= 1 for r in rows)
    assert {r.source for r in rows} <= {"a", "b", "c"}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    copies, shares = mix(docs, targets)
    assert copies.count() == 0 and shares.first().actual_share == 0.0
