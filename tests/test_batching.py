"""The batch fold against a restatement."""

import random

import pytest

from docloom.operators import batching
from docloom.operators.batching import BatchOptions, batch_units, context_batches, empty_batches, place_units


def restated(texts, o):
    out, batch, held, tokens = [], 1, 0, 0
    for key, text in texts:
        text = text.strip()
        if not text:
            continue
        whole = max(1, (len(text) + 3) // 4)
        if held and (tokens + whole > o.budget or (o.unit_cap is not None and held >= o.unit_cap)):
            batch, held, tokens = batch + 1, 0, 0
        own = min(whole, o.budget)
        held, tokens = held + 1, tokens + own
        out.append((key, batch, held, own))
    return out


@pytest.mark.parametrize("options", [BatchOptions(512, 4, 4), BatchOptions(512, 2, 9), BatchOptions(1000, 1, 20)])
def test_fold(spark, options):
    rng = random.Random(4)
    rows, expected = [], []
    for d in range(8):
        texts = [(f"{d}-{i}", rng.choice(["", "  ", "x" * rng.randint(1, 900), "y" * rng.randint(1500, 4000)])) for i in range(rng.randint(0, 40))]
        rows += [(f"doc{d}", key, "text", t, i, None) for i, (key, t) in enumerate(texts)]
        expected += [(f"doc{d}", *row) for row in restated(texts, options)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id string, element_id string, element_type string, text string, ord int, table_rows array<array<string>>")
    units = batch_units(df, options)
    got = [(r.doc_id, r.element_id, r.batch_no, r.alias_no, r.tokens) for r in units.orderBy("doc_id", "ord").collect()]
    assert got == expected
    assert all(len(r.text) <= options.budget * 4 and r.full_text.startswith(r.text) for r in units.collect())
    batches = context_batches(units, options).collect()
    assert sum(len(b.source_element_ids) for b in batches) == len(expected)
    for b in batches:
        last = max(x.batch_no for x in batches if x.doc_id == b.doc_id)
        share, limit = options.records_per_batch, options.record_limit
        assert b.requested_records == (min(share, limit) if b.batch_no == last else max(1, min(share, limit - (b.batch_no - 1) * share)))
    docs = df.select("doc_id").distinct()
    assert {r.doc_id for r in empty_batches(docs, units, options).collect()} == {r[0] for r in rows} - {r[0] for r in expected}


@pytest.mark.parametrize("options", [BatchOptions(512, 4, 4), BatchOptions(512, 2, 9), BatchOptions(1000, 1, 20)])
def test_chunks_of_a_large_document(spark, monkeypatch, options):
    """One document with a third of all units, in many chunks, against the plain fold."""
    monkeypatch.setattr(batching, "CHUNK", 1)
    monkeypatch.setattr(batching, "BUCKET", 7)
    monkeypatch.setattr(batching, "_chunk", lambda o: (24, 24))  # no batch of these sizes has more units
    rng = random.Random(12)
    sizes = lambda n: [rng.choice([rng.randint(25, 90), rng.randint(25, 90), rng.randint(300, 900)]) for _ in range(n)]
    docs = {"hot": sizes(700), **{f"d{i}": sizes(rng.choice([1, 23, 24, 25, 60])) for i in range(30)}}
    rows = [(d, f"{d}-{i}", 3 * i, n) for d, own in docs.items() for i, n in enumerate(own)]
    expected = {}
    for d, own in docs.items():
        batch, held, tokens = 1, 0, 0
        for i, n in enumerate(own):
            if held and (tokens + n > options.budget or (options.unit_cap is not None and held >= options.unit_cap)):
                batch, held, tokens = batch + 1, 0, 0
            held, tokens = held + 1, tokens + min(n, options.budget)
            expected[f"{d}-{i}"] = (batch, held, min(n, options.budget))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id string, element_id string, ord int, whole int")
    assert {r.element_id: (r.batch_no, r.alias_no, r.tokens) for r in place_units(df, options).collect()} == expected
