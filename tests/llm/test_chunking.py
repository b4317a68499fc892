"""Problem 3: pieces of oversized texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm.chunking import _joined, cut_points, split_oversized


def rebuilt(text, points):
    return "".join(text[points[i - 1][1] if i else 0 : b] for i, (_, b, _) in enumerate(points))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n!é́😀", max_size=300), st.integers(3, 40), st.integers(0, 2))
def test_round_trip_and_limits(text, limit, overlap):
    points = cut_points(text, limit, overlap)
    assert all(b - a <= limit for a, b, _ in points)
    assert rebuilt(text, points) == text and all(a[1] < b[1] for a, b in zip(points, points[1:]))
    for (_, end, _), (start, _, _) in zip(points, points[1:]):
        # as stated, or back to the letter whose marks would be parted
        assert start == end - overlap or (start < end - overlap and not _joined(text, start) and _joined(text, end - overlap))


def test_no_tiny_pieces_where_finer_units_fit():
    text = "# One\n\nShort.\n\n" + "A sentence of some words. " * 20
    sizes = [b - a for a, b, _ in cut_points(text, 120, 10)]
    assert all(n >= 60 for n in sizes[:-1])
    marks = "ab" + "e\u0301" * 30
    assert all(not _joined(marks, a) for a, _, _ in cut_points(marks, 20, 5))


def test_coarsest_boundary_wins():
    text = "Alpha beta. Gamma\n\ndelta epsilon zeta eta theta iota"
    first = cut_points(text, 30, 0)[0]
    assert (text[first[0] : first[1]], first[2]) == ("Alpha beta. Gamma\n\n", "paragraph")
    assert [p[2] for p in cut_points("x" * 25, 10, 2)] == ["character", "character", "end"]


def test_overlap_must_be_below_the_limit():
    with pytest.raises(ValueError):
        cut_points("abc", 2, 2)


def test_rows(spark):
    long = "word " * 30
    rows = [("a", None, ["s"]), ("b", "", None), ("c", "short", ["t"]), ("d", long, ["u"]), ("d", long, ["u"]), (None, "y" * 30, None)]
    df = spark.createDataFrame(rows, "k string, text string, path array<string>").selectExpr("*", "'x' AS piece", "1 AS start")
    out = split_oversized(df, ["k"], "text", 20, 5, keep=("path",)).collect()
    assert {r.k for r in out} == {"d", None}
    assert all(len(r.piece) <= 20 for r in out)
    assert all(r.path == ["u"] for r in out if r.k == "d")
    assert split_oversized(df.limit(0), ["k"], "text", 20, 5).count() == 0
    huge = spark.createDataFrame([("h", "ab " * 400_000)], "k string, text string")
    assert split_oversized(huge, ["k"], "text", 2000, 150).count() > 600


def test_clashing_keys(spark):
    df = spark.createDataFrame([("a", "b" * 30)], "piece string, text string")
    with pytest.raises(ValueError):
        split_oversized(df, ["piece"], "text", 20, 5)
