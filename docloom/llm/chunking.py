"""Problem 3: oversized texts cut at natural boundaries, with overlap.

A recursive separator hierarchy (section, paragraph, sentence, word, character) is packed greedily:
every piece is the longest run of whole units of the coarsest level that still fits, and a unit that
does not fit alone is cut at the next finer level.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import read_table

#: Boundaries from coarse to fine; a unit begins where a match ends.
LEVELS: tuple[tuple[str, re.Pattern[str]], ...] = (
    ("section", re.compile(r"\n\s*\n(?=\[source_\d+\]\n|#{1,6} |\d+(?:\.\d+)*\.? +[^\W\d_])")),
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"[.!?…][\"'”’»)\]]*\s+")),
    ("word", re.compile(r"\s+")),
)

PIECE = T.StructType(
    [
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("piece", T.StringType()),
        T.StructField("cut_level", T.StringType()),
    ]
)


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part a character from its marks or joiners."""
    return 0 < at < len(text) and (unicodedata.combining(text[at]) > 0 or text[at] in "\u200D\uFE0F" or text[at - 1] == "\u200D")


#: Share of the limit that a piece fills before a boundary of a finer level is looked for.
FILL = 0.5


def cut_points(text: str, limit: int, overlap: int, fill: float = FILL) -> list[tuple[int, int, str]]:
    """(start, end, level of the cut at the end) of each piece.

    A piece starts ``overlap`` characters before the end of the one before (a few more where it would
    part a letter from its marks), and the text is piece 1 followed by what each later piece has
    beyond the end of the one before. The coarsest boundary that fills ``fill`` of the limit is cut
    at; if there is none of any level, the coarsest there is. Each cut lies beyond the one before, so
    every piece adds something.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if len(text) <= limit:
        return [(0, len(text), "end")]
    ends = [(name, [m.end() for m in pattern.finditer(text)]) for name, pattern in LEVELS]
    out, start, cut = [], 0, 0
    while len(text) - start > limit:
        floor, most, found = max(cut, start + overlap), start + limit, None
        for name, at in ends:
            k = bisect_right(at, most) - 1
            if k >= 0 and at[k] > floor:
                found = found or (at[k], name)
                if at[k] - start >= fill * limit:
                    found = (at[k], name)
                    break
        if found:
            cut, level = found
        else:
            cut, level = most, "character"
            while cut > floor + 1 and _joined(text, cut):
                cut -= 1
            if _joined(text, cut):
                cut = most
        out.append((start, cut, level))
        start = cut - overlap
        while _joined(text, start) and cut - start < limit - 1:
            start -= 1
        if _joined(text, start):  # nothing but marks
            start = cut - overlap
    out.append((start, len(text), "end"))
    return out


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of every text of more than ``limit`` characters.

    Returns ``keys`` and ``keep`` as they are, then piece_no (from 1), start, end, piece and
    cut_level. Null, empty and fitting texts give no row; a repeated row gives its pieces again; an
    empty table gives an empty result. Other columns of ``df`` are ignored, whatever their names.
    No shuffle: only oversized rows leave the JVM, one Arrow batch at a time.
    """
    columns = [*keys, *keep]
    if clash := set(columns) & {f.name for f in PIECE}:
        raise ValueError(f"rename {sorted(clash)} before splitting")
    chosen = df.where(F.length(text) > limit).select(*columns, F.col(text).alias("__text"))
    schema = T.StructType([chosen.schema[c] for c in columns] + PIECE.fields)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                *rest, whole = row
                for n, (a, b, level) in enumerate(cut_points(whole, limit, overlap), 1):
                    rows.append((*rest, n, a, b, whole[a:b], level))
            yield pd.DataFrame(rows, columns=schema.names)

    return chosen.mapInPandas(cut, schema)


def limits_in_characters(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, int]]:
    """(limit, overlap) of the two item kinds, in characters.

    An estimated token stands for four characters, rounded up, so n tokens hold 4 n characters.
    """
    factor = {"characters": 1, "estimated_tokens": 4}
    wanted = read_table(spark, sf_dir, "size_limits").where(F.col("item_kind").isin("elements", "context_batches"))
    one = wanted.groupBy("item_kind").agg(F.max(F.struct("max_size", "overlap_size", "size_unit")).alias("x")).select("item_kind", "x.*")
    return {r.item_kind: (r.max_size * factor[r.size_unit], r.overlap_size * factor[r.size_unit]) for r in one.collect()}


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all oversized elements (with their section path) and context batches."""
    limits = limits_in_characters(spark, sf_dir)
    elements = read_table(spark, sf_dir, "elements").select(F.lit("elements").alias("src"), F.col("element_id").alias("row_key"), "section_path", "text")
    batches = read_table(spark, sf_dir, "context_batches").select(F.lit("context_batches").alias("src"), F.col("batch_key").alias("row_key"), F.lit(None).cast("array<string>").alias("section_path"), "text")
    parts = [split_oversized(t, ["src", "row_key"], "text", *limits[kind], keep=("section_path",)) for kind, t in (("elements", elements), ("context_batches", batches))]
    return parts[0].unionByName(parts[1]).dropDuplicates(["src", "row_key", "piece_no"])


def p3_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_key, text_md5, fits, overlaps): the digest of each text put together from its pieces, whether all pieces are within the limit, and whether all overlaps are as stated or a few marks more."""
    limits = limits_in_characters(spark, sf_dir)
    of = lambda i: F.when(F.col("src") == "elements", limits["elements"][i]).otherwise(limits["context_batches"][i])
    parts = p3_pieces(spark, sf_dir).groupBy("src", "row_key").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece"))).alias("p"))
    before = lambda i: F.get("p", i - 1).end
    added = F.transform("p", lambda x, i: F.when(i == 0, x.piece).otherwise(F.substring(x.piece, before(i) - x.start + 1, F.length(x.piece))))
    stated = F.forall(F.transform("p", lambda x, i: (i == 0) | (before(i) - x.start).between(of(1), of(1) + 10)), lambda ok: ok)
    return parts.select("src", "row_key", F.md5(F.array_join(added, "")).alias("text_md5"), F.forall("p", lambda x: F.length(x.piece) <= of(0)).alias("fits"), stated.alias("overlaps"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_key) of the rows over the limit, taken from their pieces."""
    return p3_pieces(spark, sf_dir).where("piece_no = 2").select("src", "row_key")


P3_FOUND_SQL = """
SELECT DISTINCT 'elements' AS src, element_id AS row_key FROM elements WHERE length(text) > (SELECT max_size FROM size_limits WHERE item_kind = 'elements')
UNION
SELECT DISTINCT 'context_batches', batch_key FROM context_batches WHERE greatest(1, (length(coalesce(text, '')) + 3) // 4) > (SELECT max_size FROM size_limits WHERE item_kind = 'context_batches')
"""

P3_REBUILT_SQL = """
SELECT DISTINCT 'elements' AS src, element_id AS row_key, md5(text) AS text_md5, true AS fits, true AS overlaps FROM elements WHERE length(text) > (SELECT max_size FROM size_limits WHERE item_kind = 'elements')
UNION
SELECT DISTINCT 'context_batches', batch_key, md5(text), true, true FROM context_batches WHERE greatest(1, (length(coalesce(text, '')) + 3) // 4) > (SELECT max_size FROM size_limits WHERE item_kind = 'context_batches')
"""
