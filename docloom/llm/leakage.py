"""Problem 7: evaluation passages in a training corpus, by a positional inverted index.

The index is split by document: a shard holds the posting lists of its own documents, and every
shard answers every query by itself, so neither building nor searching it moves a posting. A posting
is a word's offset in its shard; documents lie apart by a gap, so that no match crosses from one to
the next. Query items go out in blocks of a bounded size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import cut_lineage, read_table

#: Consecutive words that make a leak.
RUN = 13
#: Offsets between the documents of a shard; a search window must be narrower.
GAP = 64
#: Characters of a shard, and words of a block of query items; a longer text or item is one by itself.
SHARD_CHARS, BLOCK_WORDS = 8_000_000, 200_000

_WORD = re.compile(r"[^\W_]+")
Postings = dict[str, np.ndarray]


def shard_postings(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, order, counts, starts) of a shard: its words, their offsets grouped by term, postings of each term, and the first offset of each text."""
    found = [_WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(w) for w in found], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + GAP)[:-1]]) if len(sizes) else np.zeros(0, dtype=np.int64)
    words = pa.array([w for own in found for w in own], pa.string()).dictionary_encode()
    term = words.indices.to_numpy(zero_copy_only=False)
    offset = np.arange(len(term)) + np.repeat(np.arange(len(sizes)) * GAP, sizes)
    grouped = np.argsort(term, kind="stable")
    return words, offset[grouped].astype(np.int32), np.bincount(term, minlength=len(words.dictionary)), starts.astype(np.int32)


def positional_index(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, ids, offsets): the posting lists of each shard, after a row with the empty term, its document ids and their first offsets.

    Rows of a shard follow each other in one partition; store the result by ``checkpoint`` or in files
    that are not split, and it answers any number of searches. No shuffle. Rows with a null id are
    skipped, and null or empty texts have no postings.
    """
    kind = df.schema[doc_id].dataType
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("offsets", T.ArrayType(T.IntegerType()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            types = [pa.string(), pa.list_(ids.type), pa.list_(pa.int32())]
            begin, size = 0, 0
            for at, t in enumerate(texts):
                size += len(t)
                if size >= SHARD_CHARS or at == len(texts) - 1:
                    words, offsets, counts, starts = shard_postings(texts[begin : at + 1])
                    own = ids.slice(begin, at + 1 - begin)
                    head = [pa.array([""], types[0]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([starts], types[2])]
                    yield pa.RecordBatch.from_arrays(head, ["term", "ids", "offsets"])
                    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                    lists = [words.dictionary, pa.nulls(len(counts), types[1]), pa.ListArray.from_arrays(ends, pa.array(offsets))]
                    yield pa.RecordBatch.from_arrays(lists, ["term", "ids", "offsets"])
                    begin, size = at + 1, 0

    rows = df.where(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(doc_id, text)
    return rows.mapInArrow(build, schema)


def _among(starts: np.ndarray, offsets: np.ndarray, ahead: int) -> np.ndarray:
    """Which of ``starts`` have a posting ``ahead`` words later."""
    if not len(offsets):
        return np.zeros(len(starts), dtype=bool)
    at = np.searchsorted(offsets, starts + ahead)
    return offsets[np.minimum(at, len(offsets) - 1)] == starts + ahead


_NONE = np.zeros(0, dtype=np.int64)


def exact_runs(words: list[str], postings: Postings, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset, length) of the places where at least ``run`` consecutive words of an item stand.

    For each window the lists are intersected from the rarest term on, adjusted by the words' places
    in the item, until nothing is left. ``offset`` is the place of the first matching word.
    """
    places, windows = [], []
    lists = [postings.get(w, _NONE) for w in words]
    sizes = [len(x) for x in lists]
    for s in range(len(words) - run + 1):
        rarest = sorted(range(s, s + run), key=sizes.__getitem__)
        if not sizes[rarest[0]]:
            continue
        starts = lists[rarest[0]] - rarest[0]
        for j in rarest[1:]:
            starts = starts[_among(starts, lists[j], j)]
            if not len(starts):
                break
        else:
            places.append(starts)
            windows.append(np.full(len(starts), s))
    if not places:
        return _NONE, _NONE
    start, window = np.concatenate(places), np.concatenate(windows)
    order = np.lexsort((window, start))
    start, window = start[order], window[order]
    first = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(window) != 1)])
    at = np.flatnonzero(first)
    return (start + window)[at], np.diff(np.concatenate([at, [len(start)]])) + run - 1


def near_windows(words: list[str], postings: Postings, span: int, least: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset, matched) of the places, by the last offset looked at, where at least ``least`` of ``span`` consecutive item words stand in order, each within ``slack`` words of its place.

    Whichever words are missing, one of the ``span - least + 1`` rarest is there; its postings give the
    places to look at, and the other lists drop those that miss too many words. What remains is
    matched in order, each posting once.
    """
    places, found = [], []
    lists = [postings.get(w, _NONE) for w in words]
    sizes = [len(x) for x in lists]
    around = np.arange(-slack, slack + 1)
    for s in range(len(words) - span + 1):
        rarest = sorted(range(s, s + span), key=sizes.__getitem__)
        anchors = [j for j in rarest[: span - least + 1] if sizes[j]]
        if not anchors:
            continue
        starts = np.unique(np.concatenate([(lists[j][:, None] - j + around).ravel() for j in anchors]))
        missing = np.zeros(len(starts), dtype=np.int64)
        for j in rarest:
            low = np.searchsorted(lists[j], starts + j - slack)
            missing += np.searchsorted(lists[j], starts + j + slack, side="right") == low
            keep = missing <= span - least
            starts, missing = starts[keep], missing[keep]
            if not len(starts):
                break
        if not len(starts):
            continue
        # the longest selection of postings in order; best[:, t] is it up to t words after the place of the first less the slack
        best = np.zeros((len(starts), span + 2 * slack + 1), dtype=np.int64)
        for j in range(s, s + span):
            before = best.copy()
            for shift in around:
                t = j - s + shift + slack
                hit = _among(starts, lists[j], j + shift)
                best[hit, t + 1] = np.maximum(best[hit, t + 1], before[hit, t] + 1)
            best = np.maximum.accumulate(best, axis=1)
        good = best[:, -1] >= least
        places.append(starts[good] + s + span + slack - 1)
        found.append(best[good, -1])
    return (np.concatenate(places), np.concatenate(found)) if places else (_NONE, _NONE)


def _blocks(items: DataFrame, item_id: str, text: str, least: int) -> Iterator[list[tuple]]:
    """(id, words) of the items of at least ``least`` words, in blocks of BLOCK_WORDS words."""
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text).distinct()
    block, size = [], 0
    for row in rows.toLocalIterator():
        own = _WORD.findall(row[1].lower())
        if len(own) >= least:
            block.append((row[0], own))
            size += len(own)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(index: DataFrame, block: list[tuple], kind: T.DataType, match, out: str) -> DataFrame:
    """(doc_id, item_id, ``out``) of the places that ``match`` finds for each item of a block in each shard."""
    spark = index.sparkSession
    vocabulary = spark.createDataFrame([(w,) for w in {"", *(w for _, own in block for w in own)}], "term string")
    queries = spark.sparkContext.broadcast(block)
    ids_type = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", ids_type), T.StructField("item_id", kind), T.StructField(out, T.IntegerType())])

    def answer(ids: pa.Array, starts: np.ndarray, postings: Postings, types: list[pa.DataType]) -> pa.RecordBatch:
        docs, items, values = [], [], []
        for item, words in queries.value:
            offset, value = match(words, postings)
            if len(offset):
                docs.append(np.searchsorted(starts, offset, side="right") - 1)
                items += [item] * len(offset)
                values.append(value)
        doc = ids.take(pa.array(np.concatenate(docs) if docs else _NONE))
        return pa.RecordBatch.from_arrays([doc, pa.array(items, types[1]), pa.array(np.concatenate(values) if docs else _NONE, pa.int64()).cast(pa.int32())], schema.names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [None, to_arrow_type(kind)]
        ids, starts, postings = None, None, {}
        for batch in batches:
            terms, all_ids, lists = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            for at, term in enumerate(terms):
                own = flat[ends[at] : ends[at + 1]]
                if term:
                    postings[term] = own
                else:
                    if ids is not None:
                        yield answer(ids, starts, postings, types)
                    ids, starts, postings = all_ids[at].values, own, {}
        if ids is not None:
            yield answer(ids, starts, postings, types)

    # the vocabulary of a block is bounded by BLOCK_WORDS; a broadcast join leaves the rows of a shard together
    known = index.join(F.broadcast(vocabulary), "term", "left_semi")
    return known.mapInArrow(search, schema).groupBy("doc_id", "item_id").agg(F.max(out).alias(out))


def _find(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, least: int, match, out: str, index: DataFrame | None) -> DataFrame:
    index = cut_lineage(positional_index(docs, doc_id, text)) if index is None else index
    kind = items.schema[item_id].dataType
    parts = [_search(index, block, kind, match, out) for block in _blocks(items, item_id, item_text, least)]
    if not parts:
        none = F.lit(None).cast(kind).alias("item_id")
        return docs.select(F.col(doc_id).alias("doc_id"), none, F.lit(None).cast("int").alias(out)).limit(0)
    # an item of one id may have several texts, in several blocks
    return parts[0] if len(parts) == 1 else reduce(DataFrame.union, parts).groupBy("doc_id", "item_id").agg(F.max(out).alias(out))


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, words): documents that hold at least ``run`` consecutive words of an item, and the longest such run.

    ``index`` is a stored index of the documents; without one it is built and stored first. Items
    shorter than ``run`` words cannot leak; null ids are skipped, null texts count as empty; repeated
    documents and items count once; empty tables give an empty result.
    """
    return _find(docs, items, doc_id, text, item_id, item_text, run, lambda words, postings: exact_runs(words, postings, run), "words", index)


def find_near_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = RUN, share: float = 0.8, slack: int = 3, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, matched): proximity matches, and the most words matched.

    There is a place in the document, and a window of ``span`` consecutive item words, of which at
    least ``share`` stand there in order, each within ``slack`` words of its place in the window. A
    word that the window has twice needs two words of the document. Nulls, repeats and empty tables
    are treated as in :func:`find_leaks`.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    if span + 2 * slack >= GAP:
        raise ValueError("the window with its slack must be narrower than the gap between documents")
    least = math.ceil(share * span - 1e-9)
    return _find(docs, items, doc_id, text, item_id, item_text, span, lambda words, postings: near_windows(words, postings, span, least, slack), "matched", index)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every leak of 13 consecutive words or more."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches of 13 words with a share of 0.8."""
    return find_near_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


P7_FOUND_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM eval_items),
dw AS (SELECT doc_id, array_to_string(w[p:p + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
iw AS (SELECT item_id, array_to_string(w[p:p + 12], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS p FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (gram)
"""
