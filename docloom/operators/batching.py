"""Units of a document packed in order into batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import chars_to_tokens, estimate_tokens, strip
from docloom.operators.extraction import quoteable_text
from docloom.session import cut_lineage

#: Text of the one batch of a document without units.
NO_SOURCE = "There is no source text in this document."


@dataclass(frozen=True)
class BatchOptions:
    """Sizes that decide the batches."""

    max_model_len: int = 32768
    records_per_batch: int = 4
    record_limit: int = 4

    @property
    def budget(self) -> int:
        return max(512, int(self.max_model_len * 0.65))

    @property
    def unit_cap(self) -> int | None:
        return max(1, self.records_per_batch * 2) if self.record_limit > self.records_per_batch else None


#: Units of a chunk, and the width of a bucket of ``ord`` that is numbered by itself.
CHUNK, BUCKET = 4096, 4096


def _chunk(options: BatchOptions) -> tuple[int, int]:
    """(units of a chunk, most units of a batch)."""
    longest = min(options.budget, options.unit_cap or options.budget)
    return max(CHUNK, 4 * longest), longest


def _next_starts(whole: np.ndarray, options: BatchOptions) -> np.ndarray:
    """Where the batch after one that starts at each unit starts."""
    at = np.arange(len(whole))
    ends = np.concatenate([[0], np.cumsum(whole)])
    reach = np.searchsorted(ends, ends[:-1] + options.budget, side="right") - 1
    if options.unit_cap is not None:
        reach = np.minimum(reach, at + options.unit_cap)
    return np.maximum(reach, at + 1)


def numbered_units(sizes: DataFrame) -> DataFrame:
    """``sizes`` (doc_id, element_id, ord, whole) with place: the unit's number in its document, from 0, by ord and element_id.

    Numbered inside buckets of ord, and the buckets' counts summed, so a large document is many small windows.
    """
    keyed = sizes.withColumn("bucket", F.floor(F.col("ord") / BUCKET))
    counts = keyed.groupBy("doc_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("doc_id").orderBy("bucket")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("doc_id", "bucket").orderBy("ord", "element_id"))
    return keyed.withColumn("n", inside).join(before, ["doc_id", "bucket"]).select("doc_id", "element_id", "ord", "whole", (F.col("base") + F.col("n") - 1).alias("place"))


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each value of ``keys`` together; they follow each other, but may lie in several batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        change[0] = not held or any(held[-1][k].iloc[-1] != batch[k].iloc[0] for k in keys)
        cuts = np.flatnonzero(change)
        for n, low in enumerate([0, *cuts] if not change[0] else cuts):
            later = cuts[cuts > low]
            if change[low] and held:
                yield pd.concat(held)
                held = []
            held.append(batch.iloc[low : later[0] if len(later) else len(batch)])
    if held:
        yield pd.concat(held)


def chunk_exits(numbered: DataFrame, options: BatchOptions) -> DataFrame:
    """(doc_id, chunk, entry, exit, batches, last): for each unit of a chunk at which a batch may start first, where the next chunk's first batch starts then.

    A batch has a bounded number of units, so only as many entries can occur, and a chunk needs to see
    as many units of the next. ``batches`` start in the chunk, the last of them at place ``last``.
    """
    size, longest = _chunk(options)
    kind = numbered.schema["doc_id"].dataType.simpleString()
    chunk = F.floor(F.col("place") / size)
    twice = F.array(chunk, F.when((F.col("place") % size < longest) & (chunk > 0), chunk - 1))
    seen = numbered.select("doc_id", "place", "whole", F.explode(F.array_compact(twice)).alias("chunk"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches, ["doc_id", "chunk"]):
            first = int(group["chunk"].iloc[0]) * size
            own = min(size, len(group))
            starts = _next_starts(group["whole"].to_numpy(dtype=np.int64), options).tolist()
            leave, count, last = [0] * own, [0] * own, [0] * own
            for i in range(own - 1, -1, -1):
                j = starts[i]
                leave[i], count[i], last[i] = (j, 1, i) if j >= own else (leave[j], count[j] + 1, last[j])
            n = min(longest, own) if first else 1
            yield pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]] * n, "chunk": first // size, "entry": range(n), "exit": [x - own for x in leave[:n]], "batches": count[:n], "last": [first + x for x in last[:n]]})

    ordered = seen.repartition("doc_id", "chunk").sortWithinPartitions("doc_id", "chunk", "place")
    return ordered.mapInPandas(work, f"doc_id {kind}, chunk long, entry int, exit int, batches long, last long")


def chunk_entries(exits: DataFrame) -> DataFrame:
    """(doc_id, chunk, entry, number, open): where the first batch of each chunk starts, its number, and where the batch before it started.

    The one step that walks a document in order; it reads a few rows a chunk.
    """
    kind = exits.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, entry, number, open_ = object(), 0, 1, 0
        for group in _grouped(batches, ["doc_id", "chunk"]):
            key = group["doc_id"].iloc[0]
            if key != doc:
                doc, entry, number, open_ = key, 0, 1, 0
            yield pd.DataFrame({"doc_id": [key], "chunk": group["chunk"].iloc[:1], "entry": entry, "number": number, "open": open_})
            found = group[group["entry"] == entry]
            if len(found):
                entry, number, open_ = int(found["exit"].iloc[0]), number + int(found["batches"].iloc[0]), int(found["last"].iloc[0])

    ordered = exits.repartition("doc_id").sortWithinPartitions("doc_id", "chunk", "entry")
    return ordered.mapInPandas(work, f"doc_id {kind}, chunk long, entry int, number long, open long")


def place_units(sizes: DataFrame, options: BatchOptions) -> DataFrame:
    """doc_id, element_id, ord, batch_no, alias_no and tokens of units given by their sizes."""
    numbered = cut_lineage(numbered_units(sizes))
    size, _ = _chunk(options)
    # a document of one chunk starts at its first unit
    long = numbered.groupBy("doc_id").agg(F.max("place").alias("most")).where(F.col("most") >= size).select("doc_id")
    rows = numbered.withColumn("chunk", F.floor(F.col("place") / size))
    start = {"entry": 0, "number": 1, "open": 0}
    if long.isEmpty():
        rows = rows.select("*", *[F.lit(v).alias(c) for c, v in start.items()])
    else:
        entries = chunk_entries(chunk_exits(numbered.join(long, "doc_id", "left_semi"), options))
        rows = rows.join(entries, ["doc_id", "chunk"], "left").fillna(start)
    budget, cap = options.budget, options.unit_cap
    kind = sizes.schema["doc_id"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, number, held, tokens = None, 0, 0, 0
        for batch in batches:
            numbers, aliases, counted = [], [], []
            for key, chunk, place, whole, entry, first, open_ in zip(batch["doc_id"], batch["chunk"], batch["place"], batch["whole"], batch["entry"], batch["number"], batch["open"]):
                if (key, chunk) != at:
                    at, number, held, tokens = (key, chunk), first - 1, 0, 0
                own = min(whole, budget)
                if place - chunk * size < entry:  # still the last batch of the chunk before
                    numbers.append(first - 1)
                    aliases.append(place - open_ + 1)
                else:
                    if not held or tokens + whole > budget or (cap is not None and held >= cap):
                        number, held, tokens = number + 1, 0, 0
                    held, tokens = held + 1, tokens + own
                    numbers.append(number)
                    aliases.append(held)
                counted.append(own)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "element_id": batch["element_id"], "ord": batch["ord"], "batch_no": numbers, "alias_no": aliases, "tokens": counted})

    ordered = rows.select("doc_id", "chunk", "place", "element_id", "ord", "whole", *start).repartition("doc_id", "chunk").sortWithinPartitions("doc_id", "chunk", "place")
    return ordered.mapInPandas(fold, f"doc_id {kind}, element_id string, ord int, batch_no int, alias_no int, tokens int")


def batch_units(elements: DataFrame, options: BatchOptions) -> DataFrame:
    """doc_id, element_id, ord, batch_no, alias_no, tokens, text (for the prompt) and full_text of every unit.

    A unit opens a new batch if the running estimate would exceed the budget or the batch has the
    most units allowed. A unit over the budget is cut to fit after that test, while its full text
    stays quotable. The rule is a fold over a document's units in order, which is put together from
    chunks: each chunk tells where the next one's first batch starts, for every place where its own
    may start; these are chained along the document, and then every chunk is folded by itself. So a
    document with a tenth of all units is many tasks. Only ids and sizes are folded; texts are joined
    to the result. Elements without text have no unit.
    """
    units = elements.select("doc_id", "element_id", "ord", strip(quoteable_text()).alias("full_text")).where(F.length("full_text") > 0)
    placed = place_units(units.select("doc_id", "element_id", "ord", estimate_tokens(F.col("full_text")).alias("whole")), options)
    cut = F.when(estimate_tokens(F.col("full_text")) > options.budget, F.substring("full_text", 1, options.budget * 4)).otherwise(F.col("full_text"))
    return placed.join(units, ["doc_id", "element_id", "ord"]).withColumn("text", cut)


def context_batches(units: DataFrame, options: BatchOptions) -> DataFrame:
    """One row a batch: its prompt text, estimated tokens, unit ids in order, and the records to ask for.

    Batches but the last ask for what is left of the limit, at most a batch's share; the last asks
    for a batch's share, so the sum may exceed the limit and the surplus is dropped later.
    """
    header = F.concat(F.lit("[source_"), F.col("alias_no").cast("string"), F.lit("]\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("alias_no", "element_id", header.alias("part"))))
    out = units.groupBy("doc_id", "batch_no").agg(F.sum("tokens").cast("int").alias("estimated_input_tokens"), parts.alias("p"))
    last = units.groupBy("doc_id").agg(F.max("batch_no").alias("batches"))
    share, limit = options.records_per_batch, options.record_limit
    asked = F.when(F.col("batch_no") < F.col("batches"), F.greatest(F.lit(1), F.least(F.lit(share), F.lit(limit) - (F.col("batch_no") - 1) * share))).otherwise(min(share, limit))
    return out.join(last, "doc_id").select(
        "doc_id",
        "batch_no",
        F.concat(F.lit("batch-"), F.col("batch_no").cast("string")).alias("batch_id"),
        F.array_join(F.col("p.part"), "\n\n").alias("text"),
        "estimated_input_tokens",
        asked.cast("int").alias("requested_records"),
        F.col("p.element_id").alias("source_element_ids"),
    )


def empty_batches(docs: DataFrame, units: DataFrame, options: BatchOptions) -> DataFrame:
    """The one placeholder batch of each document that has no unit."""
    return docs.join(units.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id",
        F.lit(1).alias("batch_no"),
        F.lit("batch-1").alias("batch_id"),
        F.lit(NO_SOURCE).alias("text"),
        chars_to_tokens(F.lit(len(NO_SOURCE))).alias("estimated_input_tokens"),
        F.lit(min(options.records_per_batch, options.record_limit)).alias("requested_records"),
        F.array().cast("array<string>").alias("source_element_ids"),
    )
