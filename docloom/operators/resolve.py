"""Batch-local source aliases to element ids, and the batch gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import normalize_source


def resolve_aliases(records: DataFrame, units: DataFrame, keys: tuple[str, ...] = ("doc_id", "batch_no")) -> DataFrame:
    """Records with the aliases of their refs and evidence replaced by element ids, and the batch error of each.

    ``records`` has ``keys``, rec_in_batch, source_refs and evidence; ``units`` has ``keys``, alias_no,
    element_id and full_text. An alias counts only in its own batch. Errors, in this order:
    UNKNOWN_OR_CROSS_BATCH_SOURCE_REF, SOURCE_REF_EVIDENCE_MISMATCH, BATCH_EVIDENCE_NOT_FOUND. The
    resolved refs are the distinct sorted refs of the evidence, or of the record if it has none.
    An empty quote is contained in anything. Repeated records are resolved once each.
    """
    own = [*keys, "rec_in_batch"]
    named = units.select(*keys, F.concat(F.lit("source_"), F.col("alias_no").cast("string")).alias("alias"), "element_id", "full_text")
    refs = records.select(*own, F.explode("source_refs").alias("alias")).join(named.drop("full_text"), [*keys, "alias"], "left")
    by_ref = refs.groupBy(*own).agg(F.collect_set("element_id").alias("ref_ids"), F.bool_or(F.col("element_id").isNull()).alias("bad_ref"))
    quotes = records.select(*own, F.posexplode("evidence").alias("ev_pos", "e")).select(*own, "ev_pos", F.coalesce("e.source_ref", F.lit("")).alias("alias"), F.coalesce("e.quote", F.lit("")).alias("quote"))
    matched = quotes.join(named, [*keys, "alias"], "left").withColumn("held", F.contains(normalize_source("full_text"), normalize_source("quote")))
    by_quote = matched.groupBy(*own).agg(
        F.array_sort(F.collect_set(F.struct("ev_pos", F.col("element_id").alias("source_ref"), "quote"))).alias("ev"),
        F.collect_set("element_id").alias("quote_ids"),
        F.bool_or(F.col("element_id").isNull()).alias("bad_quote_ref"),
        F.bool_and(F.coalesce("held", F.lit(False))).alias("all_held"),
    )
    none = F.array().cast("array<string>")
    joined = records.join(by_ref, own, "left").join(by_quote, own, "left")
    a, b = F.array_sort(F.coalesce("ref_ids", none)), F.array_sort(F.coalesce("quote_ids", none))
    error = (
        F.when(F.coalesce("bad_ref", F.lit(False)) | F.coalesce("bad_quote_ref", F.lit(False)), "UNKNOWN_OR_CROSS_BATCH_SOURCE_REF")
        .when((F.size(a) > 0) & (F.size(b) > 0) & (a != b), "SOURCE_REF_EVIDENCE_MISMATCH")
        .when(~F.coalesce("all_held", F.lit(True)), "BATCH_EVIDENCE_NOT_FOUND")
    )
    evidence = F.transform(F.coalesce("ev", F.array().cast("array<struct<ev_pos:int,source_ref:string,quote:string>>")), lambda e: F.struct(e.source_ref.alias("source_ref"), e.quote.alias("quote")))
    kept = [c for c in records.columns if c not in ("source_refs", "evidence")]
    return joined.select(*kept, F.when(F.size(b) > 0, b).otherwise(a).alias("source_refs"), evidence.alias("evidence"), error.alias("batch_error"))


def assemble(records: DataFrame, generation: str = "job_id", target: str = "target") -> DataFrame:
    """Accepted records of each generation in batch order, at most ``target``, renumbered from 0 with application ids.

    The window sees one generation, which a request bounds.
    """
    order = Window.partitionBy(generation).orderBy("batch_no", "rec_in_batch")
    placed = records.withColumn("rec_pos", F.row_number().over(order) - 1).where(F.col("rec_pos") < F.col(target))
    record_id = F.concat(F.col(generation), F.lit("-"), (F.col("rec_pos") + 1).cast("string"))
    renamed = F.map_concat(F.map_filter("metadata", lambda k, v: k != "record_id"), F.create_map(F.lit("record_id"), record_id))
    return placed.withColumn("metadata", renamed).drop(target)
