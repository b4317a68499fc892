"""Texts to typed, ordered elements, and what can be counted in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import is_blank, lines, strip, word_count

#: Kinds of element.
KINDS = ("heading", "paragraph", "list_item", "table", "caption", "code_block", "text")

SHORT_TEXT = "Extracted content is unusually short; review before generation."


def element_id(file_id: Column, order: Column, kind: Column, text: Column, page: Column) -> Column:
    """Stable id: the first 20 hex digits of a SHA-256 over file, order, kind, page and text."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.substring(F.sha2(F.concat_ws(":", file_id.cast("string"), order.cast("string"), kind, none(page), text), 256), 1, 20)


def line_kind(line: Column) -> Column:
    """A line of at most 100 characters in capitals, or ending in a colon, is a heading."""
    capitals = (F.upper(line) == line) & (F.lower(line) != line)
    return F.when((F.length(line) <= 100) & (capitals | line.endswith(":")), "heading").otherwise("paragraph")


def label_kind(label: Column) -> Column:
    """Kind of an item that a layout model labelled; the tests apply in this order."""
    low = F.lower(F.coalesce(label, F.lit("text")))
    out = F.lit("text")
    for part, kind in (("paragraph", "paragraph"), ("code", "code_block"), ("caption", "caption"), ("list", "list_item"), ("heading", "heading"), ("section", "heading"), ("table", "table")):
        out = F.when(low.contains(part), kind).otherwise(out)
    return out


def table_rows(text: Column) -> Column:
    """Rows and cells of a table given as lines with bars; blank lines are no rows."""
    kept = F.filter(lines(text), lambda row: ~is_blank(row))
    return F.transform(kept, lambda row: F.transform(F.split(row, r"\|"), strip))


def extract_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One element for each line that is not blank: doc_id, element_id, element_type, text, ord, section_path, source_location.

    ``ord`` is the physical line number, so blank lines leave gaps. The section path is the last
    heading up to and with the line. All of it happens inside the row, without a shuffle. Null and
    empty texts have no element; repeated documents give their elements again.
    """
    numbered = docs.select(F.col(doc_id).alias("doc_id"), lines(F.col(text)).alias("ls")).where(F.col("ls").isNotNull())
    heads = F.filter(
        F.transform("ls", lambda line, i: F.when((line_kind(line) == "heading") & ~is_blank(line), F.struct(i.alias("at"), strip(line).alias("head")))),
        lambda h: h.isNotNull(),
    )
    rows = numbered.withColumn("heads", heads).select("doc_id", "heads", F.posexplode("ls").alias("pos", "text")).where(~is_blank(F.col("text")))
    section = F.try_element_at(F.filter("heads", lambda h: h.at <= F.col("pos")), F.lit(-1))
    order = F.col("pos") + 1
    kind = line_kind(F.col("text"))
    return rows.select(
        "doc_id",
        element_id(F.col("doc_id"), order, kind, F.col("text"), F.lit(None)).alias("element_id"),
        kind.alias("element_type"),
        "text",
        order.alias("ord"),
        F.array_compact(F.array(section.head)).alias("section_path"),
        F.struct(F.lit(None).cast("int").alias("page_number"), order.alias("line_start"), order.alias("line_end"), F.concat(F.lit("line:"), order.cast("string")).alias("locator")).alias("source_location"),
    )


def distinct_elements(elements: DataFrame) -> DataFrame:
    """Elements with redelivered rows once, the earliest arrival."""
    order = F.col("ingested_at") if "ingested_at" in elements.columns else F.col("ord")
    rest = [c for c in elements.columns if c not in ("doc_id", "element_id")]
    return elements.groupBy("doc_id", "element_id").agg(F.min_by(F.struct(*rest), order).alias("e")).select("doc_id", "element_id", "e.*")


def meaningful(rows: str = "table_rows") -> Column:
    """Whether an element has text or table rows."""
    return ~is_blank(F.col("text")) | (F.coalesce(F.size(rows), F.lit(0)) > 0)


def document_statistics(elements: DataFrame, rows: str = "table_rows") -> DataFrame:
    """Counters of each document: characters and words of its meaningful elements, and elements by kind.

    Documents without a meaningful element have no row: that is an empty extraction. One partial
    aggregation, so a document of any size is no hot task.
    """
    kind = lambda k: F.count_if(F.col("element_type") == k)
    useful = meaningful(rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    stats = elements.groupBy("doc_id").agg(
        F.max("page_number").alias("page_count"),
        F.sum(F.when(useful, F.length(text)).otherwise(0)).alias("character_count"),
        F.sum(F.when(useful, word_count(text)).otherwise(0)).alias("word_count"),
        F.count(F.lit(1)).alias("element_count"),
        kind("heading").alias("heading_count"),
        kind("paragraph").alias("paragraph_count"),
        kind("list_item").alias("list_item_count"),
        kind("table").alias("table_count"),
        F.sum(F.coalesce(F.greatest(F.size(rows), F.lit(0)), F.lit(0))).alias("table_row_count"),
        F.count_if(useful).alias("non_empty_element_count"),
    )
    quality = F.when(F.col("character_count") < 20, "suspicious").otherwise("valid")
    return stats.where("non_empty_element_count > 0").withColumn("quality", quality).withColumn("warnings", F.when(quality == "suspicious", F.array(F.lit(SHORT_TEXT))).otherwise(F.array().cast("array<string>")))


def empty_extractions(docs: DataFrame, elements: DataFrame, rows: str = "table_rows") -> DataFrame:
    """Documents from which nothing meaningful was extracted."""
    return docs.join(elements.where(meaningful(rows)).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("EMPTY_EXTRACTION").alias("code"))


def structure_analysis(statistics: DataFrame) -> DataFrame:
    """Sections, headings, tables, pages and volume of each document, and whether it is structured."""
    structured = (F.col("heading_count") > 0) | (F.col("table_count") > 0)
    return statistics.select(
        "doc_id",
        F.col("heading_count").alias("section_count"),
        "heading_count",
        "table_count",
        F.col("page_count").alias("available_page_count"),
        F.col("character_count").alias("content_volume"),
        F.when(structured, "Structured content detected").otherwise("Linear text content").alias("structure_summary"),
    )


def quoteable_text(kind: str = "element_type", text: str = "text", rows: str = "table_rows") -> Column:
    """The text that may be quoted: a table's rows as lines with bars, else the text."""
    table = F.array_join(F.transform(rows, lambda row: F.array_join(row, " | ")), "\n")
    return F.when((F.col(kind) == "table") & (F.size(rows) > 0), table).otherwise(F.coalesce(F.col(text), F.lit("")))
