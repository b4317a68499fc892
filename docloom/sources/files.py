"""Uploaded files as documents and elements."""

from __future__ import annotations

import importlib.util
import os
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import extension, safe_filename
from docloom.operators.extraction import extract_lines, label_kind, table_rows
from docloom.session import cut_lineage

ALLOWED = (".pdf", ".docx", ".txt")
MAX_BYTES = 25 * 1024 * 1024


def _listed(path: str, deep: bool) -> list[tuple[str, bool, int]]:
    """(address, whether it is a directory, size) of what lies in a directory, at any depth if ``deep``, or of a file itself."""
    uri = path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))
    system, inside = pafs.FileSystem.from_uri(uri)
    scheme, _, rest = uri.partition("://")
    front = "file:" if scheme == "file" else f"{scheme}://" + ("" if rest.startswith(inside.lstrip("/").split("/")[0]) else rest.split("/")[0])
    info = system.get_file_info(inside)
    found = system.get_file_info(pafs.FileSelector(inside, recursive=deep)) if info.type == pafs.FileType.Directory else [info]
    return [(front + i.path, i.type == pafs.FileType.Directory, int(i.size or 0)) for i in found]


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files without content under ``path``, which a scan has no split and so no row for.

    Listed by tasks: one lists the top level, the rest its directories; nothing comes to the driver.
    """

    def level(deep: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for p in batch["path"]:
                    yield pd.DataFrame(_listed(p, deep), columns=["path", "directory", "size"])

        return work

    schema = "path string, directory boolean, size long"
    top = cut_lineage(spark.createDataFrame([(path,)], "path string").mapInPandas(level(False), schema))
    below = top.where("directory").select("path").repartition("path").mapInPandas(level(True), schema)
    return top.union(below).where("NOT directory AND size = 0").select("path")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, source_filename, extension, content and code of every file under ``path``.

    Files of other types, empty files and files over the limit keep a row with a code and no
    content. The id is a hash of the path, so it does not change between runs. Only allowed sizes
    are read into memory.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = safe_filename(F.col("path"))
    code = F.when(~extension(name).isin(*ALLOWED), "UNSUPPORTED_DOCUMENT").when(F.col("length") == 0, "EMPTY_FILE").when(F.col("length") > MAX_BYTES, "FILE_TOO_LARGE")
    same = lambda p: F.regexp_replace(p, "^file:/+", "file:/")
    empty = empty_files(spark, path).select(same(F.col("path")).alias("path"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("binary").alias("content"))
    raw = raw.where(F.col("length") > 0).select(same(F.col("path")).alias("path"), "length", "content").unionByName(empty)
    return raw.select(F.substring(F.sha2("path", 256), 1, 32).alias("doc_id"), name.alias("source_filename"), extension(name).alias("extension"), F.when(code.isNull(), F.col("content")).alias("content"), code.alias("code"))


@F.pandas_udf(T.StringType())
def _cp1252(content: pd.Series) -> pd.Series:
    def decode(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else bytes(raw).decode("cp1252")
        except UnicodeDecodeError:
            return None

    return content.map(decode)


def decode_text(content: Column) -> Column:
    """UTF-8 with or without a byte-order mark, else Windows-1252; null where that has no such bytes either."""
    plain = F.when(F.substring(F.hex(content), 1, 6) == "EFBBBF", F.substring(content, 4, 2_147_483_647)).otherwise(content)
    return F.coalesce(F.try_validate_utf8(plain.cast("string")), _cp1252(content))


def extract_text_files(files: DataFrame) -> DataFrame:
    """Elements of the plain-text files."""
    texts = files.where((F.col("extension") == ".txt") & F.col("content").isNotNull()).select("doc_id", decode_text(F.col("content")).alias("text"))
    return extract_lines(texts)


_ITEM = "doc_id string, ord int, label string, text string, cells array<array<string>>, page_number int, code string"


def layout_items(files: DataFrame, convert: Callable[[bytes, str], Iterator[dict]]) -> DataFrame:
    """Items that a layout model finds in PDF and Word files; a file it cannot read gives one row with CORRUPT_DOCUMENT."""
    chosen = files.where(F.col("extension").isin(".pdf", ".docx") & F.col("content").isNotNull()).select("doc_id", "extension", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ITEM.split(", ")]
        for batch in batches:
            rows = []
            for doc, kind, content in zip(batch["doc_id"], batch["extension"], batch["content"]):
                try:
                    seen: set[int] = set()
                    for order, item in enumerate(convert(bytes(content), kind), 1):
                        if id(item) not in seen:
                            seen.add(id(item))
                            rows.append((doc, order, item.get("label", "text"), item.get("text") or "", item.get("cells"), item.get("page"), None))
                except Exception:
                    rows.append((doc, 0, None, None, None, None, "CORRUPT_DOCUMENT"))
            yield pd.DataFrame(rows, columns=names)

    return chosen.mapInPandas(run, _ITEM)


def layout_elements(items: DataFrame) -> DataFrame:
    """Layout items as elements: kinds by label, table cells from the model or from lines with bars."""
    kind = label_kind(F.col("label"))
    cells = F.when(kind == "table", F.coalesce("cells", table_rows(F.col("text"))))
    text = F.when(kind == "table", F.array_join(F.transform(cells, lambda r: F.array_join(r, " | ")), "\n")).otherwise(F.trim("text"))
    return items.where(F.col("code").isNull()).select("doc_id", kind.alias("element_type"), text.alias("text"), "ord", "page_number", cells.alias("table_rows")).where((F.length("text") > 0) | (F.col("element_type") == "table"))


def default_converter() -> Callable[[bytes, str], Iterator[dict]] | None:
    """A converter from an optional layout library, or None where none is installed."""
    if importlib.util.find_spec("docling") is None:
        return None

    def convert(content: bytes, kind: str) -> Iterator[dict]:
        import io

        from docling.datamodel.base_models import DocumentStream
        from docling.document_converter import DocumentConverter

        document = DocumentConverter().convert(DocumentStream(name=f"upload{kind}", stream=io.BytesIO(content))).document
        for entry in document.iterate_items():
            item = entry[0] if isinstance(entry, tuple) else entry
            where = getattr(item, "prov", None) or []
            out = {"label": str(getattr(item, "label", "text")), "text": getattr(item, "text", ""), "page": getattr(where[0], "page_no", None) if where else None}
            if "table" in out["label"].lower() and hasattr(item, "export_to_dataframe"):
                out["cells"] = [[str(v) for v in row] for row in item.export_to_dataframe().fillna("").values.tolist()]
            yield out

    return convert


def extract_files(files: DataFrame, converter: Callable[[bytes, str], Iterator[dict]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(elements, failures) of all files: text natively, PDF and Word through a converter where there is one."""
    columns = ["doc_id", "element_type", "text", "ord"]
    elements = extract_text_files(files).select(*columns, F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("array<array<string>>").alias("table_rows"))
    failures = files.where(F.col("code").isNotNull()).select("doc_id", "code")
    unread = files.where((F.col("extension") == ".txt") & F.col("content").isNotNull()).where(decode_text(F.col("content")).isNull())
    failures = failures.unionByName(unread.select("doc_id", F.lit("EXTRACTION_FAILED").alias("code")))
    converter = converter or default_converter()
    if converter is None:
        missing = files.where(F.col("extension").isin(".pdf", ".docx") & F.col("content").isNotNull()).select("doc_id", F.lit("EXTRACTOR_UNAVAILABLE").alias("code"))
        return elements, failures.unionByName(missing)
    items = layout_items(files, converter)
    return elements.unionByName(layout_elements(items)), failures.unionByName(items.where(F.col("code").isNotNull()).select("doc_id", "code"))


def drop_stale_uploads(folder: Path, max_age_hours: float = 24, now: float | None = None) -> int:
    """Removes the files directly in an upload folder that are older than the limit, and says how many; directories and finished packages stay."""
    limit = (time.time() if now is None else now) - max_age_hours * 3600
    stale = [p for p in folder.iterdir() if p.is_file() and p.stat().st_mtime < limit] if folder.exists() else []
    for p in stale:
        p.unlink(missing_ok=True)
    return len(stale)
