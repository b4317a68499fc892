"""The stages a caller may replace, as protocols over DataFrames, and a registry of converters by file type."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Generator(Protocol):
    """Elements of a document to records."""

    def __call__(self, spark: SparkSession, job_id: str, elements: DataFrame, prompt: str) -> DataFrame: ...


class Validator(Protocol):
    """Records and their sources to kept records and a report a job."""

    def __call__(self, records: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]: ...


class Exporter(Protocol):
    """Records to a file or folder of files."""

    def __call__(self, records: DataFrame, path: str) -> None: ...


class Packager(Protocol):
    """A dataset's file and its documents to one archive."""

    def __call__(self, dataset: Path, destination: Path, manifest_json: str, metadata_json: str, report_json: str | None = None, review_json: str | None = None) -> Path: ...


Converter = Callable[[bytes, str], Iterator[dict]]


@dataclass
class Converters:
    """Converters of uploaded files to layout items; the one registered last for a type is used."""

    by_type: dict[str, Converter] = field(default_factory=dict)

    def register(self, converter: Converter, *types: str) -> None:
        self.by_type |= {t.lower(): converter for t in types}

    def __call__(self, content: bytes, kind: str) -> Iterator[dict]:
        if kind.lower() not in self.by_type:
            raise ValueError(f"no converter for {kind}")
        return self.by_type[kind.lower()](content, kind)
