"""Keyword and pattern banks: YAML on the driver, small typed frames on the cluster."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import cached_property
from importlib import resources
from pathlib import Path
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidegate.errors import ResourceError
from tidegate.functions.keywords import keyword_regex
from tidegate.functions.patterns import JvmPattern, to_jvm
from tidegate.model import KEYWORD_ROW, PATTERN_ROW


def packaged(name: str) -> Any:
    """A file shipped in ``tidegate/resources``, also where the package is in an archive."""
    return resources.files("tidegate").joinpath("resources", *name.split("/"))


def load_yaml(path: Any) -> Any:
    """A YAML document from a path or a packaged file."""
    try:
        source = path if hasattr(path, "read_text") else Path(path)
        return yaml.safe_load(source.read_text(encoding="utf-8"))
    except (OSError, KeyError, UnicodeDecodeError, yaml.YAMLError) as exc:
        raise ResourceError(str(path), exc) from exc


def word_count(folded: str) -> int:
    return len(re.findall("[0-9a-z_]+", folded))


@dataclass(frozen=True)
class Keyword:
    category: str
    level: int | None
    keyword: str

    @property
    def folded(self) -> str:
        return self.keyword.lower()


@dataclass(frozen=True)
class KeywordBank:
    """Entries whose lower-case forms coincide collapse into one; the later spelling stays."""

    name: str
    entries: tuple[Keyword, ...]

    @classmethod
    def of(cls, name: str, entries: Iterable[Keyword]) -> KeywordBank:
        kept: dict[str, Keyword] = {}
        for entry in entries:
            if entry.keyword:
                kept[entry.folded] = entry
        return cls(name, tuple(kept.values()))

    @classmethod
    def from_mapping(cls, name: str, document: Mapping[str, Any]) -> KeywordBank:
        """``{categories: {category: {cssrs_level?, keywords: [...]}}}``; absent keys mean empty."""
        try:
            return cls.of(
                name,
                [
                    Keyword(str(category), body.get("cssrs_level"), _text(keyword))
                    for category, body in document.get("categories", {}).items()
                    for keyword in body.get("keywords", [])
                ],
            )
        except (AttributeError, TypeError) as exc:
            raise ResourceError(f"keyword bank {name}", exc) from exc

    @classmethod
    def from_yaml(cls, name: str, path: str) -> KeywordBank:
        return cls.from_mapping(name, load_yaml(path))

    def __len__(self) -> int:
        return len(self.entries)

    @cached_property
    def regex(self) -> str | None:
        return keyword_regex([entry.folded for entry in self.entries])

    @property
    def spelling(self) -> dict[str, str]:
        return {entry.folded: entry.keyword for entry in self.entries}

    def frame(self, spark: SparkSession) -> DataFrame:
        return keyword_frame(spark, self)


def keyword_frame(spark: SparkSession, *banks: KeywordBank) -> DataFrame:
    """Bank rows as one local relation, whose size the planner knows."""
    rows = [
        (bank.name, e.category, e.level, e.keyword, e.folded, word_count(e.folded))
        for bank in banks
        for e in bank.entries
    ]
    return _local_frame(spark, rows, KEYWORD_ROW)


def _local_frame(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    columns = list(zip(*rows)) or [()] * len(schema)
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(column, field.type) for column, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow))


def _text(value: Any) -> str:
    if not isinstance(value, str):
        raise TypeError(f"keyword {value!r} is not a string")
    return value


@dataclass(frozen=True)
class Pattern:
    id: str
    description: str
    pattern: str
    jvm: JvmPattern


@dataclass(frozen=True)
class PatternBank:
    """Ordered: the first matching pattern names the verdict."""

    patterns: tuple[Pattern, ...]

    @classmethod
    def from_mapping(cls, document: Mapping[str, Any]) -> PatternBank:
        try:
            return cls(
                tuple(
                    Pattern(
                        entry["id"],
                        entry.get("description", ""),
                        entry["pattern"],
                        to_jvm(entry["id"], entry["pattern"]),
                    )
                    for entry in document.get("patterns", [])
                )
            )
        except (AttributeError, KeyError, TypeError) as exc:
            raise ResourceError("pattern bank", exc) from exc

    @classmethod
    def from_yaml(cls, path: str) -> PatternBank:
        return cls.from_mapping(load_yaml(path))

    def __len__(self) -> int:
        return len(self.patterns)

    def verify(self, spark: SparkSession) -> PatternBank:
        """Let the JVM compile every pattern on one empty row before any real job starts."""
        tests = [F.lit("").rlike(item.jvm.regex).alias(f"p{i}") for i, item in enumerate(self.patterns)]
        if not tests:
            return self
        try:
            spark.range(1).select(*tests).collect()
        except Exception as exc:
            for item, test in zip(self.patterns, tests, strict=True):
                try:
                    spark.range(1).select(test).collect()
                except Exception as own:
                    raise ResourceError(f"pattern {item.id}", own) from own
            raise ResourceError("pattern bank", exc) from exc
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, p.id, p.description, p.pattern) for i, p in enumerate(self.patterns)]
        return _local_frame(spark, rows, PATTERN_ROW)


@dataclass(frozen=True)
class Banks:
    """The three resources of the rule stage."""

    crisis: KeywordBank
    malign: KeywordBank
    patterns: PatternBank

    @classmethod
    def load(
        cls, crisis: str | None = None, malign: str | None = None, patterns: str | None = None
    ) -> Banks:
        return cls(
            KeywordBank.from_yaml("crisis", crisis or packaged("keywords_crisis.yaml")),
            KeywordBank.from_yaml("malign", malign or packaged("keywords_malign.yaml")),
            PatternBank.from_yaml(patterns or packaged("bypass_patterns.yaml")),
        )

    @cached_property
    def any_keyword_regex(self) -> str | None:
        """One pass over a clean text answers for both keyword banks."""
        entries = (*self.crisis.entries, *self.malign.entries)
        return keyword_regex([entry.folded for entry in entries])

    def keyword_frame(self, spark: SparkSession) -> DataFrame:
        return keyword_frame(spark, self.crisis, self.malign)

    def __repr__(self) -> str:
        sizes = len(self.crisis), len(self.malign), len(self.patterns)
        return "Banks(crisis={}, malign={}, patterns={})".format(*sizes)
