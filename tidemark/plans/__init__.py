"""Table patterns, streams and the capture plan, compiled to predicates."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError


@dataclass(frozen=True, order=True)
class Pattern:
    """`*`, `schema.*` or `schema.table`; None stands for any."""

    schema: str | None
    table: str | None

    def matches(self, schema: str, table: str) -> bool:
        return self.schema in (None, schema) and self.table in (None, table)

    def column(self, schema: Column, table: Column) -> Column:
        tests = [c == v for c, v in ((schema, self.schema), (table, self.table)) if v is not None]
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def parse_pattern(text: str) -> Pattern | None:
    if text == "*":
        return Pattern(None, None)
    schema, dot, table = text.partition(".")
    if not dot or not schema or not table or "." in table or any(x != x.strip() for x in (text, schema, table)):
        return None
    return Pattern(schema, None if table == "*" else table)


@dataclass(frozen=True)
class Stream:
    name: str
    source: str
    tables: tuple[str, ...]

    def patterns(self) -> list[Pattern]:
        """Texts that are no pattern match nothing here; a capture plan refuses them."""
        return [p for t in self.tables if (p := parse_pattern(t))]

    def column(self, schema: Column | None = None, table: Column | None = None) -> Column:
        return any_of(self.patterns(), schema, table)


def any_of(patterns: Iterable[Pattern], schema: Column | None = None, table: Column | None = None) -> Column:
    s, t = F.col("schema") if schema is None else schema, F.col("table") if table is None else table
    return reduce(lambda a, b: a | b, [p.column(s, t) for p in patterns], F.lit(False))


@dataclass(frozen=True)
class CapturePlan:
    source: str
    patterns: tuple[Pattern, ...] = field(default=())

    @classmethod
    def of(cls, source: str, streams: Iterable[Stream]) -> CapturePlan:
        streams, seen, found = list(streams), set(), set()
        if not streams:
            raise PlanError("no stream is configured")
        for s in streams:
            if not s.name.strip():
                raise PlanError("a stream has no name")
            if s.name in seen:
                raise PlanError(f"stream {s.name} is defined twice")
            seen.add(s.name)
            if s.source != source:
                raise PlanError(f"stream {s.name} names the unknown source {s.source}")
            if not s.tables:
                raise PlanError(f"stream {s.name} has no table")
            for t in s.tables:
                pattern = parse_pattern(t)
                if pattern is None:
                    raise PlanError(f"stream {s.name} has the invalid pattern {t!r}")
                found.add(pattern)
        return cls(source, tuple(sorted(found, key=lambda p: (p.schema or "", p.table or ""))))

    def matches(self, schema: str, table: str) -> bool:
        return any(p.matches(schema, table) for p in self.patterns)

    def column(self, schema: Column | None = None, table: Column | None = None) -> Column:
        return any_of(self.patterns, schema, table)

    def required_tables(self, tables: DataFrame) -> DataFrame:
        """(schema_name, table_name): tables named exactly, and those of the database that match."""
        exact = [(p.schema, p.table) for p in self.patterns if p.schema is not None and p.table is not None]
        named = tables.sparkSession.createDataFrame(exact, "schema_name string, table_name string")
        matching = tables.filter(self.column(F.col("schema_name"), F.col("table_name"))).select("schema_name", "table_name")
        return named.union(matching).distinct()
