"""A fluent query builder over tables: each call adds a clause, `frame` gives the DataFrame that Spark plans."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Quoted text, a place for a value, or anything between.
_PIECES = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|\?|[^?'"`]+|['"`]""", re.S)


class Query:
    """Clauses apply in SQL's order, whatever the order of calls: from, joins, where, group, having, select, order, offset, limit.

    Conditions are SQL text with `?` for values, which are bound as literals and never spliced into the text.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables
        self._from: str | None = None
        self._columns: list[str | Column] = ["*"]
        self._joins: list[tuple[str, str, str]] = []
        self._where: list[Column] = []
        self._group: list[str] = []
        self._aggregates: list[Column] = []
        self._having: list[Column] = []
        self._order: list[Column] = []
        self._limit: int | None = None
        self._offset = 0

    @staticmethod
    def bind(condition: str, *values: Any) -> Column:
        """The condition with its places filled; a ? inside quotes is text and no place."""
        parts = [""]
        for piece in _PIECES.findall(condition):
            if piece == "?":
                parts.append("")
            else:
                parts[-1] += piece
        if len(parts) - 1 != len(values):
            raise ValueError(f"{len(parts) - 1} places, {len(values)} values")
        text = parts[0]
        for value, rest in zip(values, parts[1:], strict=True):
            text += Query._literal(value) + rest
        return F.expr(text)

    @staticmethod
    def _literal(value: Any) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).upper()
        if isinstance(value, float) and not math.isfinite(value):
            return f"double('{value}')"
        if isinstance(value, (int, float)):
            return repr(value)
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    def select(self, *columns: str | Column) -> Query:
        self._columns = list(columns) or ["*"]
        return self

    def from_table(self, name: str) -> Query:
        self._from = name
        return self

    def where(self, condition: str, *values: Any) -> Query:
        self._where.append(self.bind(condition, *values))
        return self

    def where_eq(self, column: str, value: Any) -> Query:
        self._where.append(F.col(column) == F.lit(value))
        return self

    def where_in(self, column: str, values: list) -> Query:
        self._where.append(F.col(column).isin(list(values)))
        return self

    def where_between(self, column: str, start: Any, end: Any) -> Query:
        self._where.append(F.col(column).between(start, end))
        return self

    def where_like(self, column: str, pattern: str) -> Query:
        """Case does not count."""
        self._where.append(F.col(column).ilike(pattern))
        return self

    def join(self, table: str, condition: str, how: str = "inner") -> Query:
        self._joins.append((table, condition, how))
        return self

    def inner_join(self, table: str, condition: str) -> Query:
        return self.join(table, condition, "inner")

    def left_join(self, table: str, condition: str) -> Query:
        return self.join(table, condition, "left")

    def right_join(self, table: str, condition: str) -> Query:
        return self.join(table, condition, "right")

    def semi_join(self, table: str, condition: str) -> Query:
        return self.join(table, condition, "left_semi")

    def anti_join(self, table: str, condition: str) -> Query:
        return self.join(table, condition, "left_anti")

    def full_join(self, table: str, condition: str) -> Query:
        return self.join(table, condition, "full")

    def group_by(self, *keys: str) -> Query:
        self._group += keys
        return self

    def aggregate(self, *columns: Column) -> Query:
        self._aggregates += columns
        return self

    def having(self, condition: str, *values: Any) -> Query:
        self._having.append(self.bind(condition, *values))
        return self

    def order_by_asc(self, column: str) -> Query:
        """Nulls come first."""
        self._order.append(F.asc_nulls_first(column))
        return self

    def order_by_desc(self, column: str) -> Query:
        """Nulls come last."""
        self._order.append(F.desc_nulls_last(column))
        return self

    def limit(self, count: int) -> Query:
        self._limit = count
        return self

    def offset(self, count: int) -> Query:
        self._offset = count
        return self

    def frame(self) -> DataFrame:
        if self._from is None:
            raise ValueError("from_table is missing")
        rows = self.tables[self._from].alias(self._from)
        for table, condition, how in self._joins:
            rows = rows.join(self.tables[table].alias(table), F.expr(condition), how)
        for condition in self._where:
            rows = rows.where(condition)
        if self._group or self._aggregates:
            rows = rows.groupBy(*self._group).agg(*self._aggregates) if self._aggregates else rows.select(*self._group).distinct()
        for condition in self._having:
            rows = rows.where(condition)
        if self._columns != ["*"]:
            rows = rows.select(*[F.expr(c) if isinstance(c, str) and c != "*" else c for c in self._columns])
        if self._order:
            rows = rows.orderBy(*self._order)
        if self._offset:
            rows = rows.offset(self._offset)
        return rows if self._limit is None else rows.limit(self._limit)


def insert(table: DataFrame, **values: Any) -> DataFrame:
    """The table with one more row; columns that are not named are null."""
    row = table.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in table.schema])
    return table.unionByName(row)


def update(table: DataFrame, condition: Column, **values: Any) -> DataFrame:
    """The table with values set where the condition holds."""
    return table.withColumns({k: F.when(condition, F.lit(v).cast(table.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()})


def delete(table: DataFrame, condition: Column) -> DataFrame:
    """The table without rows where the condition is true; rows where it is null stay."""
    return table.where(~F.coalesce(condition, F.lit(False)))
