"""Shapes: filtered views of one table, as snapshot and as a log of its changes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.predicates import Expr, Row, UnsupportedPredicate, where
from tidewater.operators.numbering import numbered


@dataclass(frozen=True)
class Shape:
    """``SELECT columns FROM table WHERE predicate``. ``text`` names the predicate in the
    handle; ``predicate`` takes a Row and gives an expression."""

    table: str
    key: tuple[str, ...]
    predicate: Callable[[Row], Expr] | None = None
    columns: tuple[str, ...] = ()
    text: str = ""
    replica: str = "default"
    tenant: str = "t"

    def check(self, df: DataFrame) -> None:
        unknown = [c for c in (*self.columns, *self.key) if c not in df.columns]
        if unknown:
            raise UnsupportedPredicate(f"unknown columns {unknown}")
        if self.columns and not set(self.key) <= set(self.columns):
            raise UnsupportedPredicate("the columns must hold the key")
        if self.replica not in ("default", "full"):
            raise UnsupportedPredicate(f"replica {self.replica}")

    def selected(self, df: DataFrame) -> DataFrame:
        """The matching rows, filtered before columns are chosen."""
        self.check(df)
        rows = where(df, self.predicate)
        return rows.select(*self.columns) if self.columns else rows

    def snapshot(self, df: DataFrame) -> DataFrame:
        """The rows with their message key and offset (0, 0..n-1) in key order. The sorted
        rows are written when this is called (see ``numbering``)."""
        rows = numbered(self.selected(df), *self.key, name="op_offset")
        return rows.withColumns({"message_key": message_key(*self.key), "lsn": F.lit(0).cast("long")})

    def canonical(self) -> str:
        """The text that tells shapes apart; ``canonical_text`` is the same over a table."""
        return "\n".join([self.tenant, self.table, ",".join(self.columns), self.text, self.replica])

    def handle(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()[:32]


def message_key(*key: str) -> Column:
    return F.concat_ws(",", *[F.col(c).cast("string") for c in key])


def canonical_text(tenant: Column, table: Column, columns: Column, text: Column, replica: Column) -> Column:
    """The canonical text of shape definitions in a table (columns: an array of names)."""
    return F.concat_ws("\n", tenant, table, F.array_join(columns, ","), text, replica)


def handle(canonical: Column) -> Column:
    """The first 16 bytes of the canonical text's SHA-256."""
    return F.substring(F.sha2(canonical, 256), 1, 32)


def cache_control(live: bool, settled: bool, max_age: int = 60) -> str:
    """How long an answer may be kept: live ones hardly, settled ones long."""
    return "public, max-age=5" if live else f"public, max-age={604800 if settled else max_age}"
