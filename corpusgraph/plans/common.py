"""Helpers shared by the registered query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (presentation only, for stable compares)."""
    return df.select([
        F.round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


class Registry:
    """Collects ``name -> (spark callable, oracle sql | None)``."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict = {}

    def add(self, name: str, sql: str | None = None):
        def deco(fn):
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return deco
