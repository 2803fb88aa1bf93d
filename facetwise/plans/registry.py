"""Queries and their SQL, collected as the modules of queries are imported."""

from __future__ import annotations

import re
from collections.abc import Callable

#: The y of corner b is no column name in SQL.
_BY = re.compile(r"(?<!group )(?<!order )(?<!partition )\bby\b")

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with DuckDB SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _BY.sub("b_y", sql) if "soup" in sql else sql
        return f

    return add


def rounded(df, *exact: str, digits: int = 6):
    """Doubles rounded: sums depend on their order in the last places."""
    from pyspark.sql import functions as F

    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in exact else c for c, t in df.dtypes))
