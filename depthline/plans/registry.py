"""The registered queries: a Spark function and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def r(expression: str, places: int = 4) -> str:
    """SQL text of `functions.columns.rounded`."""
    unit = "1" + "0" * places
    return f"floor(({expression})*{unit}.0+0.5+0.00001)/{unit}.0"
