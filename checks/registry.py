"""Name -> query and name -> SQL."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def pct(num: str, den: str) -> str:
    """SQL: percentage with one decimal, rounded half up on whole numbers."""
    return f"CAST((2000 * CAST({num} AS BIGINT) + {den}) // (2 * NULLIF({den}, 0)) AS DOUBLE) / 10"


def rat(num: str, den: str) -> str:
    """SQL: quotient of two counts as double, null for x / 0."""
    return f"CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0)"
