"""Where queries and their check SQL are registered side by side."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def rounded(table: DataFrame, digits: int = 6, /, **special: int) -> DataFrame:
    """Round all double columns, so that summation order does not show; -0.0 becomes 0.0."""
    return table.select(
        *[
            (F.round(c, special.get(c, digits)) + F.lit(0.0)).alias(c) if kind == "double" else c
            for c, kind in table.dtypes
        ]
    )


def r(expression: str, digits: int = 6) -> str:
    """The same rounding in the check SQL."""
    return f"round({expression}, {digits}) + 0.0"
