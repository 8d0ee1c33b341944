"""Queries of this subpackage on the driver's tables and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import queries, sql
from tidewell.session import small_batches



def _on_texts(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, *rest: object) -> DataFrame:
        small_batches(spark)
        return f(spark, *rest)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _on_texts(f) for name, f in vars(queries).items() if name.startswith("op") and callable(f)
}
ORACLES: dict[str, str] = {name: text for name, text in sql.ORACLES.items() if name in QUERIES}
