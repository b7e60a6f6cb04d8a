"""Registered queries: name -> DataFrame builder, name -> equivalent SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from .corpus import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(corpus)`` under a name, with the SQL it must equal."""
    def register(build: Callable[[Corpus], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Corpus(prepare(spark), folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register
