"""All registered queries of the retrieval engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.data import Tables

FLAGSHIP = "hybrid_retrieve"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its name, with its SQL."""

    def add(make: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return make(Tables(spark, folder))

        QUERIES[make.__name__] = run
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return add


from quarry.plans import graphs, ingest, retrieval, serving  # noqa: E402, F401  (they register)
