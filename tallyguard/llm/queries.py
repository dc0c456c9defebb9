"""The queries of this package, opN_<name>, and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyguard.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return register


from tallyguard.llm import (  # noqa: E402
    collocation_queries,  # noqa: F401
    context_tree_queries,  # noqa: F401
    decontaminate_queries,  # noqa: F401
    html_queries,  # noqa: F401
    imatch_queries,  # noqa: F401
    jaccard_queries,  # noqa: F401
    line_dedup_queries,  # noqa: F401
    minhash_queries,  # noqa: F401
    periodic_queries,  # noqa: F401
    sentencepiece_queries,  # noqa: F401
    toxicity_queries,  # noqa: F401
    url_queries,  # noqa: F401
    warc_queries,  # noqa: F401
)
