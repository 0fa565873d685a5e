"""Query registry.

``@query(name, sql)`` registers a Spark job ``fn(spark, sf_dir) -> DataFrame``
and, when the job is expressible in SQL, an independent DuckDB query over the
driver's tables (adapter views are prepended by ``with_views``).  Jobs take
every time reference (``as_of``) explicitly so that both sides agree.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelwise.plans.sqlviews import with_views
from parcelwise.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def _prepare(spark: SparkSession) -> None:
    """Jobs are defined on a UTC clock; a caller's session gets that zone (runtime SQL conf)."""
    if spark.conf.get("spark.sql.session.timeZone", None) not in ("UTC", "Etc/UTC"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from parcelwise.plans import (agg_queries, batch_queries, listing_queries, more_queries,  # noqa: F401
                                  peer_queries, stream_queries, temporal_queries,
                                  window_queries)
