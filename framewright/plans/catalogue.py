"""The registered queries of the occupancy engine and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.plans import detection_queries, figure_queries, gate_queries, series_queries, stream_queries

MODULES = [series_queries, gate_queries, detection_queries, figure_queries, stream_queries]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_queries.rebin_hourly_effective(spark, sf_dir)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
