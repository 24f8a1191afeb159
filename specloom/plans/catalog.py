"""The registered queries of the library proper and their SQL."""

from __future__ import annotations

from . import graphs, texts, upkeep

MODULES = [upkeep, graphs, texts]


def flagship(spark, sf_dir):
    return graphs.hybrid_search(spark, sf_dir)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
