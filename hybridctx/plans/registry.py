"""Catalog of runnable queries: name -> (Spark builder over (spark, sf_dir), DuckDB oracle text or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        CATALOG[name] = Entry(name, fn, sql)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # importing the modules fills CATALOG
    from hybridctx.plans import (catalog_digest, catalog_ids, catalog_search, catalog_store,  # noqa: F401
                                 catalog_streams, catalog_text, catalog_vectors)
    return CATALOG
