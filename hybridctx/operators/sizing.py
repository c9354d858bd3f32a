"""Broadcast only behind a measured size bound; otherwise leave the join to a shuffle (and AQE)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a query-side table (a query row holds a 64..3072-wide float vector and a short text, i.e. at most
# about 13 KB): 20,000 rows stay well under the 512 MB that is safe to ship to every executor.
DEFAULT_MAX_BROADCAST_ROWS = 20_000


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when df has at most max_rows rows. Reads at most max_rows + 1 rows' worth of counts."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df
