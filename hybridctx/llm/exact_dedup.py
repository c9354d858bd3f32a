"""Exact deduplication: rows grouped by a 128-bit content hash, bytes compared inside the groups.

One text shuffle: the texts are aggregated on (128-bit hash, SHA-256, text). Map-side combine sends every
distinct text once per task, so a group that holds a third of all rows is one row per task, and equality of
the text itself (bytes) decides, never the hash alone. What goes back to the documents is narrow: hashes,
the id that stays and the size; that join is on (hash, SHA-256), which adaptive execution can split.

Defined results: null texts count as empty (and are one group with empty texts); rows that repeat a doc_id
are rows of their own, so each is returned and counted; a null doc_id never stays while its group has another;
an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridctx.llm.common import private


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                normalise: Callable[[Column], Column] | None = None,
                content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    keep: 'min' (smallest stable id stays) or 'max'. normalise maps the text column before it is compared.
    content_hash is the grouping hash; a poor one costs speed, never correctness.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")) \
        .select("id", "t", content_hash(F.col("t")).alias("h"), F.sha2(F.col("t").cast("binary"), 256).alias("s"))
    pick = F.min if keep == "min" else F.max
    groups = rows.groupBy("h", "s", "t").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # two different texts under one (hash, SHA-256) could not be told apart by the narrow join: refuse, don't merge
    narrow = groups.groupBy("h", "s").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
        F.count(F.lit(1)).alias("n_texts")) \
        .select("h", "s", "keep_id", F.when(F.col("n_texts") == 1, F.col("group_size")).otherwise(
            F.raise_error(F.lit("different texts share a 128-bit hash and a SHA-256")).cast("long"))
            .alias("group_size"))
    return rows.select("id", "h", "s").join(narrow, ["h", "s"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("s").alias("text_sha256"))


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The input rows that stay, all columns; of rows that repeat the id and text that stays, one does."""
    sha, nth, stay_id, stay_sha = private(docs, "sha", "nth", "stay_id", "stay_sha")
    stays = exact_dedup(docs, id_col, text_col, keep).where("kept") \
        .select(F.col(id_col).alias(stay_id), F.col("text_sha256").alias(stay_sha)).distinct()
    out = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    # a group's copies have different ids, so no pair of id and text is hot but where rows repeat both
    out = out.join(stays, F.col(id_col).eqNullSafe(F.col(stay_id)) & (F.col(sha) == F.col(stay_sha)), "left_semi")
    side = Window.partitionBy(id_col, sha).orderBy(sha)
    return out.withColumn(nth, F.row_number().over(side)).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
