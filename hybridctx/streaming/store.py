"""A store of memories whose rows, text index and statistics change together.

Every change is an epoch: folders below the store that one commit marker, written last, makes visible. Readers take
epochs with a marker alone, so a change that broke off between two tables shows none of its parts, and repeating it
overwrites them. An epoch holds what changed and nothing else:

  memories/epoch=E   the rows as given (the embedding among them)
  lists/epoch=E      their position lists (operators.fts.position_lists) in segments of whole blocks of rows, each a file sorted
                     by the hash of workspace and term
  blocks/epoch=E     bounds and numbers of the lists by block of rows (operators.fts.term_blocks), without the hash
  docs/epoch=E       (memory_id, workspace_id, dl, live) of the same rows
  ended/epoch=E      (memory_id, epoch): versions of rows that this change replaced or deleted, by the epoch they came in
  stats/epoch=E      (workspace_id, docs, tokens): signed sums, new rows less ended ones
  commits/E.KIND.BATCH

A row's version is its id and the epoch it came in; it is current unless `ended` names it. So a changed row costs its own
lists, wherever it was stored before and in whatever workspace. Corpus statistics are sums of the signed sums.
compact() writes all current versions as one epoch that readers start from; vacuum() deletes what lies before it.

One writer at a time; readers may run beside it. A batch name that has been committed is not applied again, so replayed
micro-batches are harmless.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridctx.operators.fts import (BLOCK_ROWS, TextIndex, packed_tokens, position_lists, row_blocks, term_blocks, term_key,
                                     with_blocks)
from hybridctx.session import collect_references, reliable_checkpoint

WS, KEY = "workspace_id", "memory_id"
#: Rows of one page of the lists' files: what a search for a rare term reads at least.
PAGE_ROWS = 4000


@dataclass(frozen=True)
class Commit:
    epoch: int
    kind: str  # 'change', or 'base' for an epoch that holds everything before it
    batch: str


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def commits(spark: SparkSession, store: str) -> list[Commit]:
    """All commits in order. Compaction keeps their number small."""
    fs, p = _path(spark, f"{store}/commits")
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted((Commit(int(n.split(".")[0]), *n.split(".")[1:]) for n in names), key=lambda c: c.epoch)


def _visible(done: list[Commit]) -> list[int]:
    """Epochs that readers take: the last base and what came behind it."""
    bases = [c.epoch for c in done if c.kind == "base"]
    return [c.epoch for c in done if not bases or c.epoch >= bases[-1]]


def _mark(spark: SparkSession, store: str, epoch: int, kind: str, batch: str) -> None:
    fs, p = _path(spark, f"{store}/commits/{epoch:012d}.{kind}.{batch}")
    fs.create(p, False).close()


def _read(spark: SparkSession, store: str, table: str, epochs: list[int]) -> DataFrame:
    """The rows of some epochs, with the epoch that a row came in."""
    out = None
    for e in epochs:
        part = spark.read.parquet(f"{store}/{table}/epoch={e}")
        if table != "ended":  # an ended version names the epoch it came in itself
            part = part.withColumn("epoch", F.lit(e).cast("long"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _current(spark: SparkSession, store: str, table: str, epochs: list[int]) -> DataFrame:
    return _read(spark, store, table, epochs).join(_read(spark, store, "ended", epochs), [KEY, "epoch"], "left_anti")


def _write(df: DataFrame, store: str, table: str, epoch: int) -> None:
    w = df.write.mode("overwrite")
    if table == "memories":  # one file of rows can be read by many tasks
        w = w.option("parquet.block.size", str(SEGMENT_BYTES))
    if table in ("lists", "blocks"):  # positions and terms are written as differences
        w = w.option("parquet.writer.version", "v2").option("compression", "zstd")
    if table == "lists":
        w = w.option("parquet.page.row.count.limit", str(PAGE_ROWS))
    w.parquet(f"{store}/{table}/epoch={epoch}")


#: Bytes of text in one segment, about: its lists are sorted by one task and are a file of the epoch.
SEGMENT_BYTES = 8 << 20

#: Segments of a change beyond which its shuffle files and packed rows are worth a collection of the driver's references.
COLLECT_SEGMENTS = 8


def _write_lists(lists: DataFrame, store: str, epoch: int) -> None:
    # the row id splits the range of a term that a hot workspace holds very often
    _write(lists.repartitionByRange("h", KEY).sortWithinPartitions("h", KEY), store, "lists", epoch)
    written = lists.sparkSession.read.parquet(f"{store}/lists/epoch={epoch}")
    _write_blocks(term_blocks(written).repartitionByRange("h"), store, epoch)


def _write_blocks(blocks: DataFrame, store: str, epoch: int) -> None:
    """The hash is made again when they are read: it would take half of their room."""
    _write(blocks.sortWithinPartitions("term").drop("h"), store, "blocks", epoch)


def _write_segments(t: DataFrame, store: str, epoch: int) -> None:
    """The lists and blocks of packed rows that lie in partitions of whole blocks, without another shuffle: every partition is a
    segment, its lists sorted by h in itself, that a search reads its terms' pages of."""
    _write(position_lists(t).sortWithinPartitions("h"), store, "lists", epoch)
    _write_blocks(row_blocks(t), store, epoch)


def _counts(spark: SparkSession, store: str, epoch: int) -> tuple[int, int, int]:
    """Of the rows of an epoch: their number, the bytes of their texts, the most rows of one id."""
    size = F.coalesce(F.octet_length("content"), F.lit(0)) + F.coalesce(F.octet_length("tags"), F.lit(0))
    ids = spark.read.parquet(f"{store}/memories/epoch={epoch}").groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    return tuple(ids.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.sum("size"), F.max("n")))).first())


def commit(spark: SparkSession, store: str, changed: DataFrame | None = None, deleted: DataFrame | None = None,
           batch: str | None = None) -> int:
    """Rows of `changed` (memories) come in or replace those of their ids, rows whose memory_id is in `deleted` go; both: they
    go. Of several rows of one id in `changed` the newest (created_at, if there is one) counts. Returns the epoch."""
    if batch is not None and not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError("a batch is named by letters, digits, _ and -")
    done = commits(spark, store)
    for c in done:
        if batch is not None and c.batch == batch:
            return c.epoch
    epoch = done[-1].epoch + 1 if done else 0
    epochs = _visible(done)
    if changed is None and not epochs:
        raise ValueError("nothing is stored yet")
    if epochs:  # the first epoch ends no version
        ids = [x.select(KEY) for x in (changed, deleted) if x is not None]
        ids = reliable_checkpoint((ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])).distinct())
    if changed is not None:
        new = changed if deleted is None else changed.join(deleted.select(KEY).distinct(), KEY, "left_anti")
    else:  # the tables of an epoch have the same columns, with or without rows
        new = _read(spark, store, "memories", epochs[-1:]).drop("epoch").where("false")
    columns = changed.columns if changed is not None else new.columns
    _write(new.select(*columns), store, "memories", epoch)
    rows, in_all, most = _counts(spark, store, epoch)
    if most > 1:  # only where an id came more than once are whole rows shuffled to find its newest
        newest = Window.partitionBy(KEY).orderBy(
            *([F.col("created_at").desc()] if "created_at" in columns else []), F.xxhash64(*columns))
        _write(new.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").select(*columns), store, "memories", epoch)
        rows, in_all, _ = _counts(spark, store, epoch)
    new = spark.read.parquet(f"{store}/memories/epoch={epoch}")
    segments = -(-in_all // SEGMENT_BYTES) or 1
    # also where all rows are of one length, a block of long ones stays within some segments' size
    block_rows = max(min(BLOCK_ROWS, rows * SEGMENT_BYTES // (4 * max(in_all, 1))), 1)
    t = with_blocks(packed_tokens(new.select(KEY, WS, "content", "tags", "archived_at")), rows, epoch, block_rows)
    t = reliable_checkpoint(t.repartition(segments, "block"))
    if segments > COLLECT_SEGMENTS:
        collect_references(spark)
    docs = t.select(KEY, WS, "dl", "live")
    _write_segments(t, store, epoch)
    _write(docs, store, "docs", epoch)
    sums = docs.select(WS, F.lit(1).alias("d"), F.col("dl").alias("n"))
    if epochs:
        old = reliable_checkpoint(_current(spark, store, "docs", epochs).join(ids, KEY, "left_semi"))
        sums = sums.unionByName(old.select(WS, F.lit(-1).alias("d"), (-F.col("dl")).alias("n")))
        ended = old.select(KEY, "epoch")
    else:
        ended = docs.select(KEY, F.lit(0).cast("long").alias("epoch")).where("false")
    _write(ended, store, "ended", epoch)
    _write(sums.groupBy(WS).agg(F.sum("d").alias("docs"), F.sum("n").alias("tokens")), store, "stats", epoch)
    _mark(spark, store, epoch, "change", batch or "direct")
    del t, docs, sums, ended  # nothing reads the packed rows any more
    if segments > COLLECT_SEGMENTS:
        collect_references(spark)
    return epoch


def read_rows(spark: SparkSession, store: str) -> DataFrame:
    """The current memories of all committed changes."""
    return _current(spark, store, "memories", _visible(commits(spark, store))).drop("epoch")


def read_stats(spark: SparkSession, store: str) -> DataFrame:
    """(workspace_id, n_docs, total_tokens, avgdl) from the signed sums; workspaces without rows are left out."""
    sums = _read(spark, store, "stats", _visible(commits(spark, store))).groupBy(WS).agg(
        F.sum("docs").alias("n_docs"), F.sum("tokens").alias("total_tokens"))
    return sums.where("n_docs > 0").withColumn("avgdl", F.col("total_tokens").cast("double") / F.col("n_docs"))


def open_store(spark: SparkSession, store: str) -> TextIndex:
    """The text index of all committed changes, as fts_topk and recall take it."""
    epochs = _visible(commits(spark, store))
    return TextIndex(_read(spark, store, "lists", epochs), read_stats(spark, store), _read(spark, store, "ended", epochs),
                     _read(spark, store, "blocks", epochs).drop("epoch").withColumn("h", term_key()))


def current_lists(spark: SparkSession, store: str) -> DataFrame:
    """The position lists of current rows."""
    return _current(spark, store, "lists", _visible(commits(spark, store))).drop("epoch")


def compact(spark: SparkSession, store: str) -> int:
    """Write all current versions as one epoch that readers start from. Returns it."""
    done = commits(spark, store)
    epochs, epoch = _visible(done), done[-1].epoch + 1
    for table in ("memories", "docs"):
        _write(_current(spark, store, table, epochs).drop("epoch"), store, table, epoch)
    _write_lists(_current(spark, store, "lists", epochs).drop("epoch"), store, epoch)
    _write(_read(spark, store, "ended", epochs).where("false"), store, "ended", epoch)
    _write(read_stats(spark, store).select(WS, F.col("n_docs").alias("docs"), F.col("total_tokens").alias("tokens")),
           store, "stats", epoch)
    _mark(spark, store, epoch, "base", "compact")
    return epoch


def vacuum(spark: SparkSession, store: str) -> None:
    """Delete the tables of epochs before the last base. Readers that opened the store before must be done. The markers
    stay: they tell which batches have been applied."""
    done = commits(spark, store)
    first = _visible(done)[0] if done else 0
    for c in done:
        if c.epoch < first:
            for table in ("memories", "lists", "blocks", "docs", "ended", "stats"):
                fs, p = _path(spark, f"{store}/{table}/epoch={c.epoch}")
                fs.delete(p, True)
