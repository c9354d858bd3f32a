"""Helpers shared by the operators: table access, private column names, shared-folder tables, stable hashes."""

from __future__ import annotations

import atexit
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridctx.session import ensure_checkpoint_dir

#: Words are maximal runs of anything but ASCII white space (RE2, Java and Python agree on this text).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made by this driver in the shared checkpoint folder, with the session that can delete them.
_made: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder; release() or the driver's end deletes it. The path names
    its file system, also where the setting leaves that to the cluster's default."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    _made.append((spark, path))
    return path


def release() -> None:
    """Delete the intermediate tables made so far. Call it when their results have been written."""
    while _made:
        spark, path = _made.pop()
        if spark.sparkContext._jsc is not None:  # a stopped session can't delete any more
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(release)


_collected = 0.0


def _collect(spark: SparkSession) -> None:
    """The shuffle files behind finished steps go when the driver collects its references; left alone that is after
    half an hour, and the steps of a long run would pile up on the executors' disks. At most every few seconds."""
    global _collected
    if time.monotonic() - _collected > 3:
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors,
    and later reads prune columns. Used where a result holds texts or is read several times."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    _collect(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame) -> Column:
    """128-bit key of a whole row, as two independent hashes; null and empty differ. Equal rows have equal keys."""
    cells = [F.col(f"`{c}`") for c in df.columns] + [F.col(f"`{c}`").isNull() for c in df.columns]
    return F.struct(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit("second"), *cells[::-1]).alias("b"))


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df lacks (letters of either case are the same)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def unit_draw(key: Column, salt: str = "") -> Column:
    """A number strictly between 0 and 1 from 52 bits of md5(salt + key); the same in every engine and rerun."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(salt), key).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2 ** 52))


def unit_draw_sql(key: str, salt: str = "") -> str:
    """unit_draw for DuckDB."""
    return f"((('0x' || substr(md5('{salt}' || {key}), 1, 13))::BIGINT)::DOUBLE + 0.5) / {float(2 ** 52)!r}"


#: Buckets of the id filter below: its broadcast has at most this many integers at any size of input.
ID_BUCKETS = 1 << 20


def split_by_ids(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among ids, rows whose key surely is not), without a shuffle of df.

    Both sides are told apart by a broadcast of the hash buckets that hold an id: ID_BUCKETS numbers at most. A
    hit is no proof (join the first part exactly); null keys go to the second part unless ids holds a null."""
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(ID_BUCKETS)).cast("int")
    b, = private(df, "bucket")
    hit = stored(ids.select(bucket(id_col).alias(b)).distinct(), "id-buckets")
    marked = df.withColumn(b, bucket(key))
    return (marked.join(F.broadcast(hit), b, "left_semi").drop(b),
            marked.join(F.broadcast(hit), b, "left_anti").drop(b))
