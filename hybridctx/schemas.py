"""Fixed table schemas (no inference)."""

from pyspark.sql import types as T

MEMORY_SCHEMA = T.StructType([
    T.StructField("memory_id", T.StringType(), False),     # 26-char ULID
    T.StructField("workspace_id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("source", T.StringType(), True),
    T.StructField("tags", T.StringType(), True),
    T.StructField("importance", T.DoubleType(), False),
    T.StructField("created_at", T.LongType(), False),      # milliseconds
    T.StructField("archived_at", T.LongType(), True),      # milliseconds
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
])

COMMIT_SCHEMA = T.StructType([
    T.StructField("workspace_id", T.StringType(), False),
    T.StructField("sha", T.StringType(), False),
    T.StructField("author", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("committed_at", T.LongType(), False),    # seconds
])


def conform(df, schema: T.StructType):
    """Project and cast df to schema; columns missing from df become typed nulls."""
    from pyspark.sql import functions as F
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
