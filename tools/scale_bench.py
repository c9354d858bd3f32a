"""Scaling check on the load generator: recall (5 queries) and the current digest over n generated rows,
all in ONE workspace (the hot-key case). Prints one JSON line per n.

usage: python tools/scale_bench.py 10000 100000 1000000
"""

from __future__ import annotations

import json
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from pyspark.sql import functions as F  # noqa: E402

from hybridctx import constants as K  # noqa: E402
from hybridctx.operators import digest as dg, recall as rc, vectors as vx  # noqa: E402
from hybridctx.session import build_session, reliable_checkpoint  # noqa: E402
from hybridctx.sources.io import generate_memories  # noqa: E402

QUERIES = ["Redis caching", "Postgres persistence", "Kafka messaging", "gRPC auth", "SQLite logging"]


def main():
    spark = build_session(master="local[8]", shuffle_partitions=16)
    now = K.FIXTURE_NOW_MS
    for n in [int(a) for a in sys.argv[1:]] or [10_000, 100_000]:
        t0 = time.time()
        mem = generate_memories(spark, n, "ws0", now, num_partitions=16)
        vecs = vx.hash_embed(mem, "memory_id", "content", 64)
        mem = reliable_checkpoint(vx.attach_embeddings(mem, vecs))
        t_ingest = time.time() - t0
        qs = spark.createDataFrame([(i, "ws0", q) for i, q in enumerate(QUERIES)],
                                   "qid long, workspace_id string, query_text string")
        qv = vx.hash_embed(qs.withColumnRenamed("qid", "memory_id"), "memory_id", "query_text", 64)
        qs = (qs.join(qv.withColumnRenamed("memory_id", "qid").withColumnRenamed("embedding", "query_vec"), "qid")
              .withColumn("k", F.lit(5)).withColumn("types", F.lit(None).cast("array<string>")))
        t0 = time.time()
        rc.recall(qs, mem, now).write.format("noop").mode("overwrite").save()
        t_recall = time.time() - t0
        ws = spark.createDataFrame([("ws0", "ws0")], "id string, name string")
        repos = spark.createDataFrame([], "workspace_id string, branch string, uncommitted int")
        commits = spark.createDataFrame([], "workspace_id string, sha string, author string, message string, "
                                            "committed_at long")
        t0 = time.time()
        dg.hydration_digest(mem, ws, repos, commits, now).write.format("noop").mode("overwrite").save()
        t_hyd = time.time() - t0
        print(json.dumps({"n": n, "ingest_with_embedding_s": round(t_ingest, 2), "recall_5_queries_s": round(t_recall, 2),
                          "hydration_s": round(t_hyd, 2)}), flush=True)


if __name__ == "__main__":
    main()
