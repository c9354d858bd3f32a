"""hybridctx: hybrid retrieval and context digests as Spark DataFrame plans.

Layout:
  functions/  Column expressions (no Python UDFs): tokenizers, similarity, scoring, formatting.
  sources/    Readers, generators, appenders and result serialisers.
  operators/  Table operators (DataFrame in, DataFrame out): store, vectors, fts, recall, digest, repos, text.
  plans/      Fixture views over the benchmark tables, the query catalog and the DuckDB oracle texts.
  streaming/  Structured Streaming wrappers around the batch operators.
"""

__version__ = "0.1.0"
