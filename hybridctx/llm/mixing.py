"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets: sources sorted by code point (null last) weigh 1, 2, 3, repeating; they share the size of the whole
corpus; no target exceeds cap x its source's size and the excess goes to the others by weight (water-filling,
solved in closed form over the source table).

Sampling: with rate r = target / source size, every document gets floor(r) certain whole copies. The rest of
the target is filled by order sampling with unequal inclusion probabilities whose expected words are that rest: with
p = r - floor(r), a document has p_i = p + min(p, 1 - p) / 2 * (m - x_i), where x_i = size / (size + mean size of the source)
and m is the mean of x over the source's words, so shorter documents are likelier and no p_i leaves (0, 1). Documents are
ranked by Pareto's ratio of random odds to inclusion odds, (u / (1 - u)) / (p_i / (1 - p_i)), and taken in this order while
the words fit; one that is larger than the words still missing is set aside and the ranking goes on behind it. `importance`
multiplies a document's inclusion odds. One closing document per source, the one whose size is nearest to the words still
missing, ends within its distance of the target. u comes from md5 of the id, so reruns agree.

Scale: no ranking gathers a source. Ranks are found by two levels: words are summed per (source, bucket of
the rank), with sqrt(rows) buckets, running sums go over the bucket table, and single documents are ordered only
inside the one bucket in which a source's target ends. The source table (one row per source) is the only thing
one task sees whole.

Defined results: null text: size 0; size-0 documents take 0; null source: a source of its own, last; an empty
table gives an empty result; repeated ids draw the same u and are ordered by size; a null id draws as the text
'null'; extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridctx.llm.common import WORD_PATTERN, private, row_key, stored, unit_draw, unit_draw_sql, word_count

SALT = "mix:"


def source_targets(sources: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) -> (source, source_size, target). One row per source, so global windows are bounded."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.select("source", "source_size", w.alias("w"))
    # sources reach their cap in the order of cap / weight; before the k-th, the level is (total - capped) / weight left
    by_level = Window.orderBy((F.col("source_size") * cap / F.col("w")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    s = s.select("*", (F.sum("source_size").over(whole) - cap * (F.sum("source_size").over(by_level)
                 - F.col("source_size"))).cast("double").alias("left_words"),
                 (F.sum("w").over(whole) - F.sum("w").over(by_level) + F.col("w")).alias("left_w"))
    s = s.select("*", (F.col("left_words") * F.col("w") / F.col("left_w") >= cap * F.col("source_size")).alias("full"))
    # the free sources all share the level found at the first free one
    s = s.select("*", F.first(F.when(~F.col("full"), F.struct("left_words", "left_w")), ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lvl"))
    return s.select("source", "source_size", F.when(F.col("full"), F.lit(cap) * F.col("source_size")).otherwise(
        F.col("lvl.left_words") * F.col("w") / F.col("lvl.left_w")).cast("double").alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                importance: str | None = None, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3),
                carry: str | None = None) -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, copies, taken (= size x copies), and the
    column `carry` if one is named."""
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col)).alias("size"),
                       unit_draw(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), SALT).alias("u"),
                       *([F.coalesce(F.col(importance).cast("double"), F.lit(1.0)).alias("imp")] if importance else []),
                       *([F.col(carry).alias("carried")] if carry else []))
    base = stored(base.withColumn("rid", F.monotonically_increasing_id()), "mix-base")
    t = _source_plan(base, cap, weights)
    return _sample(base, t, importance is not None).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"), *([F.col("carried").alias(carry)] if carry else []))


def _source_plan(base: DataFrame, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Per source (t_source): size, target, whole copies, fractional p, words left to sample, rank buckets."""
    sums = stored(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")),
                  "mix-sources")
    mean = sums.select(F.col("source").alias("m_source"), "source_size", (F.col("source_size") / F.col("n")).alias("mean"))
    # the mean of x over words, in units of 2^-20: no order of summation shows
    tilt = base.join(mean, _of_source("source", "m_source")).groupBy(F.col("source").alias("x_source")).agg(
        (F.floor(F.sum(F.col("size") * _short(F.col("size"), F.col("mean"))) / F.greatest(F.first("source_size"), F.lit(1)) * 2 ** 20) / 2 ** 20).alias("m"))
    t = source_targets(sums, cap, weights).withColumnRenamed("source", "t_source") \
        .join(sums.select("source", "n"), F.col("t_source").eqNullSafe(F.col("source"))).drop("source") \
        .join(tilt, _of_source("t_source", "x_source")).drop("x_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.select("t_source", "source_size", "target", F.floor(rate).cast("long").alias("whole"),
                 (rate - F.floor(rate)).alias("p"), (F.col("source_size") / F.col("n")).alias("mean"),
                 F.coalesce("m", F.lit(0.0)).alias("m"), F.ceil(F.sqrt("n")).cast("long").alias("buckets"))
    return stored(t.withColumn("rest", F.when(F.col("p") > 0, F.col("target") - F.col("whole") * F.col("source_size"))
                               .otherwise(F.lit(0.0))), "mix-plan")


def _short(size: Column, mean: Column) -> Column:
    """Near 0 for documents far shorter than the mean, near 1 for far longer ones; 0 without words."""
    return F.when(size > 0, size / (size + mean)).otherwise(F.lit(0.0))


def _of_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _cut(d: DataFrame) -> DataFrame:
    """d (source, bucket, v, size, id, rid, rest, ...) with `chosen`: the first of a source while their words fit rest."""
    # level 1: the bucket in which the words left to sample end
    b = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    run = Window.partitionBy("source").orderBy("bucket")
    b = b.withColumn("after", F.sum("words").over(run)).where(F.col("after") > F.col("rest"))
    edge = stored(b.groupBy(F.col("source").alias("e_source")).agg(
        F.min(F.struct("bucket", (F.col("after") - F.col("words")).alias("before"))).alias("edge")), "mix-edge")
    d = d.join(edge, _of_source("source", "e_source"), "left").drop("e_source")
    below = F.col("edge").isNull() | (F.col("bucket") < F.col("edge.bucket"))
    # level 2: single documents are ordered inside that bucket only
    inside = Window.partitionBy("source").orderBy("v", "size", "id", "rid")
    ordered = d.where(F.col("bucket") == F.col("edge.bucket")) \
        .withColumn("chosen", F.col("edge.before") + F.sum("size").over(inside) <= F.col("rest"))
    rest = d.where(F.coalesce(F.col("bucket") != F.col("edge.bucket"), F.lit(True))).withColumn("chosen", below)
    return ordered.unionByName(rest).drop("edge")


def _refill(d: DataFrame, got: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(rid of further documents, words missing after them): what is larger than the words missing is set aside and the
    cut repeated on the rest, until nothing fits. The first of the rest always fits, so every round takes some."""
    left, more = d.where(~F.col("chosen") & (F.col("p") > 0) & (F.col("size") > 0)), None
    while True:
        pool = stored(left.join(got, _of_source("source", "g_source")).where(F.col("size") <= F.col("gap"))
                      .select("source", "bucket", "v", "size", "id", "rid", F.col("gap").alias("rest")), "mix-pool")
        if pool.isEmpty():
            return more, got
        pool = stored(_cut(pool), "mix-fit")
        picked, left = pool.where("chosen"), pool.where("not chosen")
        more = picked.select("rid") if more is None else more.unionByName(picked.select("rid"))
        words = picked.groupBy(F.col("source").alias("w_source")).agg(F.sum("size").alias("words"))
        got = stored(got.join(words, _of_source("g_source", "w_source"), "left").select(
            "g_source", (F.col("gap") - F.coalesce(F.col("words"), F.lit(0))).alias("gap")), "mix-gap")


def _sample(base: DataFrame, t: DataFrame, weighted: bool) -> DataFrame:
    # Pareto's ranking is x = odds(u) / odds(p_i); v = x / (1 + x) has the same order and lies between 0 and 1
    p_i = F.when(F.col("p") > 0, F.col("p") + F.least("p", F.lit(1.0) - F.col("p")) / 2
                 * (F.col("m") - _short(F.col("size"), F.col("mean"))))
    x = F.col("u") / (F.lit(1.0) - F.col("u")) / (p_i / (F.lit(1.0) - p_i))
    x = x / F.col("imp") if weighted else x
    v = F.when((F.col("imp") > 0) if weighted else F.lit(True), F.when(F.col("p") > 0, x / (F.lit(1.0) + x))
               .otherwise(F.col("u"))).otherwise(F.lit(1.0))
    d = base.join(t, _of_source("source", "t_source")).drop("t_source").withColumn("v", v)
    d = d.withColumn("bucket", F.least(F.floor(F.col("v") * F.col("buckets")), F.col("buckets") - 1))
    d = stored(_cut(d).withColumn("chosen", F.col("chosen") & (F.col("p") > 0)), "mix-chosen")
    got = stored(d.groupBy(F.col("source").alias("g_source")).agg(
        (F.first("rest") - F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(F.lit(0)))).alias("gap")), "mix-gap")
    more, got = _refill(d, got)
    if more is not None:
        d = d.join(more.select(F.col("rid").alias("m_rid")), F.col("rid") == F.col("m_rid"), "left") \
            .withColumn("chosen", F.col("chosen") | F.col("m_rid").isNotNull()).drop("m_rid")
    # the closing document: nearest in size to the words still missing
    away = F.abs(F.col("size") - F.col("gap"))
    close = d.where(~F.col("chosen") & (F.col("p") > 0) & (F.col("size") > 0)) \
        .join(got, _of_source("source", "g_source")).where(away < F.col("gap")) \
        .groupBy(F.col("source").alias("c_source")) \
        .agg(F.min(F.struct(away.alias("away"), "v", "id", "rid")).alias("c"))
    close = stored(close.select("c_source", F.col("c.rid").alias("c_rid")), "mix-close")
    d = d.join(close, _of_source("source", "c_source") & (F.col("rid") == F.col("c_rid")), "left")
    return d.withColumn("copies", F.col("whole") + (F.col("chosen") | F.col("c_rid").isNotNull()).cast("long"))


def keep_mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               **options) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as it is taken. Rows that are equal in every column
    share their copies, as evenly as whole copies can be."""
    row, total, rows, k, n, copy = private(docs, "row", "total", "rows", "k", "copies", "copy")
    keyed = docs.withColumn(row, row_key(docs))
    copies = mix_sources(keyed, id_col, text_col, source_col, carry=row, **options) \
        .groupBy(row).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows))
    # the join leaves equal rows side by side, so numbering them needs no further shuffle
    side = Window.partitionBy(row).orderBy(row)
    out = keyed.join(copies, row).withColumn(k, F.row_number().over(side))
    mine = F.floor(F.col(total) / F.col(rows)) + (F.col(k) <= F.col(total) % F.col(rows)).cast("int")
    return out.withColumn(n, mine).where(F.col(n) > 0) \
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long")))) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same in DuckDB (cap 3, weights 1, 2, 3): one walk over the documents of every source in the order of the ranking.
MIX_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::BIGINT AS size,
         {unit_draw_sql("doc_id::VARCHAR", SALT)} AS u
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE / count(*) AS mean FROM base GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM sums),
lv AS (SELECT *,
    (sum(source_size) OVER () - 3.0::DOUBLE * (sum(source_size) OVER o - source_size)::DOUBLE)::DOUBLE AS left_words,
    sum(w) OVER () - sum(w) OVER o + w AS left_w
  FROM w WINDOW o AS (ORDER BY source_size * 3.0::DOUBLE / w, encode(source) NULLS LAST)),
fu AS (SELECT *, left_words * w / left_w >= 3.0::DOUBLE * source_size AS is_full FROM lv),
lvl AS (SELECT left_words AS lw, left_w AS ww FROM fu WHERE NOT is_full
        ORDER BY source_size * 3.0::DOUBLE / w, encode(source) NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, mean,
        (CASE WHEN is_full THEN 3.0::DOUBLE * source_size ELSE (SELECT lw FROM lvl) * w / (SELECT ww FROM lvl) END)
        AS target FROM fu),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
p AS (SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS p,
        CASE WHEN rate - floor(rate) > 0 THEN target - floor(rate)::BIGINT * source_size ELSE 0 END AS rest FROM r),
b AS (SELECT base.*, source_size, target, whole, p, rest,
        CASE WHEN size > 0 THEN size::DOUBLE / (size::DOUBLE + mean) ELSE 0.0::DOUBLE END AS x
      FROM base JOIN p ON base.source IS NOT DISTINCT FROM p.source),
m AS (SELECT source AS ms, floor(sum(size * x) / any_value(source_size) * 1048576.0::DOUBLE) / 1048576.0::DOUBLE AS m
      FROM b GROUP BY source),
i AS (SELECT b.*, p + least(p, 1.0::DOUBLE - p) / 2 * (m - x) AS pi FROM b JOIN m ON source IS NOT DISTINCT FROM ms),
o AS (SELECT *, u / (1.0::DOUBLE - u) / (pi / (1.0::DOUBLE - pi)) AS ratio FROM i WHERE p > 0 AND size > 0),
d AS MATERIALIZED (SELECT *, ratio / (1.0::DOUBLE + ratio) AS v, row_number() OVER (PARTITION BY source ORDER BY
        ratio / (1.0::DOUBLE + ratio), size, doc_id) AS n FROM o),
walk AS (
  SELECT DISTINCT source, 0::BIGINT AS n, rest AS gap, NULL::BIGINT AS doc_id, false AS chosen FROM d
  UNION ALL
  SELECT d.source, d.n, CASE WHEN d.size <= gap THEN gap - d.size ELSE gap END, d.doc_id, d.size <= gap
  FROM walk JOIN d ON d.source IS NOT DISTINCT FROM walk.source AND d.n = walk.n + 1),
g AS (SELECT source AS gs, min(gap) AS gap FROM walk GROUP BY source),
c AS (SELECT d.source, arg_min(d.doc_id, {{'a': abs(d.size - g.gap), 'v': v, 'i': d.doc_id}}) AS close_id
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.gs JOIN walk ON walk.source IS NOT DISTINCT FROM d.source AND walk.n = d.n
      WHERE NOT walk.chosen AND abs(d.size - g.gap) < g.gap GROUP BY d.source),
taken AS (SELECT source AS ts, doc_id AS ti FROM walk WHERE chosen UNION ALL SELECT source, close_id FROM c)
SELECT b.doc_id, b.size, b.source_size, b.target, (b.size * (b.whole + CASE WHEN ti IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM b LEFT JOIN taken ON b.source IS NOT DISTINCT FROM ts AND b.doc_id = ti
"""
