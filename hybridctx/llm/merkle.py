"""Merkle manifest of a dataset by time-forward processing.

Leaves are digests of rows, ascending by id within their source; every 3 consecutive nodes become one node, level by
level, until one is left per source (the subroot). The subroots, in the order of their sources, are the
leaves of a second tree of the same kind, whose last node is the root. A proof lists the siblings of a leaf's
ancestors, level by level; folding a leaf with its proof gives the root.

The tree is a graph whose nodes are labelled (last leaf below the node, level). Nodes are processed by ascending label; a
finished digest is a message to the parent's label, waiting in a priority queue ordered by label, so the queue of
the upward sweep never holds more than the open nodes of one path. The downward sweep takes labels
in reverse: a node's proof suffix is a message to its children. The queue is external: the sweeps run in blocks
of 3^height consecutive leaves (aligned, so a block is a subtree), one after the other in a task; between blocks messages
are rows that Spark partitions by block and sorts by label. A tree of n leaves takes ceil(log3(n) / height) such rounds.

Places of leaves are found without gathering a source: rows are range-partitioned and sorted by (source, id, digest), and
the number of rows before a partition comes from a table of one row per (source, partition).

Defined results: null fields are `-`; a null source is a source of its own, first; null ids come first in their source and are
never tampered with; repeated ids are leaves of their own, in the order of their digests; an empty
table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hybridctx.llm.common import stored

ARITY = 3
#: Levels of the tree that one task sweeps at a time.
HEIGHT = 7

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def levels(n: int) -> int:
    """How many times n nodes are put together before one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def ranked(rows: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """rows with `idx` (place in the group by `order`, from 0), `n` (rows of the group) and `tree` (place of the group).
    Nulls sort first. The global window runs over one row per (group, partition)."""
    keys = ([group] if group else []) + order
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", F.monotonically_increasing_id().alias("at"))
    placed = stored(placed.withColumn("part", F.shiftright("at", 33).cast("int")), "merkle-placed")
    g = F.col(group) if group else F.lit(0)
    parts = placed.groupBy(g.alias("g"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    before = Window.partitionBy("g").orderBy("p")
    whole = Window.partitionBy("g")
    parts = stored(parts.select("g", "p", "first", (F.sum("c").over(before) - F.col("c")).alias("before"),
                                F.sum("c").over(whole).alias("n")), "merkle-parts")
    if group:
        trees = parts.where("before = 0").select(F.col("g").alias("t"))
        trees = group_places(trees) if trees.limit(2).count() > 1 else trees.withColumn("tree", F.lit(0).cast("long"))
        parts = parts.join(trees, F.col("g").eqNullSafe(F.col("t"))).drop("t")
    else:
        parts = parts.withColumn("tree", F.lit(0).cast("long"))
    # a (group, partition) key holds no more rows than one range partition
    return placed.join(parts, g.eqNullSafe(F.col("g")) & (F.col("part") == F.col("p"))).select(
        *[F.col(c) for c in rows.columns], "tree", (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "n")


def group_places(names: DataFrame) -> DataFrame:
    """(t, tree): the place of each name, nulls first, by the same ranking."""
    return ranked(names, None, ["t"]).select("t", F.col("idx").alias("tree"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows with one (tree, block), whose size is bounded by the block."""
    key, held = None, []
    for b in batches:
        for row in b.to_pylist():
            now = (row["tree"], row["block"])
            if now != key and held:
                yield key, held
                held = []
            key = now
            held.append(row)
    if held:
        yield key, held


def _sweep(leaves: list[str], first: int, n: int, height: int) -> tuple[str, list[tuple[tuple, list[str]]]]:
    """Upward sweep over a block of consecutive nodes (places from `first`, of n in its tree): the digest of its top and
    (label, digests of the children) of the inner nodes in the order of labels."""
    queue: list[tuple[int, int, int, str]] = []
    inner: list[tuple[tuple, list[str]]] = []
    top = None

    def send(level: int, place: int, d: str) -> None:
        nonlocal top
        if level == height:
            top = d
            return
        up = place // ARITY
        last = min((up + 1) * ARITY ** (level + 1), n) - 1
        heapq.heappush(queue, (last, level + 1, place, d))

    for place, d in enumerate(leaves, first):
        send(0, place, d)
        while queue and queue[0][0] <= place:
            last, level, _, _ = queue[0]
            children = []
            while queue and queue[0][:2] == (last, level):
                _, _, child, c = heapq.heappop(queue)
                children.append(c)
            inner.append(((last, level, child // ARITY), children))
            send(level, child // ARITY, sha256("".join(children).encode()).hexdigest())
    return top, inner


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"idx div {ARITY ** height}L"))


def _by_label(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")


def lift(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, idx, n, digest) of the nodes up to `height` levels higher."""
    def run(batches):
        out = []
        for (tree, block), rows in _runs(batches):
            n = rows[0]["n"]
            h = min(height, levels(n))
            top, _ = _sweep([r["digest"] for r in rows], rows[0]["idx"], n, h)
            out.append((tree, block, -(-n // ARITY ** h), top))
            if len(out) >= 10_000:
                yield _records(out)
                out = []
        yield _records(out)

    def _records(out):
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[i], pa.int64()) for i in range(3)]
                                          + [pa.array(cols[3], pa.string())], names=["tree", "idx", "n", "digest"])

    return _by_label(_blocks(nodes.select("tree", "idx", "n", "digest"), height)).mapInArrow(
        run, "tree long, idx long, n long, digest string")


def lower(nodes: DataFrame, suffixes: DataFrame, carry: list[str], height: int = HEIGHT) -> DataFrame:
    """The columns `carry` of nodes with `lefts`, `rights` (siblings on either side, level by level up to the root of all
    trees, each level's concatenated) and `top`. suffixes: (tree, idx, lefts, rights, top) of the nodes that lift() made."""
    fields = [nodes.schema[c] for c in carry]
    payload = nodes.select("tree", "idx", "n", "digest", F.struct(*[f.name for f in fields]).alias("row"))
    messages = suffixes.select("tree", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), "lefts", "rights", "top")
    both = _blocks(payload, height).unionByName(messages, allowMissingColumns=True)
    columns = [f.name for f in fields]

    def run(batches):
        out = {c: [] for c in (*columns, "lefts", "rights", "top")}
        for _, rows in _runs(batches):
            message, own = rows[0], rows[1:]
            n, first = own[0]["n"], own[0]["idx"]
            for r, (left, right) in zip(own, _proofs([r["digest"] for r in own], first, n, min(height, levels(n)),
                                                     (message["lefts"], message["rights"]))):
                for c in columns:
                    out[c].append(r["row"][c])
                out["lefts"].append(left)
                out["rights"].append(right)
                out["top"].append(message["top"])
            if len(out["top"]) >= 2000:
                yield _records(out)
                out = {c: [] for c in out}
        yield _records(out)

    schema = T.StructType(fields + [T.StructField("lefts", T.ArrayType(T.StringType())),
                                    T.StructField("rights", T.ArrayType(T.StringType())), T.StructField("top", T.StringType())])
    arrow = to_arrow_schema(schema)

    def _records(out):
        return pa.RecordBatch.from_pydict(out, schema=arrow)

    return _by_label(both).mapInArrow(run, schema)


def _proofs(leaves: list[str], first: int, n: int, height: int, suffix: tuple[list, list]) -> list[tuple[list, list]]:
    """Downward sweep: the proof of every leaf of a block, given the suffix of its top."""
    _, inner = _sweep(leaves, first, n, height)
    out: list = [None] * len(leaves)
    # a message is the chain of (left, right) from a node to the top; nodes share what they have in common
    top = (height, first // ARITY ** height)
    queue: list[tuple[int, int, int, object]] = []

    def send(level: int, place: int, chain) -> None:
        if level == 0:
            out[place - first] = chain
        else:
            last = min((place + 1) * ARITY ** level, n) - 1
            heapq.heappush(queue, (-last, -level, place, chain))

    send(*top, None)
    for (last, level, place), children in reversed(inner):
        _, _, _, chain = heapq.heappop(queue)
        for i in range(len(children)):
            here = ("".join(children[:i]), "".join(children[i + 1:]), chain)
            send(level - 1, place * ARITY + i, here)
    proofs = []
    for chain in out:
        left, right = [], []
        while chain is not None:
            left.append(chain[0])
            right.append(chain[1])
            chain = chain[2]
        proofs.append((left + suffix[0], right + suffix[1]))
    return proofs


def _climb(leaves: DataFrame, name: str, height: int) -> list[DataFrame]:
    """The nodes after every round, the leaves first; in the last one every tree is a single node."""
    largest = leaves.agg(F.max("n")).first()[0]
    rounds = [leaves]
    for _ in range(max(1, -(-levels(largest) // height))):
        rounds.append(stored(lift(rounds[-1], height), name))
    return rounds


def manifest(docs: DataFrame, leaf: Column, carry: dict[str, Column], group_col: str = "source", id_col: str = "doc_id",
             height: int = HEIGHT) -> DataFrame:
    """One row per input row: the columns `carry`, `leaf`, its proof (`lefts`, `rights`: siblings per level up to the root),
    `subroot` of its group and `root` of all. `leaf` is the digest of a row."""
    base = stored(docs.select(F.col(group_col).alias("grp"), F.col(id_col).alias("key"), leaf.alias("digest"),
                              F.struct(*[c.alias(n) for n, c in carry.items()]).alias("carried")), "merkle-leaves")
    if base.isEmpty():
        return _shown(base.select("carried", "digest").withColumns({
            "lefts": F.lit(None).cast("array<string>"), "rights": F.lit(None).cast("array<string>"),
            "top": F.lit(None).cast("string")}), None, list(carry))
    leaves = stored(ranked(base, "grp", ["key", "digest"]).select("tree", "idx", "n", "digest", "carried"), "merkle-ranked")
    rounds = _climb(leaves, "merkle-level", height)
    # the subroots are the leaves of the second tree, in the order of their groups
    subroots = rounds[-1]
    n = subroots.count()
    crown = _climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"),
                                   F.lit(n).cast("long").alias("n"), "digest"), "merkle-crown", height)
    root = crown[-1].first()["digest"]
    none = F.array().cast("array<string>")
    suffix = crown[-1].select("tree", "idx", none.alias("lefts"), none.alias("rights"), F.lit(root).alias("top"))
    for nodes in crown[-2::-1]:
        suffix = stored(lower(nodes, suffix, ["tree", "idx", "digest"], height), "merkle-proof")
    # a subroot's proof is the end of every proof in its tree
    suffix = suffix.select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("idx"), "lefts", "rights",
                           F.col("digest").alias("top"))
    for nodes in rounds[-2:0:-1]:
        suffix = stored(lower(nodes, suffix, ["tree", "idx"], height), "merkle-proof")
    return _shown(lower(leaves, suffix, ["digest", "carried"], height), root, list(carry))


def _shown(rows: DataFrame, root: str | None, names: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"carried.{n}").alias(n) for n in names], F.col("digest").alias("leaf"), "lefts", "rights",
                       F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"))


def fold(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda d, s: digest(s["l"], d, s["r"]))


def proof_digest(lefts: Column, rights: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(F.arrays_zip(lefts.alias("l"), rights.alias("r")), lambda s: F.concat(s["l"], s["r"])), ""))


def tampered_leaf(changed: Callable[[Column], Column], when: Column, id_col: str = "doc_id") -> Column:
    """The digest of a row whose text was changed where `when` holds; null elsewhere (the leaf stands)."""
    values = [F.col(c) for c in (id_col, *FIELDS[1:])]
    return F.when(when, leaf_digest(*values[:-1], changed(values[-1])))


def audit(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of every row, and what folding gives after tampering: rows whose unsigned
    crc32 of the decimal id is even lose the line feeds of their text (`folded_root`, `verified`: it is the root)."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    hit = even & F.contains(F.col("text"), F.lit("\n"))
    rows = manifest(docs, leaf_digest(*[F.col(c) for c in FIELDS]), {
        "doc_id": F.col("doc_id"), "tampered": tampered_leaf(lambda t: F.regexp_replace(t, "\n", ""), hit)}, height=height)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("lefts"), F.col("rights"))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("lefts"), F.col("rights")).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: audit() in DuckDB. CRC-32 is taken bit by bit; nodes carry their level, place and digest.
MANIFEST_SQL = """
WITH RECURSIVE f AS (
  SELECT doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, flatten([[(ascii(c) >> i) & 1 FOR i IN range(8)]
                FOR c IN string_split(doc_id::VARCHAR, '')])::BIGINT[]),
        lambda c, b: xor(c >> 1, CASE WHEN (c & 1) <> b THEN 3988292384 ELSE 0 END)::BIGINT) AS reg
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN (xor(reg, 4294967295::BIGINT) & 1) = 0
         THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
         ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS tampered FROM f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
             count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
  SELECT source, 0 AS lvl, idx, n, leaf AS d FROM ranked
  UNION ALL
  SELECT source, lvl + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(d, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY source, lvl, idx // 3),
subroots AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS idx,
             count(*) OVER () AS n FROM nodes WHERE n = 1),
crown AS (
  SELECT 0 AS lvl, idx, n, subroot AS d FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(d, '' ORDER BY idx))
  FROM crown WHERE n > 1 GROUP BY lvl, idx // 3),
steps AS (
  SELECT r.doc_id, r.leaf, r.source, a.lvl,
    coalesce(string_agg(s.d, '' ORDER BY s.idx) FILTER (s.idx < a.idx), '') AS l,
    coalesce(string_agg(s.d, '' ORDER BY s.idx) FILTER (s.idx > a.idx), '') AS r
  FROM ranked r JOIN nodes a ON a.source IS NOT DISTINCT FROM r.source AND a.idx = r.idx // (3 ** a.lvl)::BIGINT AND a.n > 1
  JOIN nodes s ON s.source IS NOT DISTINCT FROM a.source AND s.lvl = a.lvl AND s.idx // 3 = a.idx // 3
  GROUP BY r.doc_id, r.leaf, r.source, r.idx, a.lvl, a.idx),
tops AS (
  SELECT u.source, a.lvl,
    coalesce(string_agg(s.d, '' ORDER BY s.idx) FILTER (s.idx < a.idx), '') AS l,
    coalesce(string_agg(s.d, '' ORDER BY s.idx) FILTER (s.idx > a.idx), '') AS r
  FROM subroots u JOIN crown a ON a.idx = u.idx // (3 ** a.lvl)::BIGINT AND a.n > 1
  JOIN crown s ON s.lvl = a.lvl AND s.idx // 3 = a.idx // 3
  GROUP BY u.source, u.idx, a.lvl, a.idx),
p AS (SELECT doc_id, leaf, list(l || '|' || r ORDER BY lvl) AS steps FROM steps GROUP BY doc_id, leaf),
t AS (SELECT source, list(l || '|' || r ORDER BY lvl) AS steps FROM tops GROUP BY source),
whole AS (
  SELECT x.doc_id, x.leaf, x.tampered, u.subroot, (SELECT d FROM crown WHERE n = 1) AS root,
    list_concat(coalesce(p.steps, []::VARCHAR[]), coalesce(t.steps, []::VARCHAR[])) AS steps
  FROM ranked x JOIN subroots u ON u.source IS NOT DISTINCT FROM x.source
  LEFT JOIN p ON p.doc_id IS NOT DISTINCT FROM x.doc_id AND p.leaf = x.leaf
  LEFT JOIN t ON t.source IS NOT DISTINCT FROM x.source),
folded AS (SELECT *, list_reduce(list_prepend(tampered, steps),
    lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root,
       folded_root = root AS verified FROM folded
"""
