import random
import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from hybridctx.llm import merkle as M
from tables import CLASHING, awkward


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(digests):
    """All levels, the digests first, the single top last."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def proof(levels, at):
    out = []
    for nodes in levels[:-1]:
        a = at - at % 3
        out.append(("".join(nodes[a:at]), "".join(nodes[at + 1:a + 3])))
        at //= 3
    return out


def plain(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> what audit() returns."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = tree([leaf(*r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, r in enumerate(groups[s]):
            steps = proof(trees[s], at) + proof(top, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            d = leaf(*r[:4], text)
            for left, right in steps:
                d = h(left, d, right)
            out.append((r[0], leaf(*r), trees[s][-1][0], top[-1][0], h(*[x for st in steps for x in st]), d, d == top[-1][0]))
    return sorted(out, key=str)


def docs(spark, rows):
    clash = [*CLASHING, "idx", "tree", "block", "digest", "lefts", "leaf", "root", "grp", "carried", "part", "at"]
    clash = list(dict.fromkeys(clash))
    return spark.createDataFrame([(*r, *["?"] * len(clash)) for r in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, "
                                 + ", ".join(f"`{c}` string" for c in clash))


def full(rows):
    r = random.Random(3)
    return [(i, s, r.choice(["en", None, "fr"]), r.choice([None, 5, 70]), t) for i, t, s in rows]


def check(spark, rows, height=M.HEIGHT):
    got = sorted(map(tuple, M.audit(docs(spark, rows).repartition(4), height).collect()), key=str)
    assert got == plain(rows)
    return got


def test_audit_against_brute_force(spark):
    rows = full(awkward() + [(100 + i, f"a{i}\nb" if i % 3 else f"a{i}", "s0" if i < 60 else f"s{i % 9}") for i in range(150)]
                + [(7, "other", "c"), (7, "other", "c"), (200, "\n", "c")])
    got = check(spark, rows)
    assert {r[6] for r in got} == {True, False}
    check(spark, rows, height=2)  # several rounds of blocks in both trees


def test_few_rows(spark):
    assert check(spark, []) == []
    one = check(spark, full([(1, "a\nb", None)]))
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == h()
    check(spark, full([(i, "x\ny", f"s{i}") for i in range(5)]))  # a lone leaf in every source
    for n in (2, 3, 4, 10):
        check(spark, full([(i, "x", "s") for i in range(n)]))


def test_sweeps_keep_small_queues_and_prove_every_leaf():
    for n in (1, 2, 3, 4, 9, 10, 28, 100):
        digests = [h(str(i)) for i in range(n)]
        levels = tree(digests)
        top, inner = M._sweep(digests, 0, n, M.levels(n))
        assert top == levels[-1][0] and len(inner) == sum(map(len, levels[1:]))
        assert [x[0][:2] for x in inner] == sorted(x[0][:2] for x in inner)
        for at, (left, right) in enumerate(M._proofs(digests, 0, n, M.levels(n), ([], []))):
            assert list(zip(left, right)) == proof(levels, at)


def test_any_change_is_found(spark):
    rows = full([(i, f"text {i}", f"s{i % 4}") for i in range(40)])
    m = M.manifest(docs(spark, rows), M.leaf_digest(*[F.col(c) for c in M.FIELDS]), {"doc_id": F.col("doc_id")})
    for change, ok in ((F.col("leaf"), True), (M.digest(F.col("leaf")), False), (F.reverse("leaf"), False)):
        got = m.select((M.fold(change, F.col("lefts"), F.col("rights")) == F.col("root")).alias("x")).collect()
        assert len(got) == 40 and all(r.x == ok for r in got)
