import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hybridctx.llm import packing, token_counts
from tables import awkward, documents, prose

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  a  b", "x<|endoftext|> y<|endof", "\n\n a\n b \t\tc", "'ll 's don't  can't", "1 22 333", "　 b \u0085 b",
       "a ", "\x1c x\x1c y", "é ́e", "İ I ıẞ ﬁ", "<|startoftext|>a<|endoftext|>", "a  b", "﻿x", "a\r\n b\x0b c"]


def library(path):
    return Tokenizer.from_file(path)


def test_counts_equal_the_library(spark):
    rows = awkward() + [(100 + i, t) for i, t in enumerate(ODD)] + [(200, prose(9, 20_000) + "  \n" + "q" * 70_000 + " z")]
    got = sorted(map(tuple, token_counts.token_counts(documents(spark, rows), BYTES).collect()), key=str)
    lib = library(BYTES)
    want = []
    for r in rows:
        n = len(lib.encode(r[1] or "", add_special_tokens=False))
        want.append((r[0], len((r[1] or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)


def test_overlap_resynchronisation_at_any_cut():
    lib, r = library(BYTES), random.Random(5)
    pieces = ["a", "b ", " ", "  ", "\n", "<|endoftext|>", "'ll", "é", "1", " x", "a" * 40, "日", " "]
    for _ in range(150):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(200)))
        want = len(lib.encode(text, add_special_tokens=False))
        for chunk, overlap in ((20, 3), (40, 8), (64, 20)):
            assert token_counts.count_huge(lib, text, chunk, overlap) == want, (text, chunk, overlap)


def check_packing(rows, ids_of, limit=4096):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for key, pieces in docs.items():
        want = ids_of[key]
        copies = len([p for p in pieces if p.start == 0])
        assert sum(p.length for p in pieces) == copies * len(want)
        for p in pieces:
            assert p.doc_tokens == len(want) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(want[p.start:p.start + p.length].astype("<u4").tobytes())
        if copies == 1:
            at = 0
            for p in sorted(pieces, key=lambda x: x.start):
                assert p.start == at
                at += p.length
    padding = 0
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda x: x.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit
        padding += (limit - at) if at & (at - 1) else 0
    return padding


def test_packing_round_trip(spark):
    rows = awkward() + [(100 + i, t) for i, t in enumerate(ODD)] + [(300 + i, prose(i, 50 * i)) for i in range(60)]
    lib = library(WORDS)
    ids = {r[0]: np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 2], np.uint32) for r in rows if r[0] is not None}
    rows = [r for r in rows if r[0] is not None]
    got = packing.pack(documents(spark, rows), packing.document_ids(WORDS, 2)).collect()
    assert {r.doc_id for r in got} == set(ids)
    assert check_packing(got, ids) == 0


def test_pack_empty_table_and_null_id(spark):
    assert packing.pack(documents(spark, []), packing.document_ids(WORDS, 2)).collect() == []
    got = packing.pack(documents(spark, [(None, None)]), packing.document_ids(WORDS, 2)).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens) for r in got] == [(None, 0, 1, 1)]


@pytest.mark.parametrize("seed", range(6))
def test_all_three_limits_hold(seed):
    r = np.random.default_rng(seed)
    out = []
    p = packing.Packer(0, lambda *x: out.append(x), max_tokens=64, max_segments=4, max_loss=20, pool=16)
    total = 0
    for k in range(200):
        ids = r.integers(0, 1000, r.integers(1, 150)).astype(np.uint32)
        total += len(ids)
        p.add(k, ids, r.random(len(ids)) < r.choice([0.05, 0.3, 0.9]))
    p.close()
    assert sum(x[2] for x in out) == total
    seqs = defaultdict(list)
    for x in out:
        seqs[x[5]].append(x)
    for pieces in seqs.values():
        assert sum(x[2] for x in pieces) <= 64 and len(pieces) <= 4 and sum(x[7] for x in pieces) <= 20
        assert sorted(x[6] for x in pieces)[0] == 0


@pytest.mark.parametrize("long_share", [0.0, 0.05, 0.2])
def test_very_short_documents_fill_their_sequences(spark, long_share):
    r = random.Random(int(100 * long_share))
    rows = [(i, prose(i, 300 if r.random() < long_share else 1 + i % 4)) for i in range(6000)]
    got = packing.pack(documents(spark, rows).coalesce(1), packing.document_ids(WORDS, 2)).collect()
    assert {x.doc_id for x in got} == set(range(6000))
    tokens, segments = defaultdict(int), defaultdict(int)
    for x in got:
        tokens[x.sequence_id] += x.length
        segments[x.sequence_id] += 1
    assert max(segments.values()) <= 512
    # all but the falling powers of two of the last rows (at most 12) are full in tokens or in segments
    assert sum(tokens[s] < 4096 and segments[s] < 512 for s in tokens) <= 12


def test_largest_dot_product_goes_first():
    out = []
    p = packing.Packer(0, lambda *x: out.append(x), max_tokens=10, max_segments=10, max_loss=10, pool=3)
    for key, n in ((1, 3), (2, 6), (3, 4)):
        p.add(key, np.zeros(n, np.uint32), None)
    # 6 tokens have the largest product, then 4 fill the sequence
    assert [(x[0], x[6]) for x in out] == [(2, 0), (3, 6)]


def test_limits_below_one_are_refused():
    import pytest
    for limits in ((0, 4, 4), (4, 0, 4), (4, 4, 0)):
        with pytest.raises(ValueError):
            packing.Packer(0, lambda *x: None, *limits, pool=4)


def test_one_long_run_is_encoded_a_few_times_only():
    import public_tokenizers
    from tokenizers import Tokenizer
    from hybridctx.llm import token_counts
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    class Counted:
        n = 0

        def encode(self, text, **options):
            Counted.n += len(text)
            return tok.encode(text, **options)

    work = []
    for size in (20_000, 80_000):
        Counted.n, text = 0, "x" * size
        assert token_counts.count_huge(Counted(), text, 2000, 64) == len(tok.encode(text, add_special_tokens=False).ids)
        work.append(Counted.n / size)
    assert work[1] < 2 * work[0] + 10
