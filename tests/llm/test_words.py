import pyarrow as pa
import pytest

from hybridctx.llm import near_dup, substring_dedup, token_counts, words as W
from tables import documents, prose

#: Words that collide in any polynomial hash modulo 2^64: letters by the parity of the bits of the place.
MORSE = "".join("th"[bin(i).count("1") & 1] for i in range(2048))
MIRROR = "".join("ht"[bin(i).count("1") & 1] for i in range(2048))


def hashes(text, seed=0):
    for _, _, data, offs in W.slices(pa.array([text])):
        starts, ends, _, _ = W.words(data, offs, hashes=False)
        return W.hash_runs(data, starts, ends, seed).tolist()


def test_hash_of_patterned_and_similar_words(monkeypatch):
    many = [MORSE, MIRROR, MORSE[:1024], MIRROR[:1024], "a" * 8, "a" * 9, "a" * 16, "aaaaaaaabbbbbbbb", "bbbbbbbbaaaaaaaa"]
    many += [f"w{i}" for i in range(5000)] + ["x" * i for i in range(1, 700)]
    h = hashes(" ".join(many))
    assert len(set(h)) == len(set(many)) and not set(h) & set(hashes(" ".join(many), 1))
    assert hashes(" ".join(many)) == h and hashes("\n".join(many)) == h
    monkeypatch.setattr(W, "_BLOCK", 64)
    assert hashes(" ".join(many)) == h


def test_operators_on_patterned_words(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, MORSE + " " + prose(1, 30)), (2, MIRROR + " " + prose(2, 30)), (3, MORSE), (4, MIRROR),
            (5, " ".join([MORSE] * 31)), (6, " ".join([MIRROR] * 31))]
    docs = documents(spark, rows).coalesce(1)
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert all(r.kept for r in near_dup.near_duplicates(docs).collect())
    cut = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()}
    assert cut == {1: 0, 2: 0, 3: 0, 4: 0, 5: 30, 6: 30}


@pytest.mark.parametrize("texts", [[None, "", " "], ["a"], ["", "a b", None, "c"]])
def test_runs_of_awkward_rows(texts):
    for _, _, data, offs in W.slices(pa.array(texts, pa.string())):
        starts, ends, rows, h = W.words(data, offs)
        assert [int(b - a) for a, b in zip(rows[:-1], rows[1:])] == [len((t or "").split()) for t in texts] and len(h) == len(starts)
