"""Word-piece tokenisation of a corpus and token-budget reports.

Greedy longest-prefix word pieces in one pass over the documents, without a shuffle: Spark cuts the texts into words, tasks
look at the distinct words of an Arrow batch and walk each through a prefix automaton of the vocabulary (state,
character -> state), which is broadcast. A vocabulary beyond the broadcast's byte bound takes the way of joins: every
distinct word is cut into all its (start, end) substrings, which are joined with the vocabulary; the longest match from
each start forms an edge map that is walked once per distinct word with `aggregate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybridctx import constants as K
from hybridctx.functions.columns import basic_tokenize
from hybridctx.operators.sizing import broadcast_if_small
from hybridctx.session import reliable_checkpoint

SPECIALS = ["[CLS]", "[SEP]", "[UNK]"]


def corpus_vocabulary(docs: DataFrame, text: str, min_doc_frac: float = 0.01, exclude_chars: str = "") -> DataFrame:
    """Vocabulary built from the corpus: specials, every character and ##character (except the excluded
    ones), every word in at least min_doc_frac of the documents and ##(its last three letters).
    id = rank by token text (from 0). Output: (token, id)."""
    # document frequency: words made unique inside each document (no shuffle), then counted map-side
    # (one row per distinct word; read by four branches below, so materialised once)
    df = reliable_checkpoint(docs.select(F.explode(F.array_distinct(basic_tokenize(text))).alias("w"))
                             .groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    frequent = df.where(F.col("n") >= F.lit(min_doc_frac) * n_docs).select("w")
    chars = (df.select(F.explode(F.array_distinct(F.split("w", ""))).alias("c"))
             .where(F.col("c") != "").distinct())
    if exclude_chars:
        chars = chars.where(~F.col("c").isin(list(exclude_chars)))
    toks = (chars.select(F.col("c").alias("token"))
            .unionByName(chars.select(F.concat(F.lit("##"), "c").alias("token")))
            .unionByName(frequent.select(F.col("w").alias("token")))
            .unionByName(frequent.where(F.length("w") >= 3)
                         .select(F.concat(F.lit("##"), F.substring("w", -3, 3)).alias("token")))
            .unionByName(docs.sparkSession.createDataFrame([(s,) for s in SPECIALS], "token string"))
            .distinct())
    # id = rank by token text, as a two-level rank: row number inside the partition of the first character
    # plus the number of tokens under smaller first characters (a running sum over one row per character)
    toks = toks.withColumn("_first", F.substring("token", 1, 1))
    per_first = toks.groupBy("_first").agg(F.count(F.lit(1)).alias("_n"))
    offsets = per_first.withColumn("_off", F.sum("_n").over(
        Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1))).select("_first", "_off")
    local = F.row_number().over(Window.partitionBy("_first").orderBy("token"))
    ranked = (toks.withColumn("_local", local).join(F.broadcast(offsets), "_first")
              .select("token", (F.coalesce("_off", F.lit(0)) + F.col("_local") - 1).cast("int").alias("id")))
    return reliable_checkpoint(ranked)


def special_id(vocab: DataFrame, token: str):
    """Scalar subquery: id of a special token, 0 when the vocabulary lacks it."""
    return F.coalesce(vocab.where(F.col("token") == token).select(F.max("id")).scalar(), F.lit(0))


def _segment(words: DataFrame, vocab: DataFrame, max_word: int) -> DataFrame:
    """(w, ids, ok) for distinct words with at least one matching piece; ok = the greedy walk finished."""
    L = F.length("w")
    # pieces longer than the longest vocabulary entry of their kind cannot match: bound the substrings
    max_head = vocab.where(~F.col("token").startswith("##")).select(F.max(F.length("token"))).scalar()
    max_tail = vocab.where(F.col("token").startswith("##")).select(F.max(F.length("token")) - 2).scalar()
    span = F.when(F.col("start") == 0, F.coalesce(max_head, F.lit(0))).otherwise(F.coalesce(max_tail, F.lit(0)))
    subs = (words.where(L <= max_word)
            .select("w", F.explode(F.sequence(F.lit(0), L - 1)).alias("start"))
            .select("w", "start", F.least(F.length("w"), F.col("start") + span).alias("_last"))
            .where(F.col("_last") > F.col("start"))
            .select("w", "start", F.explode(F.sequence(F.col("start") + 1, F.col("_last"))).alias("end")))
    piece = F.when(F.col("start") == 0, F.substring("w", 1, F.col("end"))).otherwise(
        F.concat(F.lit("##"), F.substring("w", F.col("start") + 1, F.col("end") - F.col("start"))))
    edges = subs.select("w", "start", "end", piece.alias("token")) \
        .join(broadcast_if_small(vocab.select("token", "id"), 2_000_000), "token")
    # one group per distinct word; its edge list is bounded by length x longest piece
    per_word = edges.groupBy("w").agg(F.collect_list(F.struct("start", "end", "id")).alias("_e"))
    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("ids"), F.lit(True).alias("ok"))

    def step(acc, _):
        # longest piece starting at the current position (ends are unique per start)
        here = F.filter("_e", lambda x: x["start"] == acc["pos"])
        best = F.element_at(F.array_sort(F.transform(here, lambda x: F.struct((-x["end"]).alias("k"), x["end"]
                                                                              .alias("end"), x["id"].alias("id")))), 1)
        done = (acc["pos"] >= F.length("w")) | ~acc["ok"]
        return F.when(done, acc).when(best.isNull(), F.struct(acc["pos"].alias("pos"), acc["ids"].alias("ids"),
                                                               F.lit(False).alias("ok"))) \
            .otherwise(F.struct(best["end"].alias("pos"), F.concat(acc["ids"], F.array(best["id"])).alias("ids"),
                                F.lit(True).alias("ok")))

    r = F.aggregate(F.sequence(F.lit(1), F.length("w")), init, step)
    return per_word.select("w", r["ids"].alias("ids"), r["ok"].alias("ok"))


class PieceAutomaton:
    """The vocabulary as a prefix automaton: state 0 starts a word, state 1 goes on within one."""

    def __init__(self, tokens: list[str], ids: list[int]):
        self.next: dict[int, int] = {}
        self.piece = [-1, -1]
        for token, i in zip(tokens, ids):
            tail = token.startswith("##")
            # '##' and longer ones are pieces of a word's start as well, when a word begins like that
            for state, chars in ((0, token), (1, token[2:])) if tail else ((0, token),):
                for c in chars:
                    at = state << 21 | ord(c)
                    if at not in self.next:
                        self.next[at] = len(self.piece)
                        self.piece.append(-1)
                    state = self.next[at]
                if chars:
                    self.piece[state] = i

    def walk(self, word: str) -> list[int]:
        """Ids of the longest pieces from left to right; empty when some rest starts with none."""
        out, at, root = [], 0, 0
        while at < len(word):
            state, end = root, at
            found = -1
            for i in range(at, len(word)):
                state = self.next.get(state << 21 | ord(word[i]), -1)
                if state < 0:
                    break
                if self.piece[state] >= 0:
                    found, end = self.piece[state], i + 1
            if found < 0:
                return []
            out.append(found)
            at, root = end, 1
        return out


def _batch_pieces(words: pa.ListArray, automaton: PieceAutomaton, special: dict[str, int], max_len: int) -> pa.ListArray:
    """[CLS] pieces [SEP] of every row of words."""
    lens = words.value_lengths().fill_null(0).to_numpy()
    flat = words.flatten().dictionary_encode()
    pieces = [automaton.walk(w) if len(w) <= K.WORDPIECE_MAX_WORD else [] for w in flat.dictionary.to_pylist()]
    pieces = [x or [special["[UNK]"]] for x in pieces]
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ids = np.fromiter((i for x in pieces for i in x), np.int32, int(size.sum()))
    word = flat.indices.to_numpy()
    n = size[word]
    # first piece of every word in its row, and what the row keeps
    ends = np.concatenate([[0], np.cumsum(n)])
    rows = np.concatenate([[0], np.cumsum(lens)])
    keep = np.minimum(ends[rows[1:]] - ends[rows[:-1]], max_len - 2)
    offs = np.concatenate([[0], np.cumsum(keep + 2)])
    out = np.empty(offs[-1], np.int32)
    out[offs[:-1]], out[offs[1:] - 1] = special["[CLS]"], special["[SEP]"]
    at = np.repeat((np.cumsum(size) - size)[word] - ends[:-1], n) + np.arange(ends[-1])
    place = np.arange(ends[-1]) - np.repeat(ends[rows[:-1]], ends[rows[1:]] - ends[rows[:-1]])
    row = np.repeat(np.arange(len(lens)), ends[rows[1:]] - ends[rows[:-1]])
    kept = place < keep[row]
    out[offs[row[kept]] + 1 + place[kept]] = ids[at[kept]]
    return pa.ListArray.from_arrays(offs.astype(np.int32), pa.array(out))


#: Bytes of vocabulary (token texts and 64 for each) that are broadcast at most.
MAX_VOCAB_BYTES = 64 << 20


def wordpiece_corpus(docs: DataFrame, key: str, text: str, vocab: DataFrame,
                     max_len: int = K.WORDPIECE_MAX_LEN, max_vocab_bytes: int = MAX_VOCAB_BYTES) -> DataFrame:
    """(key, ids): [CLS] word pieces [SEP], at most max_len ids in total. Missing specials get id 0."""
    size = vocab.agg(F.sum(F.octet_length("token") + 64)).first()[0] or 0
    if size > max_vocab_bytes:
        return wordpiece_by_joins(docs, key, text, vocab, max_len)
    got = vocab.select("token", "id").toArrow()
    tokens, ids = got.column("token").to_pylist(), got.column("id").to_pylist()
    special = {t: 0 for t in SPECIALS} | {t: i for t, i in zip(tokens, ids) if t in SPECIALS}
    shared = docs.sparkSession.sparkContext.broadcast((PieceAutomaton(tokens, ids), special))

    def run(batches):
        automaton, special = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _batch_pieces(b.column(1), automaton, special, max_len)],
                                             names=[key, "ids"])

    # every word gives at least one piece, so only the first max_len - 2 words can reach the output
    words = docs.select(key, F.slice(basic_tokenize(text), 1, max_len - 2).alias("words"))
    return words.mapInArrow(run, T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def wordpiece_by_joins(docs: DataFrame, key: str, text: str, vocab: DataFrame,
                       max_len: int = K.WORDPIECE_MAX_LEN) -> DataFrame:
    """wordpiece_corpus for a vocabulary of any size, as joins over distinct words."""
    # every word gives at least one piece, so only the first max_len - 2 words can reach the output
    words = docs.select(key, F.posexplode(F.slice(basic_tokenize(text), 1, max_len - 2)).alias("wpos", "w"))
    seg = _segment(words.select("w").distinct(), vocab, K.WORDPIECE_MAX_WORD)
    unk = F.array(special_id(vocab, "[UNK]"))
    per_word = words.join(seg, "w", "left").select(
        key, "wpos", F.when(F.col("ok") & (F.size("ids") > 0), F.col("ids")).otherwise(unk).alias("ids"))
    w = Window.partitionBy(key).orderBy("wpos").rowsBetween(Window.unboundedPreceding, -1)
    room = max_len - 2
    per_word = per_word.withColumn("_before", F.coalesce(F.sum(F.size("ids")).over(w), F.lit(0)))
    kept = per_word.where(F.col("_before") < room).select(
        key, "wpos", F.slice("ids", 1, F.lit(room) - F.col("_before")).alias("ids"))
    per_doc = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("wpos", "ids"))).alias("_w"))
    body = F.flatten(F.transform("_w", lambda s: s["ids"]))
    out = docs.select(key).join(per_doc, key, "left")
    return out.select(key, F.concat(F.array(special_id(vocab, "[CLS]")),
                                    F.coalesce(body, F.array().cast("array<int>")),
                                    F.array(special_id(vocab, "[SEP]"))).alias("ids"))


def token_budget_report(docs: DataFrame, text: str, by: str, max_len: int = K.WORDPIECE_MAX_LEN) -> DataFrame:
    """Per group: documents, documents whose basic tokens plus [CLS]/[SEP] exceed max_len, largest count."""
    n = F.size(basic_tokenize(text))
    return (docs.select(by, n.alias("_n")).groupBy(by)
            .agg(F.count(F.lit(1)).alias("n_docs"),
                 F.sum(F.when(F.col("_n") + 2 > max_len, 1).otherwise(0)).alias("n_over_budget"),
                 F.max("_n").alias("max_tokens")))
