"""Operator 3, language ID by a linear-chain conditional random field.

Each word of a text has a language; a word's features are its character n-grams (those at its ends are its affixes) and
whether it stands in the lexicon of a language, the words most frequent there in training. Weights and transitions are
learned by maximum likelihood on sequences spliced from pieces of texts in different languages, so that the
transitions learn code switching. Forward-backward gives each word's distribution; a text is labelled with
the language of the largest share of its words.

Edge cases. A text that is null or has no letter is ``und`` with score 0; texts of any length are labelled whole. Rows with
no language or whose id has crc32 mod 3 = 1 are never learned from. Language, source and id are no inputs of a prediction.
Languages with equal shares: the first by name. Without anything to learn from every text is ``und``. Repeated rows are labelled
alike. An empty table gives an empty result. Columns of the names of results, and ``_letters``, give way to them; all others are carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod3, text_hash, within
from .packed import PART, Packed, slices, trim
from .subword import Adam, all_words, distinct_words, ngrams, picked_sums, segment_sums

SIZES = (1, 2, 3, 4)
#: Words of a text worked on in step; longer texts are that many blocks.
BLOCK = 32
#: Bytes of text whose words are held at once; those of larger slices took two workers of an executor over its memory.
BYTES = PART


@dataclass
class Field:
    languages: list[str]
    bits: int
    weights: np.ndarray  # (features, languages)
    lexicon: np.ndarray  # sorted word hashes
    listed: np.ndarray  # (lexicon, languages): weight of standing in a lexicon
    start: np.ndarray
    moves: np.ndarray  # transition weights

    def emissions(self, p: Packed) -> np.ndarray:
        """Weight of each language for each word."""
        words, which, hashes = distinct_words(p)
        feats, owner = ngrams(p, words, SIZES, self.bits)
        n = np.maximum(1, np.bincount(owner, minlength=len(words)))
        each = segment_sums(self.weights[feats], owner, len(words)) / np.sqrt(n)[:, None]
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            each += np.where((self.lexicon[at] == hashes)[:, None], self.listed[at], 0)
        return each[which]

    def shares(self, p: Packed) -> np.ndarray:
        """For each text the mean of its words' distributions."""
        n = len(p.n_words)
        post = posteriors(self.emissions(p), p.first, self.start, self.moves)
        return segment_sums(post, p.doc, n) / np.maximum(1, p.n_words)[:, None]


def posteriors(scores: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward-backward over many chains end to end, exact; ``first`` bounds each.

    Chains are cut into blocks. Each block's matrix product is formed in step with all others, a scan over the blocks of
    each chain then gives what enters each block from either side, and words inside follow from that.
    """
    k = scores.shape[1]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves - moves.max())
    begin = np.exp(start - start.max())
    length = np.diff(first)
    chains = np.flatnonzero(length)
    n_blocks = -(-length[chains] // BLOCK)
    top = np.concatenate(([0], np.cumsum(n_blocks)))
    chain = np.repeat(np.arange(len(chains)), n_blocks)
    ordinal = np.arange(top[-1]) - top[chain]
    at = first[chains][chain] + BLOCK * ordinal
    size = np.minimum(BLOCK, first[chains + 1][chain] - at)
    eye = np.eye(k)
    # a block's product of (step x emission), the first word of a chain without a step
    prod = np.broadcast_to(eye, (len(at), k, k)).copy()
    for t in range(BLOCK):
        live = np.flatnonzero(size > t)
        into = prod[live] @ step
        if t == 0:
            into[ordinal[live] == 0] = eye
        into *= emit[at[live] + t][:, None, :]
        prod[live] = into / into.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.empty((len(at), k)), np.empty((len(at), k))
    state, i = np.broadcast_to(begin / begin.sum(), (len(chains), k)).copy(), 0
    live = np.arange(len(chains))
    while len(live):
        b = top[live] + i
        enter[b] = state[live]
        out = np.einsum("nk,nkj->nj", state[live], prod[b])
        state[live] = out / out.sum(axis=1, keepdims=True)
        i += 1
        live = live[n_blocks[live] > i]
    state, i = np.ones((len(chains), k)), 0
    live = np.arange(len(chains))
    while len(live):
        b = top[live + 1] - 1 - i
        leave[b] = state[live]
        out = np.einsum("nkj,nj->nk", prod[b], state[live])
        state[live] = out / out.sum(axis=1, keepdims=True)
        i += 1
        live = live[n_blocks[live] > i]
    forward, backward = np.empty_like(emit), np.empty_like(emit)
    for t in range(BLOCK):
        live = np.flatnonzero(size > t)
        moved = enter[live] @ step
        if t == 0:
            moved[ordinal[live] == 0] = enter[live[ordinal[live] == 0]]
        moved *= emit[at[live] + t]
        enter[live] = forward[at[live] + t] = moved / moved.sum(axis=1, keepdims=True)
    for t in range(BLOCK - 1, -1, -1):
        live = np.flatnonzero(size > t)
        backward[at[live] + t] = leave[live]
        back = (leave[live] * emit[at[live] + t]) @ step.T
        leave[live] = back / back.sum(axis=1, keepdims=True)
    out = forward * backward
    return out / out.sum(axis=1, keepdims=True)


def train(texts: list[str], languages: list[str], bits: int = 16, epochs: int = 40, rate: float = 0.05, lexicon: int = 1000, span: int = 64, piece: int = 24, decay: float = 1e-5, seed: int = 7) -> Field:
    names = sorted(set(languages))
    k = len(names)
    if not k:
        return Field([], bits, np.zeros((1 << bits, 0)), np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    hashes, which, doc, n_words, feats, owner = all_words(pa.array(texts, pa.large_string()), SIZES, bits)
    root = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(hashes))))[owner]
    label = np.asarray([names.index(x) for x in languages])[doc]
    times = np.stack([np.bincount(which[label == y], minlength=len(hashes)) for y in range(k)])
    listed = np.unique(np.concatenate([np.argsort(-times[y], kind="stable")[: min(lexicon, int((times[y] > 1).sum()))] for y in range(k)]))
    slot = np.full(len(hashes), len(listed))
    slot[listed] = np.arange(len(listed))
    # pieces of texts, of a geometric number of words, in random order, cut anew into sequences of equal length
    rng = np.random.default_rng(seed)
    n = len(which)
    cut = np.union1d(np.flatnonzero(rng.random(n) < 1 / piece), (np.cumsum(n_words) - n_words)[n_words > 0])
    pieces = np.split(np.arange(n), cut[cut > 0])
    order = np.concatenate([pieces[i] for i in rng.permutation(len(pieces))] or [np.zeros(0, int)])
    rows = max(1, len(order) // span)
    span = min(span, len(order)) or 1
    seq = order[: rows * span].reshape(rows, span)
    x, y = which[seq], label[seq]
    gold = np.zeros((len(hashes), k))
    np.add.at(gold, (x.ravel(), y.ravel()), 1)
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    gold_start = np.bincount(y[:, 0], minlength=k).astype(float)
    w, lex, start, moves = np.zeros((1 << bits, k)), np.zeros((len(listed) + 1, k)), np.zeros(k), np.zeros((k, k))
    adam, total = Adam([w.shape, lex.shape, start.shape, moves.shape], rate), float(seq.size)
    for _ in range(epochs):
        s = picked_sums(w, feats, root, owner, len(hashes)) + lex[slot]
        emit = np.exp(s - s.max(axis=1, keepdims=True))[x]
        step, a = np.exp(moves), np.empty((span, rows, k))
        state = np.exp(start) * emit[:, 0]
        for t in range(span):
            state = state if t == 0 else (state @ step) * emit[:, t]
            a[t] = state = state / state.sum(axis=1, keepdims=True)
        b, expect, seen = np.ones((rows, k)), np.zeros((k, k)), np.empty((rows, span, k))
        for t in range(span - 1, -1, -1):
            both = a[t] * b
            seen[:, t] = both / both.sum(axis=1, keepdims=True)
            if t:
                out = b * emit[:, t]
                expect += step * (a[t - 1].T @ (out / ((a[t - 1] @ step) * out).sum(axis=1, keepdims=True)))
                b = out @ step.T
                b /= b.sum(axis=1, keepdims=True)
        g = (segment_sums(seen.reshape(-1, k), x.ravel(), len(hashes)) - gold) / total
        dlex = segment_sums(g, slot, len(listed) + 1)
        dlex[-1] = 0
        adam.step([w, lex, start, moves], [picked_sums(g, owner, root, feats, 1 << bits) + decay * w, dlex + decay * lex, (seen[:, 0].sum(axis=0) - gold_start) / total, (expect - gold_moves) / total])
    rank = np.argsort(hashes[listed])
    return Field(names, bits, w, hashes[listed][rank], lex[:-1][rank], start, moves)


def sample(docs: DataFrame, most: int = 150, total: int = 9600, most_bytes: int = 64_000_000) -> tuple[list[str], list[str]]:
    """Texts and languages of at most ``most`` different (id, text) of every language, lowest hash of the id first; fewer of each, but one at least, where all would be over ``total``.

    Each language has an equal part of ``most_bytes``; rows that would go over it are passed over, but its shortest is always taken.
    """
    keys = [F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("name"), text_hash(F.col("text")).alias("t")]
    open_ = docs.filter("text is not null and lang is not null").filter(crc_mod3(F.col("doc_id")) != 1).select("text", *keys)
    each = max(1, min(most, total // max(1, open_.select("name").distinct().count())))
    ranked = F.row_number().over(Window.partitionBy("name").orderBy(F.xxhash64("id"), "id", "t"))
    picked = open_.select("id", "name", "t", F.octet_length("text").alias("size")).distinct().withColumn("n", ranked).filter(F.col("n") <= each)
    by_name: dict[str, list] = {}
    for r in sorted(picked.collect(), key=lambda r: r["n"]):
        by_name.setdefault(r["name"], []).append(r)
    taken = [r for rows in by_name.values() for r in within(rows, most_bytes // len(by_name))]
    wanted = docs.sparkSession.createDataFrame([(r["id"], r["name"], r["t"]) for r in taken], picked.select("id", "name", "t").schema)
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.name") == F.col("b.name")) & (F.col("a.t") == F.col("b.t"))
    found = open_.alias("a").join(F.broadcast(wanted).alias("b"), same, "left_semi")
    rows = found.groupBy("id", "name", "t").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (str(r["id"]), r["text"], r["name"]))
    return [r["text"] for r in rows], [r["name"] for r in rows]


def identify(docs: DataFrame, most: int = 150) -> DataFrame:
    """``doc_id, text, lang`` to ``doc_id, held_out, lang_pred, score``; every other column of ``docs`` but these follows."""
    field = docs.sparkSession.sparkContext.broadcast(train(*sample(docs, most)))
    trim()
    extra = [f for f in docs.schema.fields if f.name not in ("doc_id", "text", "held_out", "lang_pred", "score", "_letters")]

    def labelled(batches):
        f = field.value
        names = np.asarray([*f.languages, "und"], object)
        for b in batches:
            n = b.num_rows
            best, score = np.full(n, len(f.languages)), np.zeros(n)
            if f.languages:
                # a block holds a square of the languages: the more of them, the smaller the slices
                limit = BYTES * 64**2 // max(64, len(f.languages)) ** 2
                for i, j, p in slices(b.column("text"), limit=limit, lower=True):
                    if len(p.doc):
                        shares = f.shares(p)
                        best[i:j], score[i:j] = shares.argmax(axis=1), shares.max(axis=1)
            letters = np.asarray(b.column("_letters").fill_null(False)).astype(bool)
            best, score = np.where(letters, best, len(f.languages)), np.where(letters, np.clip(score, 0, 1), 0.0)
            cols = {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score), "text": b.column("text")}
            yield pa.RecordBatch.from_pydict(cols | {x.name: b.column(x.name) for x in extra})
        trim()

    read = docs.select("doc_id", (crc_mod3(F.col("doc_id")) == 1).alias("held_out"), "text", F.col("text").rlike(r"\p{L}").alias("_letters"), *[F.col(x.name) for x in extra])
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", `{x.name}` {x.dataType.simpleString()}" for x in extra)
    return read.mapInArrow(labelled, f"doc_id {kind}, held_out boolean, lang_pred string, score double, text string{more}")
