"""Operator 9, toxicity by subword-bag embeddings.

A word is the mean of the embeddings of its character n-grams, a text the mean of its words; a linear softmax over
that mean gives the score. Embeddings and softmax are trained together by Adam in numpy, on a bounded, seeded
sample of labelled rows. As the model is linear after the look-up, each n-gram's share of the logit is
worked out once, and scoring only looks shares up.

Edge cases. Null, empty and wordless texts get the score of the bias alone; texts of any length are scored whole, slice by
slice. Rows without a label are not learned from; with no label, or labels of one kind only, every score is that kind's (0
without any). Labels that contradict each other and ties: see :func:`sample`. Repeated rows are scored alike. An empty table
gives an empty result. Labels, language, source and id are no inputs of a score; columns but ``doc_id``, ``text`` and
``toxic`` are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod3, dropped, stored, within
from .packed import slices
from .subword import Adam, distinct_words, ngrams, segment_sums

SIZES = (3, 4, 5)


@dataclass
class Model:
    bits: int
    shares: np.ndarray  # of the logit, by n-gram
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for i, j, p in slices(column, lower=True):
            logit = np.full(j - i, self.bias)
            if len(p.doc):
                words, which, _ = distinct_words(p)
                feats, owner = ngrams(p, words, SIZES, self.bits)
                n = np.maximum(1, np.bincount(owner, minlength=len(words)))
                each = np.bincount(owner, self.shares[feats], len(words)) / n
                logit += np.bincount(p.doc, each[which], j - i) / np.maximum(1, p.n_words)
            out[i:j] = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        return out


def bags(texts: list[str], bits: int, min_texts: int) -> tuple[np.ndarray, ...]:
    """Sparse shares of words in texts (text, word, share) and of n-grams in words (n-gram, word), and the number of words.

    A word of fewer than ``min_texts`` texts teaches its n-grams little: it counts in the mean, as zero. Texts are gone
    through in slices, so that byte-wise arrays stay small beside the texts themselves.
    """
    column, hashes, docs, totals = pa.array(texts, pa.large_string()), [], [], []
    for i, _, p in slices(column, lower=True):
        hashes.append(p.word_hashes())
        docs.append(i + p.doc)
        totals.append(p.n_words)
    vocabulary, which = np.unique(np.concatenate(hashes), return_inverse=True)
    pairs, counts = np.unique(np.concatenate(docs) * len(vocabulary) + which, return_counts=True)
    doc, word = pairs // len(vocabulary), pairs % len(vocabulary)
    of_doc = counts / np.concatenate(totals)[doc]
    often = np.bincount(word, minlength=len(vocabulary)) >= min_texts
    slot, keep = np.cumsum(often) - 1, often[word]
    feats, owner, todo = [], [], often.copy()
    for _, _, p in slices(column, lower=True):
        first, _, own = distinct_words(p)
        at = np.searchsorted(vocabulary, own)
        new = todo[at]
        todo[at[new]] = False
        f, o = ngrams(p, first[new], SIZES, bits)
        feats.append(f)
        owner.append(slot[at[new]][o])
    return doc[keep], slot[word[keep]], of_doc[keep], np.concatenate(feats), np.concatenate(owner), int(often.sum())


def train(texts: list[str], toxic: list[int], bits: int = 18, dim: int = 2, epochs: int = 60, rate: float = 0.1, scale: float = 40.0, decay: float = 3e-5, min_texts: int = 2, weight: float = 0.5, seed: int = 7) -> Model:
    """``scale`` multiplies the mean, as a few words of a long text must be able to decide."""
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        return Model(bits, np.zeros(1 << bits), 500.0 if len(y) and y[0] else -500.0)
    doc, word, of_doc, feats, owner, n_words = bags(texts, bits, min_texts)
    of_word = 1 / np.maximum(1, np.bincount(owner, minlength=n_words))[owner]
    used, feats = np.unique(feats, return_inverse=True)
    feats, owner = feats.astype(np.int32), owner.astype(np.int32)
    rng = np.random.default_rng(seed)
    table, top, bias = np.zeros((len(used), dim)), rng.normal(0, 0.5, (dim, 2)), np.zeros(2)
    adam, n = Adam([table.shape, top.shape, bias.shape], rate), len(texts)
    onehot = np.stack([1 - y, y], axis=1)
    share = np.where(y == 1, (n / (2 * y.sum())) ** weight, (n / (2 * (n - y.sum()))) ** weight)[:, None]
    for _ in range(epochs):
        vectors = segment_sums(table[feats] * of_word[:, None], owner, n_words)
        mean = scale * segment_sums(vectors[word] * of_doc[:, None], doc, n)
        z = mean @ top + bias
        q = np.exp(z - z.max(axis=1, keepdims=True))
        dz = (q / q.sum(axis=1, keepdims=True) - onehot) * share / n
        dmean = scale * (dz @ top.T)
        dvectors = segment_sums(dmean[doc] * of_doc[:, None], word, n_words)
        dtable = segment_sums(dvectors[owner] * of_word[:, None], feats, len(used))
        adam.step([table, top, bias], [dtable + decay * table, mean.T @ dz + decay * top, dz.sum(axis=0)])
    shares = np.zeros(1 << bits)
    shares[used] = scale * (table @ (top[:, 1] - top[:, 0]))
    return Model(bits, shares, float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, most: int = 1500, most_bytes: int = 64_000_000) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most`` toxic rows and twice as many others, lowest hash of the id first; ids with crc32 mod 3 = 1 are held out.

    An id with several labels has the one that most of them are, and is not learned from if they tie; one with several texts
    is learned from by the smallest. Each label has half of ``most_bytes``; rows that would go over it are passed
    over, but the shortest is always taken.
    """
    open_ = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").filter(crc_mod3(F.col("doc_id")) != 1)
    voted = open_.groupBy("doc_id").agg(F.avg("toxic").alias("share")).filter("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("toxic"))
    known = voted.join(docs.filter("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    # each limit keeps the first rows of every partition before they meet
    first = lambda y, n: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = stored(first(1, most).unionByName(first(0, 2 * most)), "picked")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter("text is not null")
    texts = stored(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    sized = texts.select("doc_id", "toxic", F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("h")).collect()
    taken = []
    for y in (0, 1):
        taken += within(sorted((r for r in sized if r["toxic"] == y), key=lambda r: (r["h"], r["doc_id"])), most_bytes // 2)
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(r["doc_id"],) for r in taken], texts.select("doc_id").schema))
    rows = sorted(texts.join(wanted, "doc_id", "left_semi").collect(), key=lambda r: (str(r["doc_id"]), r["text"]))
    dropped(picked), dropped(texts)
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = 1500, threshold: float = 0.7) -> DataFrame:
    """``doc_id, text`` and ``doc_id, toxic`` to ``doc_id, held_out, score, predicted``."""
    model = docs.sparkSession.sparkContext.broadcast(train(*sample(docs, labels, most)))

    def scored(batches):
        for b in batches:
            s = model.value.scores(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", (crc_mod3(F.col("doc_id")) == 1).alias("held_out"), "text")
    return read.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")
