"""Hashed character n-grams of many words at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .packed import _BYTE, PART, Packed, Rolling, slices

U = np.uint64


def distinct_words(p: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of one place of each distinct word, which of them each word is, and their hashes."""
    hashes, first, which = np.unique(p.word_hashes(), return_index=True, return_inverse=True)
    return first, which, hashes


def ngrams(p: Packed, words: np.ndarray, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers below ``2**bits`` and, in step, the index into ``words`` they belong to.

    n-grams are of UTF-8 bytes between a mark before and one after the word, so those that hold a mark are
    affixes; a word shorter than a size has none of that size.
    """
    length = p.ends[words] - p.starts[words] + 2
    base = np.concatenate(([0], np.cumsum(length)))
    word = np.repeat(np.arange(len(words)), length)
    local = np.arange(base[-1]) - base[word]
    last = length[word] - 1
    inside = (local > 0) & (local < last)
    data = np.where(local == 0, 2, 3).astype(np.uint8)
    data[inside] = p.data[(p.starts[words][word] + local - 1)[inside]]
    rolling = Rolling(_BYTE[data])
    feats, owners = [], []
    for n in sizes:
        at = np.flatnonzero(local + n <= last + 1)
        feats.append((rolling.of(at, at + n) >> U(64 - bits)).astype(np.int32))
        owners.append(word[at].astype(np.int32))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(feats)[order], owner[order]


def all_words(column: pa.Array, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, ...]:
    """Sorted hashes of the distinct words of a column, which of them each word is, each word's text, words a text, and n-grams with the distinct word they belong to.

    Texts are gone through in slices, so that byte-wise arrays stay small beside the texts themselves.
    """
    hashes, docs, totals = [], [], []
    for i, _, p in slices(column, PART, lower=True):
        hashes.append(p.word_hashes())
        docs.append(i + p.doc)
        totals.append(p.n_words)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int32), np.zeros(0, np.int32)
    vocabulary, which = np.unique(np.concatenate(hashes), return_inverse=True)
    feats, owner, todo = [], [], np.ones(len(vocabulary), bool)
    for _, _, p in slices(column, PART, lower=True):
        first, _, own = distinct_words(p)
        at = np.searchsorted(vocabulary, own)
        new = todo[at]
        todo[at[new]] = False
        f, o = ngrams(p, first[new], sizes, bits)
        feats.append(f)
        owner.append(at[new].astype(np.int32)[o])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return vocabulary, which, np.concatenate(docs), np.concatenate(totals), np.concatenate(feats)[order], owner[order]


def segment_sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``values`` by ``owner``."""
    if values.ndim == 1:
        return np.bincount(owner, values, n)
    return np.stack([np.bincount(owner, values[:, k], n) for k in range(values.shape[1])], axis=1)


def picked_sums(values: np.ndarray, at: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """:func:`segment_sums` of ``values[at] * weight``, of which only a column is held at once."""
    return np.stack([np.bincount(owner, values[at, k] * weight, n) for k in range(values.shape[1])], axis=1)


class Adam:
    def __init__(self, shapes: list[tuple[int, ...]], rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]

    def step(self, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
