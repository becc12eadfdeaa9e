"""Shingle sets and SuperMinHash signatures of many documents at once, in numpy.

SuperMinHash (Ertl, 2017): each element draws a random permutation of the m signature slots and, for the
j-th slot of its permutation, the value j + r with r uniform in [0, 1); a slot keeps its least value. As the
values of one element are correlated ranks, the estimate's variance is below that of m independent hashes.
Once every slot of a document holds a value below j, later ranks cannot change it and its elements stop.
"""

from __future__ import annotations

import numpy as np

from .common import U64, hash_words, mix, words_of

_STEP = U64(0x9E3779B97F4A7C15)
_WORD = U64(0xD6E8FEB86659FD93)
_SHORT = U64(0xA0761D6478BD642F)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the `width`-word shingles in text order; with fewer words, of the whole sequence."""
    n = len(words)
    if not n:
        return words
    if n < width:
        h = np.array([n], U64) * _SHORT
        for k in range(n):
            h = mix(h ^ words[k : k + 1]) * _WORD
        return mix(h)
    h = words[: n - width + 1]
    for k in range(1, width):
        h = (h ^ (h >> U64(29))) * _WORD + words[k : n - width + 1 + k]
    return mix(h)


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's words."""
    return np.unique(shingle_hashes(hash_words(words_of(text)), width))


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m unsigned 64-bit values a set; rows of empty sets keep the top value."""
    n_docs = len(sets)
    sig = np.full(n_docs * m, _EMPTY, U64)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return sig.reshape(n_docs, m)
    doc = np.repeat(np.arange(n_docs), sizes)
    seed = np.concatenate(sets)
    swaps: list[np.ndarray] = []
    for j in range(m):
        draw = mix(seed + np.array([j + 1], U64) * _STEP)
        at = (j + ((draw & U64(0xFFFFFF)) * U64(m - j) >> U64(24)).astype(np.int64)).astype(np.int16)
        slot = at
        for t in range(j - 1, -1, -1):
            slot = np.where(slot == swaps[t], np.int16(t), slot)
        np.minimum.at(sig, doc * m + slot, (U64(j) << U64(56)) | (draw >> U64(8)))
        swaps.append(at)
        if j + 1 < m:
            worst = sig.reshape(n_docs, m).max(1) >> U64(56)
            going = worst[doc] > U64(j)
            if not going.any():
                break
            if not going.all():
                doc, seed = doc[going], seed[going]
                swaps = [s[going] for s in swaps]
    return sig.reshape(n_docs, m)


def bands(sig: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key a band, which holds the band's number."""
    s = sig[:, : n_bands * rows].reshape(len(sig), n_bands, rows)
    h = np.broadcast_to(mix(np.arange(1, n_bands + 1, dtype=U64)), s.shape[:2]).copy()
    for k in range(rows):
        h = mix(h ^ s[:, :, k]) * _WORD
    return h.view(np.int64)
