"""Words and shingles of many texts at once, as 64-bit hashes in arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SHINGLE = 5
U64 = np.uint64
#: Letters of a word count by powers of an odd number.
BASE = 0x9E3779B97F4A7C15


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    values = (values ^ (values >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> U64(27))) * U64(0x94D049BB133111EB)
    return values ^ (values >> U64(31))


def powers(base: int, count: int) -> np.ndarray:
    factors = np.full(count, base, U64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=U64)


def word_hashes(texts: Sequence[str], ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (separated by ASCII white space) of all texts, and where each text starts.

    With `ascii_only`, only A-Z are lower-cased.
    """
    if ascii_only:
        parts = [text.encode("utf-8", "replace").lower() for text in texts]
    else:
        parts = [text.lower().encode("utf-8", "replace") for text in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.concatenate([[True], blank[:-1]])
    starts, stops = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    offsets = np.cumsum([0, *(len(part) + 1 for part in parts)])
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, U64), firsts
    lengths = stops - starts
    spans = np.diff(np.concatenate([starts, [len(data)]]))
    inside = np.zeros(len(data), np.int64)
    inside[starts[0] :] = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], spans)
    letters = (data.astype(U64) + U64(1)) * powers(BASE, int(lengths.max()) + 1)[np.minimum(inside, lengths.max())]
    letters[blank] = 0
    return mix(np.add.reduceat(letters, starts) + lengths.astype(U64)), firsts


def windows_of(words: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words inside a text, and the text it is in. A shorter text, if it has words, is one run."""
    counts = np.diff(firsts)
    weights = powers(0xD6E8FEB86659FD93, size)
    hashes = np.zeros(max(0, len(words) - size + 1), U64)
    for at in range(size):
        hashes += words[at : at + len(hashes)] * weights[at]
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = owner[: len(hashes)] == owner[size - 1 : size - 1 + len(hashes)]
    hashes, owners = mix(hashes[whole]), owner[: len(whole)][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        ends = [mix(np.array([(words[firsts[t] : firsts[t + 1]] * weights[: counts[t]]).sum() + U64(counts[t])], U64))[0] for t in short]
        hashes, owners = np.concatenate([hashes, np.array(ends, U64)]), np.concatenate([owners, short])
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
    return hashes, owners


def weighted_sets(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts with their counts: (text, hash, count), ordered by text and hash."""
    hashes, owners = windows_of(*word_hashes(texts), SHINGLE)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    if not len(hashes):
        return owners, hashes, np.zeros(0, np.int64)
    new = np.concatenate([[True], (np.diff(owners) != 0) | (hashes[1:] != hashes[:-1])])
    at = np.flatnonzero(new)
    return owners[at], hashes[at], np.diff(np.concatenate([at, [len(hashes)]]))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller over sum of the larger counts of two sorted weighted sets; 0 if one is empty."""
    (left, n_left), (right, n_right) = a, b
    if not len(left) or not len(right):
        return 0.0
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    shared = np.minimum(n_left, n_right[at])[right[at] == left].sum()
    return float(shared / (n_left.sum() + n_right.sum() - shared))
