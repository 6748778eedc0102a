"""Vectorised numpy kernels on Arrow string batches: words, word hashes, shingles, one-permutation MinHash.

Every function works on the flat byte buffer of a batch, so the Python cost is per batch and not per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; bijective."""
    h = (h ^ (h >> np.uint64(30))) * C1
    h = (h ^ (h >> np.uint64(27))) * C2
    return h ^ (h >> np.uint64(31))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of every text, and the first word of each text (n + 1 numbers)."""
    n = len(data)
    word = ~IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    h = left.astype(np.uint64) * GOLD
    live = np.arange(len(starts))
    at = starts
    while len(live):
        size = np.minimum(left[live], 8)
        h[live] = mix((h[live] ^ (eight[at] & MASKS[size])) + GOLD)
        more = left[live] > 8
        live, at = live[more], at[more] + 8
        left[live] -= 8
    return h


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles, text by text; a text of fewer words gives its whole sequence. Also the bounds of each text."""
    n_words = np.diff(first)
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(bounds[-1]) - bounds[text] + first[text]
    if not len(at):
        return np.zeros(0, np.uint64), bounds
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    short = n_words[text] < k
    h = np.full(len(at), np.uint64(k))
    for j in range(k):
        nxt = mix((h ^ padded[at + j]) + GOLD)
        h = np.where(short & (j >= n_words[text]), h, nxt) if short.any() else nxt
    h[short] = mix(h[short] + n_words[text][short].astype(np.uint64))
    return h, bounds


def distinct_sets(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        s = np.sort(h[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if b > a + 1 else s)
    return out


def jumps(bins: int, seed: int = 7) -> np.ndarray:
    """For optimal densification: the bin that an empty bin tries at each attempt."""
    a = np.arange(64, dtype=np.uint64)[:, None] * np.uint64(1 << 20)
    return (mix(a + np.arange(bins, dtype=np.uint64)[None, :] + np.array([seed], dtype=np.uint64) * GOLD) % np.uint64(bins)).astype(np.int64)


def one_permutation(sets: list[np.ndarray], bins: int, table: np.ndarray) -> np.ndarray:
    """One-permutation MinHash signatures (texts x bins): the smallest hash in each bin of the hash range; an empty bin
    takes the value of the first full one in its own random order, the same in every text (optimal densification)."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    sig = np.full((len(sets), bins), EMPTY, dtype=np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            b = (s >> shift).astype(np.int64)
            head = np.concatenate([[True], b[1:] != b[:-1]])
            sig[i, b[head]] = s[head]
    base = sig.copy()
    rows, cols = np.nonzero((sig == EMPTY) & (sig != EMPTY).any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        got = base[rows, table[attempt % len(table)][(cols + attempt // len(table)) % bins]]
        full = got != EMPTY
        sig[rows[full], cols[full]] = got[full]
        rows, cols = rows[~full], cols[~full]
        attempt += 1
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """Hash of each band of so many rows (texts x bands); the number of the band is part of it."""
    n, bins = sig.shape
    bands = sig.reshape(n, bins // rows, rows)
    h = np.broadcast_to(np.arange(bins // rows, dtype=np.uint64) * GOLD, (n, bins // rows)).copy()
    for j in range(rows):
        h = mix((h ^ bands[:, :, j]) + GOLD)
    return h


LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z and Latin-1 letters), and which of them belong to words: letters, not general punctuation."""
    low = LOWER[data]
    word = LETTER[data]
    if len(data) > 2:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][latin] += 0x20
        punct = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        word[punct] = word[punct + 1] = word[punct + 2] = False
    return low, word


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts, ends and first word as word_spans() gives them, of the runs of letters."""
    low, word = letters(data)
    return low, *word_spans(np.where(word, np.uint8(97), np.uint8(32)), offsets)
