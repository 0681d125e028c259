"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from edgelens.llm.common import byte_table, mix

#: What separates words: space and the controls 09 to 0D.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Of each text of a slice (UTF-8 bytes and offsets): its distinct shingles as sorted signed 64-bit hashes.

    A-Z count as a-z. A shingle is a run of ``words`` words; a text with fewer words has its whole sequence as one
    shingle, a text without words has none. Two different shingles get the same hash with probability 2**-64.
    """
    n_texts = len(offsets) - 1
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.ones(256, bool)
    inside[list(SEPARATORS)] = False
    is_word = inside[data]
    if not is_word.any():
        return [np.zeros(0, np.int64)] * n_texts
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    after_gap = np.concatenate([[True], ~is_word[:-1]]) | cut[:-1]
    starts = np.flatnonzero(is_word & after_gap)
    kept = np.flatnonzero(is_word)
    first = np.searchsorted(kept, starts)
    lengths = np.diff(np.concatenate([first, [len(kept)]]))
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64)]))
    word = mix(np.add.reduceat(byte_table(1)[lower[data[kept]]] * power[place], first) + lengths.astype(np.uint64))
    of_text = np.searchsorted(starts, offsets)
    n = len(word)
    runs = max(0, n - words + 1)
    run = np.zeros(runs, np.uint64)
    weights = byte_table(2)
    for k in range(words):
        run += word[k : k + runs] * weights[k]
    run = mix(run).view(np.int64)
    out = []
    for lo, hi in zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(run[lo : hi - words + 1]))
        elif hi > lo:
            whole = (word[lo:hi] * weights[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(mix(np.array([whole])).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out
