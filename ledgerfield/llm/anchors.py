"""Content-chosen anchors of byte windows.

Of the ``GRAM``-byte strings inside a window of ``WINDOW`` bytes, the one with the least hash (the
leftmost of equals) is the window's anchor. The choice depends on the window's bytes alone, so equal
windows have equal anchors at equal offsets. Neighbouring windows mostly share an anchor: one row
describes the whole run of window starts that do, in two halves by the anchor's place in the window.
"""

from __future__ import annotations

import numpy as np
import xxhash

from ledgerfield.llm.words import U, inverse, mixed, powers, table_of

WINDOW, GRAM = 200, 32
POSITION_BITS = 24
BLOCK = 1 << 23  # window starts handled at once; below 2 ** POSITION_BITS with a window's rest

LONG_WORD = 64
BASE_1, BASE_2 = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
TABLE_1, TABLE_2 = table_of(11), table_of(23)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, max(n, 1 << 21))
    return _POWERS[base][:n]


def prefix_hash(data: np.ndarray, table: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _powers(base, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans, equal for equal bytes wherever they stand."""
    return mixed((prefix[ends] - prefix[starts]) * _powers(inverse(base), len(prefix))[starts])


def word_hash(data: np.ndarray, table: np.ndarray, base: int, starts: np.ndarray,
              ends: np.ndarray) -> np.ndarray:
    """Hashes of words, equal for equal bytes.

    Powers modulo 2 ** 64 tell some long words apart badly (from 1,024 bytes on there are pairs that no
    base tells apart), so words of more than ``LONG_WORD`` bytes are hashed by XXH64, seeded by the base.
    """
    out = span_hash(prefix_hash(data, table, base), base, starts, ends)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        whole = memoryview(np.ascontiguousarray(data))
        out[long] = np.fromiter((xxhash.xxh64_intdigest(whole[s:e], base) for s, e in zip(
            starts[long].tolist(), ends[long].tolist())), np.uint64, len(long))
    return out


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray, window: int = WINDOW,
            gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: key, context hash, first start, last start, anchor.

    The key is a hash of the anchor and of the bytes on one side of it that all windows of the run
    hold; equal windows are in runs with equal keys. The context is all that the run's windows cover.
    Positions count from the first byte of ``data``.
    """
    if len(data) < window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    first = prefix_hash(data, TABLE_1, BASE_1)
    at = np.arange(len(data) - gram + 1)
    grams = mixed((first[gram:] - first[:-gram]) * _powers(inverse(BASE_1), len(at)))
    low = U((1 << POSITION_BITS) - 1)
    least = sliding_minimum((grams & ~low) | at.astype(np.uint64), window - gram + 1)
    chosen = (least & low).astype(np.int64)
    # A start is valid if its window ends inside the document it begins in.
    valid = np.zeros(len(data) + 1, np.int8)
    long = doc_ends - doc_starts >= window
    np.add.at(valid, doc_starts[long], 1)
    np.add.at(valid, doc_ends[long] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:len(chosen)]))
    run = chosen[starts]
    # Windows with much text before the anchor and windows with much behind it are runs apart.
    before = (run - starts) >= (window - gram) // 2
    edge = np.flatnonzero((np.diff(run) != 0) | (np.diff(starts) != 1) | np.diff(before))
    lo = starts[np.concatenate([[0], edge + 1])] if len(starts) else starts
    hi = starts[np.concatenate([edge, [len(starts) - 1]])] if len(starts) else starts
    anchor, half = chosen[lo], (window - gram) // 2
    side = (anchor - lo) >= half
    # What all windows of such a run hold: the anchor with the text on one side of it.
    key = span_hash(first, BASE_1, np.where(side, anchor - half, anchor),
                    np.where(side, anchor + gram, anchor + window - half + 1))
    key = mixed(key ^ side.astype(np.uint64))
    second = prefix_hash(data, TABLE_2, BASE_2)
    return key, span_hash(second, BASE_2, lo, hi + window), lo, hi, anchor
