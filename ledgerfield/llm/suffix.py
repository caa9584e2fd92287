"""Suffix order by Lyndon groups, linear apart from one sort of the groups.

The longest Lyndon prefix of a suffix ends where its next smaller suffix begins. Suffixes with one
such prefix form a group, and groups are ordered like their prefixes. Reading a text from its end,
each suffix passes over larger ones, from one next smaller suffix to the next, down the order; the
suffix it stops at is its next smaller one, and it is the previous smaller one of all it has passed.
Then the order is emitted: for each suffix in the order found so far, the suffixes whose prefix ends
just before it are found along the previous-smaller pointers, and each takes the next free place of
its group. No text is renamed and nothing is solved recursively.

Many short texts are ordered together, each closed by a byte 0; pointers are set for all of them at
once, position by position from their ends.
"""

from __future__ import annotations

import numpy as np

from ledgerfield.llm.words import U

WORD = 8


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with a 0 behind each, their starts and the places of the zeros.

    Bytes are raised by one (255 does not occur in UTF-8), so that 0 is below all others.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8) + np.uint8(1)
    ends = np.cumsum(lengths + 1) - 1
    return data, ends - lengths, ends


def word_keys(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(2 * WORD, np.uint8)])
    keys = np.zeros(len(data) + WORD, np.uint64)
    for b in range(WORD):
        keys = (keys << U(8)) | padded[b:b + len(keys)]
    return keys


def _greater(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the suffixes at ``a`` are greater than those at ``b`` (never equal)."""
    x, y = keys[a], keys[b]
    out = x > y
    tie = np.flatnonzero(x == y)
    depth = WORD
    while len(tie):
        x, y = keys[a[tie] + depth], keys[b[tie] + depth]
        out[tie] = x > y
        tie = tie[x == y]
        depth += WORD
    return out


def smaller_pointers(keys: np.ndarray, starts: np.ndarray,
                     ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next and previous smaller suffix of every position; -1 where there is none."""
    following = np.full(len(keys), -1, np.int64)
    previous = np.full(len(keys), -1, np.int64)
    order = np.argsort(starts - ends, kind="stable")
    lengths, last = (ends - starts)[order], ends[order]
    for t in range(1, int(lengths[0]) + 1 if len(lengths) else 1):
        here = last[:np.searchsorted(-lengths, -t, "right")] - t
        found = here + 1
        moving = np.arange(len(here))
        while len(moving):
            larger = _greater(keys, found[moving], here[moving])
            moving = moving[larger]
            passed = found[moving]
            previous[passed] = here[moving]
            found[moving] = following[passed]
        following[here] = found
    return following, previous


def group_starts(keys: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Number of suffixes in smaller groups, for each suffix; its prefix has ``length`` bytes."""
    def masked(which: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(length[which] - depth, 0, WORD)
        shift = (WORD - left).astype(np.uint64) * U(8)
        value = keys[np.minimum(at[which] + depth, len(keys) - 1)]
        return np.where(left == 0, U(0), value >> (shift & U(63)) << (shift & U(63)))

    rank = np.zeros(len(at), np.int64)
    which, depth = np.arange(len(at)), 0
    while len(which):
        key = masked(which, depth)
        order = np.lexsort((key, rank[which]))
        which, key = which[order], key[order]
        old = rank[which]
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        new = new_old | np.concatenate([[True], key[1:] != key[:-1]])
        first_old = np.flatnonzero(new_old)[np.cumsum(new_old) - 1]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[which] = old + first - first_old
        depth += WORD
        # Prefixes that agree so far and of which one at least goes on are told apart further on.
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        goes_on = np.bincount(group, weights=length[which] > depth) > 0
        which = which[((size > 1) & goes_on)[group]]
    return rank


def suffix_order(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of the texts in the order of their suffixes; a text's zero ends its suffix."""
    keys = word_keys(data)
    following, previous = smaller_pointers(keys, starts, ends)
    inside = np.ones(len(data), bool)
    inside[ends] = False
    at = np.flatnonzero(inside)
    place = np.zeros(len(data), np.int64)
    place[at] = len(ends) + group_starts(keys, at, following[at] - at)
    order = ends.tolist() + [0] * len(at)
    free = list(range(len(data)))
    following, previous, place = following.tolist(), previous.tolist(), place.tolist()
    for s in order:  # grows as it is read: a suffix stands behind the one its prefix ends at
        e = s - 1
        while e >= 0 and following[e] == s:
            slot = free[place[e]]
            order[slot] = e
            free[place[e]] = slot + 1
            e = previous[e]
    return np.array(order[len(ends):], np.int64)


def repeated_starts(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the starts of strings of ``width`` bytes that also start elsewhere in them."""
    if not texts:
        return []
    data, starts, ends = joined(texts)
    order = suffix_order(data, starts, ends)
    owner = np.searchsorted(ends, order)
    order = order[ends[owner] - order >= width]
    keys = word_keys(data)
    equal = np.arange(max(0, len(order) - 1))  # neighbours that agree so far
    for depth in range(0, width, WORD):
        a, b = keys[order[equal] + depth], keys[order[equal + 1] + depth]
        cut = U(8 * max(0, depth + WORD - width))
        equal = equal[a >> cut == b >> cut]
    hit = np.zeros(len(data), bool)
    hit[order[equal]] = hit[order[equal + 1]] = True
    return [np.flatnonzero(hit[s:e]) for s, e in zip(starts, ends)]
