"""Burrows-Wheeler transforms of sets of short strings, and their merging by refinement of an interleave.

A shard is sorted once. Two shards are merged without sorting suffixes again: a bit for each row tells from which of the two it
comes; dealing the bits out by the rows' preceding characters, in order, makes the interleave right for one more leading
character, until it stays the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Transform:
    """Rows in suffix order (equal suffixes by string): preceding character (0: none), string and offset; of a merged one, how
    many characters a row has in common with the row before it (to the depth of the merging)."""

    before: np.ndarray
    string: np.ndarray
    offset: np.ndarray
    strings: int
    common: np.ndarray | None = None


def build(text: np.ndarray, start: np.ndarray, length: np.ndarray, string: np.ndarray) -> Transform:
    """Of the strings text[start : start + length] (uint8), numbered `string`, each ended by a mark below all characters.

    Prefix doubling from keys of seven characters, as long as the longest string asks for it.
    """
    if not len(start):
        none = np.zeros(0, np.int64)
        return Transform(none.astype(np.uint8), string[:0], none, 0)
    size = length + 1
    owner = np.repeat(np.arange(len(start)), size)
    first = np.cumsum(size) - size
    offset = np.arange(len(owner)) - first[owner]
    # characters from 1, the end mark 0
    flat = np.zeros(len(owner), np.uint64)
    inside = offset < length[owner]
    flat[inside] = text[start[owner[inside]] + offset[inside]].astype(np.uint64) + np.uint64(1)
    stop = first[owner] + size[owner]
    here = np.arange(len(owner))
    key = np.zeros(len(owner), np.uint64)
    for k in range(7):
        at = here + k
        key = key << np.uint64(9) | np.where(at < stop, flat[np.minimum(at, len(flat) - 1)], np.uint64(0))
    depth = 7
    while True:
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])).astype(np.uint64)
        if depth > size.max():
            break
        at = here + depth
        key = rank << np.uint64(32) | np.where(at < stop, rank[np.minimum(at, len(rank) - 1)], np.uint64(0))
        depth *= 2
    order = np.argsort(rank << np.uint64(32) | owner.astype(np.uint64))  # equal suffixes in the order of their strings
    before = np.where(offset > 0, flat[here - 1], np.uint64(0)).astype(np.uint8 if flat.max(initial=0) < 256 else np.uint16)
    return Transform(before[order], string[owner[order]], offset[order], len(start))


def merge(a: Transform, b: Transform, depth: int | None = None) -> Transform:
    """In the order of whole suffixes, or only of their first `depth` characters.

    Each round makes the interleave right for one more leading character, and tells apart rows that differ first in it: a row
    starts a block if its preceding row was dealt from another character or another block. A block that starts in round k
    has k - 1 characters in common with the row before it, so common prefixes come from the merging itself.
    """
    n = len(a.before) + len(b.before)
    ends = np.concatenate([np.zeros(a.strings, bool), np.ones(b.strings, bool)])
    right = np.concatenate([np.zeros(len(a.before), bool), np.ones(len(b.before), bool)])
    merged = np.empty(n, np.promote_types(a.before.dtype, b.before.dtype))
    starts = np.zeros(n, bool)
    starts[:1] = True
    common = np.full(n, -1, np.int32)
    k = 0
    while depth is None or k < depth:
        k += 1
        merged[~right], merged[right] = a.before, b.before
        order = np.argsort(merged, kind="stable")
        dealt = right[order]
        dealt[: len(ends)] = ends  # the end marks come first, in the order of the strings
        character, block = merged[order], np.cumsum(starts, dtype=np.int32)[order]
        new = np.ones(n, bool)
        new[1:] = (character[1:] != character[:-1]) | (block[1:] != block[:-1])
        new[: len(ends) + 1] = True
        common[new & (common < 0)] = k - 1
        done = np.array_equal(dealt, right) and np.array_equal(new, starts)
        right, starts = dealt, new
        if done:
            break
    common[common < 0] = k if depth is None else depth
    string, offset = np.empty(n, a.string.dtype), np.empty(n, a.offset.dtype)
    merged[~right], merged[right] = a.before, b.before
    string[~right], string[right], offset[~right], offset[right] = a.string, b.string, a.offset, b.offset
    return Transform(merged, string, offset, a.strings + b.strings, common)


def repeated(text: np.ndarray, start: np.ndarray, length: np.ndarray, window: int, shard: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, interval) of each place of `window` characters; places of one interval hold the same ones.

    Strings are numbered in their order. Two shards, or more of at most about `shard` characters, are merged pairwise;
    the last merging goes no deeper than the window. Intervals end where the common prefix it found is shorter.
    """
    number, reach = np.arange(len(start)), np.cumsum(length + 1)
    shard = min(shard, int(reach[-1]) // 2 + 1)
    cut = np.searchsorted(reach, np.arange(shard, int(reach[-1]), shard), side="left") + 1
    parts = [build(text, start[x], length[x], x) for x in np.split(number, np.unique(cut)) if len(x)]
    if len(parts) == 1:
        parts.append(build(text, start[:0], length[:0], number[:0]))
    while len(parts) > 1:
        last = window if len(parts) == 2 else None
        parts = [merge(*parts[i : i + 2], last) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    rows = parts[0]
    whole = rows.offset + window <= length[rows.string]
    return rows.string[whole], rows.offset[whole], np.cumsum(rows.common < window)[whole]
