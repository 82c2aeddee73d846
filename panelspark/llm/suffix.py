"""Suffix arrays and common prefixes of byte arrays in numpy."""

from __future__ import annotations

import numpy as np

#: consecutive places that one lane of the common-prefix pass walks
LANE = 256


def packed(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros follow the end."""
    long = np.concatenate([buf, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    out = np.zeros(len(buf), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | long[k : k + len(buf)]
    return out


def suffix_array(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each place) by doubling refinement of the groups that still tie.

    The first eight bytes give the first groups; a round sorts each open group by the rank ``h`` places on, and only
    open groups take part. A suffix that ends goes before those it begins.
    """
    n = len(buf)
    head = packed(buf)
    # a suffix shorter than eight bytes ends: it precedes equal bytes that go on
    ends = np.maximum(n - np.arange(n), 0)
    short = np.minimum(ends, 8)
    order = np.lexsort((short, head))
    step = np.ones(n, dtype=bool)
    step[1:] = (head[order[1:]] != head[order[:-1]]) | (short[order[1:]] != short[order[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(step)[np.cumsum(step) - 1]
    h = 8
    while not step.all() and h < 2 * n:
        last = np.concatenate([step[1:], [True]])
        open_at = np.flatnonzero(~(step & last))
        some = order[open_at]
        after = np.full(len(some), -1, dtype=np.int64)
        inside = some + h < n
        after[inside] = rank[some[inside] + h]
        group = rank[some]
        sub = np.lexsort((after, group))
        some, after, group = some[sub], after[sub], group[sub]
        order[open_at] = some
        new = np.ones(len(some), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        step[open_at] = new
        rank[some] = open_at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        h *= 2
    return order, rank


def common_prefixes(buf: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, up to ``most``.

    Kasai's rule: the suffix one place on shares at least one byte less, so a walk in text order hardly re-reads.
    Lanes of ``LANE`` places walk together.
    """
    n = len(buf)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    head = np.concatenate([packed(buf), np.zeros(most + 9, dtype=np.uint64)])
    start = np.arange(0, n, LANE)
    held = np.zeros(len(start), dtype=np.int64)
    for t in range(min(LANE, n)):
        i = start + t
        live = i < n
        i, now = i[live], np.maximum(held[live] - 1, 0)
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        now[r == 0] = 0
        room = np.minimum(n - np.maximum(i, j), most)
        go = np.flatnonzero((now < room) & (r > 0))
        while len(go):
            x = head[i[go] + now[go]] ^ head[j[go] + now[go]]
            same = x == 0
            # zero bytes in front of the first difference
            bits = np.zeros(len(go), dtype=np.int64)
            bits[~same] = 63 - np.floor(np.log2((x[~same] >> np.uint64(8)).astype(np.float64) * 256 + 255)).astype(np.int64)
            now[go] += np.where(same, 8, np.clip(bits, 0, 63) // 8)
            go = go[same & (now[go] < room[go])]
        now = np.minimum(now, room)
        now[r == 0] = 0
        out[r] = now
        held[live] = now
    return out


def equal_classes(buf: np.ndarray, width: int) -> np.ndarray:
    """A number per place, equal for places whose next ``width`` bytes agree; meaningless where fewer follow."""
    if not len(buf):
        return np.zeros(0, dtype=np.int64)
    order, rank = suffix_array(buf)
    shared = common_prefixes(buf, order, rank, width)
    classes = np.empty(len(buf), dtype=np.int64)
    classes[order] = np.cumsum(shared < width)
    return classes
