"""Deep-shallow suffix sorting of a few strings, and the cutting of texts into pieces for it (numpy only)."""

from __future__ import annotations

import numpy as np
import xxhash

GRAM = 32
STRIDE = 8
MIX = np.uint64(0xFF51AFD7ED558CCD)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place, by doubling."""
    table = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93)
    h = table[data]
    step = 1
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        h = h[:-step] * np.uint64(odd) + h[step:]
        step *= 2
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each place, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def cut_pieces(data: bytes, width: int, longest: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``width`` bytes with one minimizer: minimizer, first window, number of windows, and whether
    the minimizer's bytes occur twice in the piece (else no window of the piece equals another one of it).

    The minimizer, the least 32-byte hash inside a window, depends on the window's bytes alone: equal windows, wherever they
    are, have the same. ``longest`` bounds a run over repetitive text.
    """
    n = len(data) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none
    grams = gram_hashes(np.frombuffer(data, np.uint8))
    low = window_minimum(grams, width - GRAM + 1)
    starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    size = np.diff(np.r_[starts, n])
    if size.max() > longest:
        parts = -(-size // longest)
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        size_all = np.repeat(size, parts)
        starts = np.repeat(starts, parts) + at * longest
        size = np.minimum(longest, size_all - at * longest)
    span = width - GRAM + 1
    twice = np.zeros(len(starts), np.int64)
    for i, (a, n) in enumerate(zip(starts.tolist(), size.tolist())):
        x = a + int(grams[a : a + span].argmin())
        twice[i] = data.find(data[x : x + GRAM], x + 1, a + n + width - 1) >= 0
    return low[starts], starts, size, twice


def content(data: bytes | memoryview) -> tuple[int, int]:
    """128-bit hash of a piece as two signed numbers."""
    value = xxhash.xxh3_128_intdigest(data)
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place (by doubling over the binary digits of ``width``)."""
    table = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xA24BAED4963EE407)
    power, size = table[data], 1
    out, have = None, 0
    while True:
        if width & size:
            if out is None:
                out, have = power, size
            else:
                n = len(power) - have
                out = out[:n] * np.uint64(0x9FB21C651E98DF25) + power[have:] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * size)
                have += size
        if size * 2 > width:
            break
        mixed = power[:-size] * np.uint64(0xD6E8FEB86659FD93 + 2 * size) + power[size:]
        power = (mixed ^ (mixed >> np.uint64(31))) * MIX
        size *= 2
    return out ^ (out >> np.uint64(32))


class BlindTrie:
    """Suffixes of one buffer up to ``depth`` bytes; inner nodes keep only a branching depth and branching bytes.

    An insertion follows branching bytes to some leaf, compares once with that leaf, and splits where they differ. Suffixes
    that agree on all ``depth`` bytes share a leaf.
    """

    def __init__(self, data: bytes, depth: int):
        self.data, self.depth = data, depth
        self.root = None

    def insert(self, at: int) -> None:
        data, depth = self.data, self.depth
        if self.root is None:
            self.root = [at]
            return
        node = self.root
        while type(node) is tuple:
            child = node[1].get(data[at + node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        a, b = data[at : at + depth], data[node[0] : node[0] + depth]
        if a == b:
            node.append(at)
            return
        same = depth - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8
        parent, node = None, self.root
        while type(node) is tuple and node[0] < same:
            parent, node = node, node[1][data[at + node[0]]]
        if type(node) is tuple and node[0] == same:
            node[1][data[at + same]] = [at]
            return
        inner = (same, {b[same]: node, a[same]: [at]})
        if parent is None:
            self.root = inner
        else:
            parent[1][data[at + parent[0]]] = inner

    def in_order(self) -> tuple[list[int], list[int]]:
        """Suffixes in order, each with the bytes it shares with the one before (the first: 0)."""
        order, shared = [], []
        stack = [(self.root, 0)]
        while stack:
            node, lead = stack.pop()
            if type(node) is tuple:
                children = sorted(node[1].items())
                for i, (_, child) in reversed(list(enumerate(children))):
                    stack.append((child, lead if i == 0 else node[0]))
            else:
                order += node
                shared += [lead] + [self.depth] * (len(node) - 1)
        return order, shared


def deep_shallow(data: bytes, starts: np.ndarray, depth: int, shallow: int = 32, groups: np.ndarray | None = None):
    """Order of the suffixes at ``starts`` within their groups, compared on ``depth`` bytes, and the bytes each shares
    with its predecessor (at least ``shallow`` or 0 where it is less).

    Multikey quicksort by eight-byte letters to the shallow depth; each group that still agrees goes to a blind trie.
    All suffixes must have ``depth`` bytes.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    part = np.zeros(n, np.int64) if groups is None else np.unique(groups, return_inverse=True)[1]
    order = np.argsort(part, kind="stable")
    part = part[order]
    open_ = np.ones(n, bool)
    for at in range(0, shallow, 8):
        where = np.flatnonzero(open_)
        if not len(where):
            break
        places = starts[order[where]] + at
        word = np.zeros(len(where), np.uint64)
        for i in range(8):
            word = (word << np.uint64(8)) | raw[places + i]
        step = np.lexsort((word, part[where]))
        order[where], word = order[where][step], word[step]
        old = part[where]
        new = np.ones(len(where), bool)
        new[1:] = (old[1:] != old[:-1]) | (word[1:] != word[:-1])
        part[where] = where[np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))]
        alone = new & np.r_[new[1:], True]
        open_[where[alone]] = False
    shared = np.zeros(n, np.int64)
    where = np.flatnonzero(open_)
    if len(where):
        heads = np.flatnonzero(np.r_[True, part[where][1:] != part[where][:-1]])
        for a, b in zip(heads, np.r_[heads[1:], len(where)]):
            trie = BlindTrie(data, depth)
            places = starts[order[where[a:b]]]
            for p in places.tolist():
                trie.insert(p)
            found, lead = trie.in_order()
            by_place = {}
            for o, p in zip(order[where[a:b]].tolist(), places.tolist()):
                by_place.setdefault(p, []).append(o)
            order[where[a:b]] = [by_place[p].pop() for p in found]
            shared[where[a:b]] = lead
            shared[where[a]] = 0
    return order, shared


def repeated_windows(pieces: list[bytes], groups: np.ndarray, width: int) -> list[np.ndarray]:
    """Which windows of each piece occur in another place of the same group's pieces: a mask per piece.

    A hash per window leaves the windows that may repeat; runs of them that are equal as a whole repeat; what is
    left is decided by the suffix order.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    counts = np.maximum(0, sizes - width + 1)
    data = b"".join(pieces)
    offset = np.cumsum(sizes) - sizes
    base = np.cumsum(counts) - counts
    total = int(counts.sum())
    masks = np.zeros(total, bool)
    if total:
        owner = np.repeat(np.arange(len(pieces)), counts)
        place = np.arange(total) - base[owner] + offset[owner]
        key = window_hashes(np.frombuffer(data, np.uint8), width)[place]
        key = (key ^ groups[owner].astype(np.int64).view(np.uint64)) * MIX
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.searchsorted(twice, key)
            at[at == len(twice)] = 0
            may = np.flatnonzero(twice[at] == key)
            head = np.flatnonzero(np.r_[True, (may[1:] != may[:-1] + 1) | (owner[may[1:]] != owner[may[:-1]])])
            first = may[head]
            length = np.diff(np.r_[head, len(may)])
            seen: dict[tuple, list[int]] = {}
            for r, (w, size) in enumerate(zip(first.tolist(), length.tolist())):
                p = int(place[w])
                seen.setdefault((int(groups[owner[w]]), data[p : p + size + width - 1]), []).append(r)
            settled = np.zeros(len(first), bool)
            chosen = []
            for rows in seen.values():
                settled[rows] = len(rows) > 1
                chosen.append(rows[0])  # one of equal runs stands for all
            open_groups = set(groups[owner[first[~settled]]].tolist())
            chosen = np.array([r for r in sorted(chosen) if int(groups[owner[first[r]]]) in open_groups], np.int64)
            for r in np.flatnonzero(settled):
                masks[first[r] : first[r] + length[r]] = True
            if len(chosen):
                windows = np.concatenate([np.arange(first[r], first[r] + length[r]) for r in chosen])
                order, shared = deep_shallow(data, place[windows], width, groups=groups[owner[windows]])
                same = shared >= width
                hit = same | np.r_[same[1:], False]
                masks[windows[order[hit]]] = True
    return [masks[b : b + c] for b, c in zip(base.tolist(), counts.tolist())]
