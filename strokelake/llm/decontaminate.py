"""Benchmark decontamination by SimHash windows.

Texts and items are sequences of lower-case words. A document is compared with an item of n words through its
windows of n words: the SimHash of a window's 5-word shingles must lie within ``radius`` bits of the item's, found by
multi-index blocks (the 64 bits are cut into ``blocks`` parts; within the radius at least one part differs in at most
``radius // blocks`` bits, so looking up every such neighbour of a part misses no fingerprint), and then the exact weighted
shingle similarity (shared weight over total weight, shingles weighted by repeats) must reach ``threshold``.

Windows without a single shingle of an item of their size have similarity zero with every such item; they are not
fingerprinted. All sizes of windows at all other places are.

Items are grouped by size and held by every task: their total is checked against ``item_limit`` words, and a larger benchmark is
handled in slices of that size, one pass over the documents each.

Defined cases: null text counts as empty; items with fewer than five words are one shingle of their own
length, looked for at every word of every document; items without words match
nothing; repeated items and rows are handled one by one; documents shorter than an item have no window of its size;
empty tables give an empty result; other columns are not read (:func:`mark_leaks`) or kept (:func:`drop_leaks`).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from strokelake.llm.common import free_name, map_batches, texts, written

WORD = re.compile(r"\w+")
WIDTH = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc_id long, item_id long, first_word long, n_words long, distance int, similarity double"


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: str, hashes: WordHashes) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def shingles(each: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash for each run of ``width`` words (fewer words: one for all; none: none)."""
    if not len(each):
        return each
    n = max(1, len(each) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(width, len(each))):
        mixed = (mixed ^ each[i : i + n]) * MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
    return mixed


def simhash(hashes: np.ndarray) -> np.uint64:
    """Bit set where more than half of the hashes have it."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0]


def window_simhash(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the ``size`` shingles from each start, by prefix sums of bits."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:], dtype=np.int32)
    return np.packbits(2 * (sums[starts + size] - sums[starts]) > size, axis=1, bitorder="little").view("<u8")[:, 0]


def weighted_similarity(a: np.ndarray, b: Counter) -> float:
    """Shared over total weight of two shingle multisets."""
    own = Counter(a.tolist())
    shared = sum(min(n, b[x]) for x, n in own.items() if x in b)
    total = sum(own.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


class BlockIndex:
    """Multi-index over fingerprints: all within ``radius`` bits of a query are among its candidates."""

    def __init__(self, prints: np.ndarray, radius: int, blocks: int = 8):
        self.prints, self.radius = prints, radius
        width = 64 // blocks
        self.shifts = [np.uint64(width * b) for b in range(blocks)]
        self.mask = np.uint64((1 << width) - 1)
        near = radius // blocks
        distance = np.bitwise_count(np.arange(1 << width)[:, None] ^ np.arange(1 << width)[None, :])
        close = distance <= near
        # for each block and each value of it: which fingerprints have a neighbouring value there
        self.tables = [close[:, ((prints >> s) & self.mask).astype(np.int64)] for s in self.shifts]

    def query(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query rows, fingerprint rows and distances within the radius."""
        hit = np.zeros((len(prints), len(self.prints)), bool)
        for s, table in zip(self.shifts, self.tables):
            hit |= table[((prints >> s) & self.mask).astype(np.int64)]
        q, p = np.nonzero(hit)
        distance = np.bitwise_count(prints[q] ^ self.prints[p])
        ok = distance <= self.radius
        return q[ok], p[ok], distance[ok]


class ItemSet:
    """Items of one slice, by size."""

    def __init__(self, items: list[tuple[int, str]], radius: int, threshold: float):
        self.threshold = threshold
        hashes = WordHashes()
        sizes: dict[int, list] = defaultdict(list)
        for key, text in items:
            each = word_hashes(text or "", hashes)
            if len(each):
                sizes[len(each)].append((key, shingles(each)))
        #: Items below ``WIDTH`` words are one shingle of their own length: (shingles, their items) by length.
        self.short = {n: _by_shingle(sizes.pop(n)) for n in sorted(sizes) if n < WIDTH}
        self.sizes = {}
        for n, group in sorted(sizes.items()):
            prints = np.array([simhash(own) for _, own in group], np.uint64)
            known = np.unique(np.concatenate([own for _, own in group]))
            self.sizes[n] = [g[0] for g in group], [Counter(g[1].tolist()) for g in group], known, BlockIndex(prints, radius)
        self.known = np.unique(np.concatenate([s[2] for s in self.sizes.values()])) if self.sizes else np.zeros(0, np.uint64)

    def search(self, each: np.ndarray) -> list[tuple]:
        """Best window of each item that reaches the threshold: (item, first word, words, distance, similarity)."""
        out = []
        n_words = len(each)
        for n, (known, keys) in self.short.items():
            if n <= n_words:
                windows = shingles(each, n)
                hit = np.flatnonzero(_among(windows, known))
                places, first = np.unique(np.searchsorted(known, windows[hit]), return_index=True)
                out += [(key, int(hit[f]), n, 0, 1.0) for p, f in zip(places.tolist(), first.tolist()) for key in keys[p]]
        own = shingles(each)
        anchors = np.flatnonzero(_among(own, self.known)) if len(self.known) and n_words >= WIDTH else np.zeros(0, np.int64)
        if not len(anchors):
            return out
        for n, (keys, weights, known, index) in self.sizes.items():
            if n > n_words:
                continue
            size = n - WIDTH + 1
            at = anchors[_among(own[anchors], known)]
            if not len(at):
                continue
            cover = np.zeros(len(own) + 1, np.int64)  # windows that hold a shingle of an item
            np.add.at(cover, np.maximum(0, at - size + 1), 1)
            np.add.at(cover, np.minimum(at, len(own) - size) + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover)[: len(own) - size + 1] > 0)
            best: dict[int, tuple] = {}
            for low in range(0, len(starts), 4096):  # bounded memory for very long texts
                part = starts[low : low + 4096]
                first = int(part[0])
                hashes = own[first : int(part[-1]) + size]
                q, p, distance = index.query(window_simhash(hashes, part - first, size))
                for i, j, d in zip(q.tolist(), p.tolist(), distance.tolist()):
                    start = int(part[i])
                    found = weighted_similarity(own[start : start + size], weights[j])
                    if found >= self.threshold and (j not in best or (-found, start) < (-best[j][4], best[j][1])):
                        best[j] = (keys[j], start, n, d, found)
            out += best.values()
        return out


def _by_shingle(group: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, list[list[int]]]:
    found: dict[int, list[int]] = defaultdict(list)
    for key, own in group:
        found[int(own[0])].append(key)
    known = np.array(sorted(found), np.uint64)
    return known, [found[k] for k in known.tolist()]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def item_slices(items: DataFrame, item_limit: int):
    """Items in slices of at most ``item_limit`` words (a longer item is a slice of its own), streamed to the driver."""
    held, size = [], 0
    for key, text in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        words = len(WORD.findall(text or ""))
        if held and size + words > item_limit:
            yield held
            held, size = [], 0
        held.append((key, text))
        size += words
    yield held


def mark_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, radius: int = 23, item_limit: int = 500_000) -> DataFrame:
    """One row per document and item of similarity ``threshold`` or more: its best window.

    At similarity 0.8 two SimHashes differ in about 10 of 64 bits, rarely in more than 19; 23 leaves room.
    """
    source = texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    context = docs.sparkSession.sparkContext
    result = None
    for held in item_slices(items, item_limit):
        shared = context.broadcast((held, radius, threshold))

        def make(shared=shared):
            index = ItemSet(*shared.value)
            hashes = WordHashes()

            def step(cols):
                out = {n.split()[0]: [] for n in FOUND.split(", ")}
                for key, text in zip(cols["doc_id"], cols["text"]):
                    for row in index.search(word_hashes(text, hashes)):
                        for name, value in zip(out, (key, *row)):
                            out[name].append(value)
                return out

            return step

        found = map_batches(source, FOUND, make)
        result = found if result is None else result.union(found)
    return result


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents without any benchmark item; all columns stay."""
    own = free_name(docs, "_leak_id")
    leaks = written(mark_leaks(docs, items, **options), "leaks").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(leaks, docs["doc_id"].cast("long").eqNullSafe(F.col(own)), "left_anti")
