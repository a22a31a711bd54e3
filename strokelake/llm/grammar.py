"""Token-id output compressed by Re-Pair grammars, one grammar per shard.

Documents are laid out in ascending ``doc_id`` order and cut into shards of whole documents. Within a shard
the frequent id pairs are replaced by nonterminals, again and again; rules, expansion lengths and the start of
each document among the symbols are stored, so one document can be decoded without the rest.

File format: Parquet rows (``part``, ``shard``, ``n_tokens``, ``doc_ids``, ``payload``); a payload is little-endian:
``SLG1``, then unsigned 32-bit counts (documents, rules, symbols, first nonterminal), the document starts among the
symbols (documents + 1 numbers), the rules (left and right numbers), the expansion lengths of the rules, and the
symbols (16-bit where all fit, else 32-bit).

Defined cases: null text counts as empty (only the end id); an empty table gives no shards and no rows;
repeated rows are documents of their own, next to each other; null ids come first; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strokelake.llm.common import release_memory, slices, texts
from strokelake.llm.tokens import STORE_LIMIT, encode_texts, gathered

MAGIC = b"SLG1"
CELLS = 18
SHARDS = "part int, shard int, n_tokens long, doc_ids array<long>, payload binary"


def replace_pairs(ids: np.ndarray, last: np.ndarray, first_new: int, least: int, most_rules: int):
    """Re-Pair in rounds, until no pair occurs ``least`` times or the rules are used up.

    Each round replaces every pair whose count is within a factor of 16 of the best (the best ones, where rules run short).

    ``last`` marks the last symbol of each document; no pair crosses it. Where chosen pairs overlap, the more
    frequent one wins, the left one in a run of one pair. Returns symbols, marks and rules.
    """
    rules: list[np.ndarray] = []
    new = first_new
    narrow = first_new + most_rules < 1 << 16  # then a pair fits 32 bits
    kind, shift = (np.uint32, 16) if narrow else (np.uint64, 32)
    none = kind((1 << 2 * shift) - 1)  # stands where no pair may be
    ids, ends = ids.astype(kind), np.flatnonzero(last)
    while len(ids) > 1 and new - first_new < most_rules:
        key = ids[:-1] << kind(shift)
        key |= ids[1:]
        inner = ends[ends < len(key)]
        key[inner] = none
        ordered = np.sort(key)[: len(key) - len(inner)]
        heavy = ordered[least - 1 :]
        heavy = heavy[heavy == ordered[: len(heavy)]]  # of a pair that occurs n times, n - least + 1 places
        if not len(heavy):
            break
        edge = np.append(0, np.flatnonzero(heavy[1:] != heavy[:-1]) + 1)
        count = np.diff(np.append(edge, len(heavy))) + least - 1
        floor = max(least, int(count.max()) // 16)
        keep = np.flatnonzero(count >= floor)
        left_over = most_rules - (new - first_new)
        if len(keep) > left_over:
            keep = np.sort(keep[np.argsort(-count[keep], kind="stable")[:left_over]])
        pairs, count = heavy[edge[keep]], count[keep]
        table = np.zeros(1 << CELLS, np.uint16 if narrow else np.int32)  # of two pairs in one cell the later waits for another round
        table[hashed(pairs)] = np.arange(1, len(pairs) + 1)
        at = table.take(hashed(key))
        spot = np.flatnonzero(at != 0)
        at = at[spot].astype(np.int32) - 1
        hit = pairs[at] == key[spot]
        spot, at = spot[hit], at[hit]
        order = np.empty(len(pairs), np.int32)  # 0: most frequent
        order[np.argsort(-count, kind="stable")] = np.arange(len(pairs), dtype=np.int32)
        take = chosen_places(spot, order[at])
        spot, at = spot[take], at[take]
        uses = np.bincount(at, minlength=len(pairs)) > 0
        used = np.flatnonzero(uses)
        ids[spot] = (new - 1 + np.cumsum(uses)).astype(kind)[at]
        stays = np.ones(len(ids), bool)
        stays[spot + 1] = False
        ids = ids[stays]
        ends -= np.searchsorted(spot, ends)  # every place before an end takes a symbol away
        found = pairs[used]
        rules.append(np.stack([found >> kind(shift), found & kind((1 << shift) - 1)], 1).astype(np.uint32))
        new += len(used)
    last = np.zeros(len(ids), bool)
    last[ends] = True
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return ids.astype(np.uint32), last, table


def hashed(pairs: np.ndarray) -> np.ndarray:
    if pairs.dtype == np.uint32:
        return (pairs * np.uint32(0x9E3779B1) >> np.uint32(32 - CELLS)).astype(np.intp)
    return (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CELLS)).astype(np.intp)


def chosen_places(spot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the ascending pair places to replace: of overlapping ones those of better rank than both
    neighbours; in a run of one pair every other place, from the left."""
    if not len(spot):
        return np.zeros(0, bool)
    touch = spot[1:] == spot[:-1] + 1
    take = np.ones(len(spot), bool)
    take[1:] &= ~(touch & (rank[1:] >= rank[:-1]))
    take[:-1] &= ~(touch & (rank[:-1] > rank[1:]))
    same = np.flatnonzero(touch & (rank[1:] == rank[:-1])) + 1  # places that go on with a run
    if len(same):
        head = np.flatnonzero(np.r_[True, same[1:] != same[:-1] + 1])
        step = np.arange(len(same)) - np.repeat(head, np.diff(np.r_[head, len(same)]))
        first = same[head] - 1
        odd = same[(step % 2 == 1) & np.repeat(take[first], np.diff(np.r_[head, len(same)]))]
        free = np.r_[touch, False][odd] & np.r_[take[1:], False][odd]
        take[odd[~free]] = True
    return take


def encode_shard(documents: list[bytes], least: int = 8, most_rules: int = 15_000) -> bytes:
    """Payload of one shard from the ids of its documents."""
    sizes = np.array([len(d) // 4 for d in documents], np.int64)
    ids = np.frombuffer(b"".join(documents), "<u4").astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    first_new = int(ids.max()) + 1 if len(ids) else 1
    symbols, marks, rules = replace_pairs(ids, last, first_new, least, most_rules)
    lengths = expansion_lengths(rules, first_new)
    ends = np.flatnonzero(marks) + 1
    starts = np.zeros(len(documents) + 1, np.int64)
    full = np.flatnonzero(sizes > 0)
    starts[full + 1] = ends
    starts = np.maximum.accumulate(starts)
    wide = "<u2" if first_new + len(rules) <= 1 << 16 else "<u4"
    head = np.array([len(documents), len(rules), len(symbols), first_new], "<u4")
    return b"".join(
        [MAGIC, head.tobytes(), starts.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(wide).tobytes()]
    )


def expansion_lengths(rules: np.ndarray, first_new: int) -> np.ndarray:
    """Ids behind each nonterminal; a rule names earlier nonterminals only."""
    out = [1] * len(rules)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - first_new] if a >= first_new else 1) + (out[b - first_new] if b >= first_new else 1)
    return np.array(out, np.int64)


class Shard:
    """A payload opened for reading."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a grammar shard")
        docs, rules, symbols, self.first_new = np.frombuffer(payload, "<u4", 4, 4).tolist()
        at = 20
        self.starts = np.frombuffer(payload, "<u4", docs + 1, at).astype(np.int64)
        at += 4 * (docs + 1)
        self.rules = np.frombuffer(payload, "<u4", 2 * rules, at).reshape(-1, 2)
        at += 8 * rules
        self.lengths = np.frombuffer(payload, "<u4", rules, at).astype(np.int64)
        at += 4 * rules
        self.symbols = np.frombuffer(payload, "<u2" if self.first_new + rules <= 1 << 16 else "<u4", symbols, at).astype(np.uint32)

    def sizes(self) -> np.ndarray:
        """Ids of each document, from the expansion lengths alone."""
        return np.diff(np.r_[0, np.cumsum(self.each(self.symbols))][self.starts])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids behind the symbols: the rules that these use are written out first, then every symbol takes its run of ids."""
        present = np.zeros(self.first_new + len(self.rules), bool)
        present[symbols] = True
        used = np.flatnonzero(present).astype(np.uint32)
        runs = used
        while (new := runs >= self.first_new).any():
            place = np.flatnonzero(new) + np.arange(int(new.sum()))  # place of the left part
            out = np.repeat(runs, new + 1)
            pair = self.rules[runs[new] - self.first_new]
            out[place], out[place + 1] = pair[:, 0], pair[:, 1]
            runs = out
        return gathered(runs, self.each(used), (np.cumsum(present) - 1)[symbols])[0]

    def each(self, symbols: np.ndarray) -> np.ndarray:
        """Number of ids behind each symbol."""
        return np.append(np.ones(self.first_new, np.int64), self.lengths)[symbols]

    def document(self, i: int) -> np.ndarray:
        """Ids of one document; the others are not touched."""
        return self.expand(self.symbols[self.starts[i] : self.starts[i + 1]])

    def documents(self) -> list[bytes]:
        ids = self.expand(self.symbols).astype("<u4").tobytes()
        ends = (4 * np.r_[0, np.cumsum(self.sizes())]).tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]


def write_grammar(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_ids: int = 1 << 18, stored_words: int = STORE_LIMIT) -> None:
    """All documents in ascending ``doc_id`` order as grammar shards of about ``shard_ids`` ids."""
    spark = docs.sparkSession
    source = texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    tie = F.xxhash64("text")  # rows of one id may be many: they spread and keep a fixed order
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(tasks, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)

    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        keys: list[int | None] = []
        size, shard = 0, 0

        def flush():
            nonlocal held, keys, size, shard
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([shard], pa.int32()),
                    pa.array([size], pa.int64()),
                    pa.array([keys], pa.list_(pa.int64())),
                    pa.array([encode_shard(held)], pa.binary()),
                ],
                names=["part", "shard", "n_tokens", "doc_ids", "payload"],
            )
            held, keys, size, shard = [], [], 0, shard + 1
            return row

        for batch in batches:
            for piece in slices(batch, 8 << 20):  # a word is looked up once in each piece
                for key, ids in zip(piece.column(0).to_pylist(), encode_texts(piece.column(1).to_pylist(), tokenizer, end_id, stored=stored_words)):
                    held.append(ids)
                    keys.append(key)
                    size += len(ids) // 4
                    if size >= shard_ids:
                        yield flush()
        if held:
            yield flush()
        release_memory()

    ordered.mapInArrow(run, SHARDS).write.parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """Ids before each shard: a prefix within each part, and one over the parts (one row per part)."""
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before_part"))
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("in_part", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
        .join(parts, "part")
        .select("part", "shard", (F.col("before_part") + F.col("in_part")).alias("shard_start"))
    )


def read_grammar(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32 (and ``ids`` as bytes on request)."""
    shards = spark.read.schema(SHARDS).parquet(path)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column(2)[i].as_py()
                found = Shard(batch.column(3)[i].as_buffer().to_pybytes()).documents()
                sizes = np.array([len(d) // 4 for d in found], np.int64)
                n = len(keys)
                arrays = [
                    pa.array([batch.column(0)[i].as_py()] * n, pa.int32()),
                    pa.array([batch.column(1)[i].as_py()] * n, pa.int32()),
                    pa.array(keys, pa.int64()),
                    pa.array(np.cumsum(sizes) - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(d) for d in found], pa.int64()),
                ]
                names = ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array(found, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    decoded = shards.select("part", "shard", "doc_ids", "payload").mapInArrow(run, schema)
    return decoded.join(shard_starts(shards), ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])
    )
