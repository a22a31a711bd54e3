"""Conversation structure repair: cheapest edits to alternating turns, by a dynamic program over grammar-compressed sequences.

Each row becomes a symbol of role and fault. Rows of a conversation are taken in order and cut into chunks of ``CHUNK``
symbols, each with a summary that can be joined to its neighbour's. Re-Pair runs over all different chunks of the whole table:
in rounds, Spark counts the pairs, the frequent ones become rules, until no pair reaches ``LEAST`` uses. Every rule has one
min-plus matrix over the states of the role automaton; an entry holds the cost and a rope of edits that shares the ropes of
the rule's two parts. The matrices are built bottom-up once and serve all conversations; a chunk is the product of its
few remaining symbols, a conversation the product of its chunks.

Edits: Keep 0; Rerole to user or assistant 1; Delete 2, required for blank and duplicate rows; Insert an empty user or assistant
turn 5; a truncated row that stays costs 5 more. The result's role initials are ``(s?(ua)+)?``; among the cheapest edits the
ASCII-least list of initials wins. Inserts stand before the row they precede, so that edit lists of one part are never prefixes
of each other and the least of the parts is the least of the whole.

Large conversations: equal rows are counted before they are shuffled, chunks come from a range partitioning that cuts inside
a conversation, and no list of its rows is built. Only the SHA-256 of the repaired text is one stream by its nature: the rows
of a conversation pass through one task in order, one at a time, next to its edits (a byte a row, as in the result).

Defined cases: rows are taken by turn (nulls first), then role, then the SHA-256 of the text, so equal rows are neighbours; a null
role or text counts as one space; a null id is a conversation of its own; a null turn counts for no gap. Repeated input rows are
duplicates. An empty table gives no rows. A conversation without rows gets zeros, no edits and the hash of nothing. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, LongType, StringType
from pyspark.sql.pandas.types import to_arrow_schema

from strokelake.llm.common import slices, written

SPACES = " \t\n\x0b\x0c\r"
CHUNK = 512
#: Least uses of a pair that becomes a rule, rules per round and in all (a limit on compression only).
LEAST = 16
PER_ROUND = 256
MOST_RULES = 4096
FIRST_RULE = 0x4E00  # rules are characters from here on
#: Kept, truncated and removed rows by role initial; ``d`` is a row that must go.
OTHER = "x"
FAR = 1 << 60
STATES = range(4)  # nothing yet, after s, after u, after a
ROLE_STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Inserts that bring a state to an accepted end.
ENDING = {0: 0, 1: 2, 2: 1, 3: 0}
LEGAL = ("su", "ua", "au")


# ---- rows -----------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` (0: the row is gone) after the stated damage by crc32 of ``conv_id:turn``."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    case = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"),
    )


def as_given(rows: DataFrame) -> DataFrame:
    """The same columns for rows that are not damaged on purpose."""
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies")
    )


def digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def marked_rows(rows: DataFrame) -> DataFrame:
    """One row per different (conversation, turn, role, text): copies, blank, truncated, and whether it was seen before."""
    ink = F.rtrim(F.col("text"), F.lit(SPACES))
    slim = rows.select(
        "conv_id", "turn", F.when(F.col("copies") > 0, F.col("role")).alias("role"), F.when(F.col("copies") > 0, digest()).alias("digest"), "copies",
        (F.length(ink) == 0).alias("blank"), (~F.right(ink, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    gone = slim.where("copies = 0").select("conv_id").distinct().selectExpr("conv_id", "CAST(NULL AS LONG) AS turn", "CAST(NULL AS STRING) AS role", "CAST(NULL AS BINARY) AS digest", "0L AS copies", "false AS blank", "false AS cut")
    whole = slim.where("copies > 0").groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    whole = written(whole.unionByName(gone), "rows")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = whole.where("copies > 0 AND NOT blank").groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = whole["conv_id"].eqNullSafe(F.col("c")) & (whole["role"] == F.col("r")) & (whole["digest"] == F.col("d"))
    seen = F.coalesce(F.col("first") < turn, F.lit(False)).alias("seen")
    return written(whole.join(first, same, "left").select(*whole.columns, seen), "marked")


# ---- chunks ---------------------------------------------------------------------------------------------------------

SUMMARY = "part int, no int, symbols string, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long"


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks of symbols with summaries, in the order (part, no) inside a conversation."""
    key = rows.schema["conv_id"]
    schema = StructType([StructField("conv_id", key.dataType)] + StructType.fromDDL(SUMMARY).fields)
    out = to_arrow_schema(schema)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first()]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("digest")

    def run(batches):
        part, done, state = TaskContext.get().partitionId(), [], None
        no = 0

        def flush():
            nonlocal no
            done.append([state["conv"], part, no, "".join(state["symbols"]), *[state[c] for c in ("blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "turns")]])
            no += 1

        for batch in batches:
            for conv, turn, role, copies, blank, cut, seen in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        flush()
                    state = fresh(conv)
                while copies:
                    if state["size"] >= size:
                        flush()
                        state = fresh(conv)
                    taken = add_row(state, size, turn, role, copies, blank, cut, seen)
                    copies, seen = copies - taken, True
            while len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done[:1000]), out)], schema=out)
                del done[:1000]
        if state is not None:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)

    return written(ordered.mapInArrow(run, schema), "chunks")


def fresh(conv) -> dict:
    return {"conv": conv, "symbols": [], "size": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "head": None, "tail": None, "low": None, "high": None, "turns": 0}


def add_row(state: dict, size: int, turn, role: str, copies: int, blank: bool, cut: bool, seen: bool) -> int:
    """Add up to ``copies`` equal rows to an open chunk; how many found room."""
    n = min(copies, size - state["size"])
    state["size"] += n
    initial = role[:1]
    if state["head"] is None:
        state["head"] = initial
    else:
        state["illegal"] += state["tail"] + initial not in LEGAL
    state["illegal"] += n - 1  # an initial next to itself
    state["tail"] = initial
    if turn is not None and state["high"] != turn:
        state["turns"] += 1
        state["high"] = turn
        if state["low"] is None:
            state["low"] = turn
    here = initial if initial in ("s", "u", "a") else OTHER
    if blank:
        state["blank"] += n
        state["symbols"].append("d" * n)
    else:
        fresh_rows = 0 if seen else 1
        state["duplicate"] += n - fresh_rows
        if fresh_rows:
            state["truncated"] += cut
            state["symbols"].append(here.upper() if cut else here)
        state["symbols"].append("d" * (n - fresh_rows))
    return n


# ---- grammar --------------------------------------------------------------------------------------------------------


def rewrite(symbols: str, rounds: list[dict[str, str]]) -> str:
    """Apply the rules round by round, each from left to right."""
    for rules in rounds:
        if len(symbols) < 2:
            break
        out, at, end = [], 0, len(symbols)
        while at < end:
            new = rules.get(symbols[at : at + 2])
            out.append(symbols[at] if new is None else new)
            at += 1 if new is None else 2
        symbols = "".join(out)
    return symbols


def learn_grammar(table: DataFrame, least: int = LEAST, most_rules: int = MOST_RULES) -> list[dict[str, str]]:
    """Re-Pair over all different chunks, weighted by their number; the rules by round, pair to nonterminal.

    A round takes the pairs within a factor of 16 of the most used one. The driver holds the rules, at most ``most_rules``.
    """
    seqs = written(table.where(F.length("symbols") > 1).groupBy("symbols").count(), "sequences")
    rounds: list[dict[str, str]] = []
    made = 0
    while made < most_rules:

        def count(batches):
            found: Counter[str] = Counter()
            for batch in batches:
                for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for pair, uses in Counter(map(str.__add__, text, text[1:])).items():
                        found[pair] += n * uses
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pair", "n"])

        counted = seqs.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        top = counted.orderBy(F.col("n").desc(), "pair").limit(min(PER_ROUND, most_rules - made)).collect()
        if not top:
            break
        rules = {r.pair: chr(FIRST_RULE + made + i) for i, r in enumerate(r for r in top if r.n * 16 >= top[0].n)}
        made += len(rules)
        rounds.append(rules)

        def shorten(batches, step=[rules]):
            for batch in batches:
                texts = [rewrite(t, step) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1)], names=["symbols", "count"])

        seqs = written(seqs.mapInArrow(shorten, "symbols string, count long").where(F.length("symbols") > 1), "sequences")
    return rounds


# ---- ropes and matrices ---------------------------------------------------------------------------------------------


class Ropes:
    """Edit lists that share their parts: a node is a string, or a pair of nodes."""

    def __init__(self):
        self.nodes: list[str | tuple[int, int]] = []

    def add(self, node: str | tuple[int, int]) -> int:
        self.nodes.append(node)
        return len(self.nodes) - 1

    def leaves(self, node: int) -> Iterator[str]:
        stack = [node]
        while stack:
            at = self.nodes[stack.pop()]
            if isinstance(at, str):
                yield at
            else:
                stack += (at[1], at[0])

    def text(self, node: int) -> str:
        return "".join(self.leaves(node))

    def less(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        """Whether the list a[0] a[1] comes before b[0] b[1]; equal nodes at equal places are skipped whole."""
        left, right = [a[1], a[0]], [b[1], b[0]]
        x = y = ""
        while True:
            if not x and not y:
                while left and right and left[-1] == right[-1]:
                    left.pop(), right.pop()
            if not x:
                if not left:
                    return bool(y or right)
                x = self._next(left)
                continue
            if not y:
                if not right:
                    return False
                y = self._next(right)
                continue
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            x, y = x[n:], y[n:]

    def _next(self, stack: list[int]) -> str:
        """The next leaf, or nothing after opening one pair."""
        at = self.nodes[stack.pop()]
        if isinstance(at, str):
            return at
        stack += (at[1], at[0])
        return ""


Matrix = list  # 4 x 4 entries, each None or (cost, node)


def symbol_matrix(symbol: str, ropes: Ropes) -> Matrix:
    """Inserts before the row, then the row's own edit."""
    options: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(i: int, j: int, cost: int, edits: str) -> None:
        if (i, j) not in options or (cost, edits) < options[i, j]:
            options[i, j] = cost, edits

    role, stays = symbol.lower(), 5 if symbol.isupper() else 0
    for i in STATES:
        at, lead, cost = i, "", 0
        for _ in range(3):  # nothing, one or two inserted turns; a third never pays
            offer(i, at, cost + 2, lead + "D")
            if symbol != "d":
                if at in ROLE_STEP.get(role, {}):
                    offer(i, ROLE_STEP[role][at], cost + stays, lead + "K")
                offer(i, 3 if at == 2 else 2, cost + stays + 1, lead + "R")
            at, lead, cost = 3 if at == 2 else 2, lead + "I", cost + 5
    return [[(options[i, j][0], ropes.add(options[i, j][1])) if (i, j) in options else None for j in STATES] for i in STATES]


def product(a: Matrix, b: Matrix, ropes: Ropes) -> Matrix:
    """Min-plus product; among equal costs the ASCII-least list of edits."""
    out: Matrix = []
    for row in a:
        line = []
        for j in STATES:
            best, pair = FAR, None
            for k in STATES:
                x, y = row[k], b[k][j]
                if x is None or y is None:
                    continue
                cost = x[0] + y[0]
                if cost < best or (cost == best and pair is not None and ropes.less((x[1], y[1]), pair)):
                    best, pair = cost, (x[1], y[1])
            line.append(None if pair is None else (best, ropes.add(pair)))
        out.append(line)
    return out


def rule_matrices(rounds: list[dict[str, str]]) -> tuple[dict[str, Matrix], Ropes]:
    """Matrices of all symbols, bottom-up."""
    ropes = Ropes()
    found = {s: symbol_matrix(s, ropes) for s in "suaxSUAXd"}
    for rules in rounds:
        for pair, new in rules.items():
            found[new] = product(found[pair[0]], found[pair[1]], ropes)
    return found, ropes


def chunk_matrix(symbols: str, matrices: dict[str, Matrix], ropes: Ropes) -> tuple[list[int | None], list[str | None]]:
    """Costs and edits of one compressed chunk, 16 entries each."""
    if not symbols:
        return [0 if i == j else None for i in STATES for j in STATES], ["" if i == j else None for i in STATES for j in STATES]
    base = len(ropes.nodes)
    total = matrices[symbols[0]]
    for s in symbols[1:]:
        total = product(total, matrices[s], ropes)
    flat = [e for row in total for e in row]
    out = [None if e is None else e[0] for e in flat], [None if e is None else ropes.text(e[1]) for e in flat]
    del ropes.nodes[base:]  # keep the rules' ropes only
    return out


def solved_chunks(table: DataFrame, rounds: list[dict[str, str]]) -> DataFrame:
    """Chunks with ``costs`` and ``edits``; a task keeps the last few thousand different chunks it has solved."""
    schema = StructType(table.schema.fields + StructType.fromDDL("costs array<long>, edits array<string>").fields)
    matrices, ropes = rule_matrices(rounds)

    def run(batches):
        memo: dict[str, tuple] = {}
        for batch in batches:
            got = []
            for text in batch.column(batch.schema.get_field_index("symbols")).to_pylist():
                if text not in memo:
                    if len(memo) >= 4096:
                        memo.clear()
                    memo[text] = chunk_matrix(rewrite(text, rounds), matrices, ropes)
                got.append(memo[text])
            more = [pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "costs", "edits"])

    return table.mapInArrow(run, schema)


# ---- conversations --------------------------------------------------------------------------------------------------


class Fold:
    """The chunks of one conversation, joined in order, then its rows."""

    def __init__(self, keep: bool = False):
        self.kept: list[tuple] | None = [] if keep else None
        self.counts = Counter({"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0})
        self.tail = self.low = self.high = None
        self.turns = 0
        self.state: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self.audit: str | None = None
        self.cost = 0
        self.at = 0
        self.want = "u"
        self.begun = False
        self.place = 0
        self.hash = hashlib.sha256()

    def join(self, c: dict) -> None:
        self.counts.update({k: c[k] for k in ("blank", "duplicate", "truncated", "illegal")})
        if c["head"] is not None:
            if self.tail is not None:
                self.counts["illegal"] += self.tail + c["head"] not in LEGAL
            self.tail = c["tail"]
        if c["low"] is not None:
            self.turns += c["turns"] - (self.high == c["low"])
            self.low = c["low"] if self.low is None else self.low
            self.high = c["high"]
        new: list[tuple[int, str] | None] = []
        for j in STATES:
            options = [(x[0] + c["costs"][4 * i + j], i) for i, x in enumerate(self.state) if x and c["costs"][4 * i + j] is not None]
            least = min((o[0] for o in options), default=None)
            new.append(min(((cost, self.state[i][1] + c["edits"][4 * i + j]) for cost, i in options if cost == least), default=None))
        self.state = new

    def settle(self) -> None:
        """The cheapest way to an accepted end."""
        ends = [(x[0] + 5 * ENDING[i], x[1] + "I" * ENDING[i]) for i, x in enumerate(self.state) if x]
        self.cost, self.audit = min(ends)

    def write(self, edit: str, turn: int | None, role: str, text: str) -> None:
        if self.kept is not None:
            self.kept.append((self.place, turn, role, text, edit))
            self.place += 1
        self.hash.update((("\n" if self.begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.begun = True
        self.want = "a" if role[:1] == "u" else "u"

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.write("I", None, self.turn_role(), "")
            self.at += 1

    def turn_role(self) -> str:
        return "user" if self.want == "u" else "assistant"

    def row(self, turn: int | None, role: str, text: str, copies: int) -> None:
        """Edit equal rows of the text table."""
        if self.audit is None:
            self.settle()
        for _ in range(copies):
            self.inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                self.write(edit, turn, role if edit == "K" else self.turn_role(), text)

    def result(self) -> list:
        if self.audit is None:
            self.settle()
        self.inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, *[self.counts[k] for k in ("blank", "duplicate", "truncated", "illegal")], self.cost, self.audit, self.hash.hexdigest()]


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per conversation: conv_id, gaps, faults, cost, audit (edit initials) and the SHA-256 of the repaired ``role:text`` lines.

    ``rows`` has conv_id, turn, role, text and copies, as made by ``damaged`` or ``as_given``.
    """
    key = rows.schema["conv_id"].dataType
    numbers = [StructField(c, LongType()) for c in NUMBERS]
    schema = StructType([StructField("conv_id", key), *numbers, StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    return streamed(rows, chunk).mapInArrow(lambda batches: emitted(folds(batches, False), to_arrow_schema(schema), lambda conv, fold, end: [[conv, *fold.result()]] if end else []), schema)


def repaired_rows(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (from 0), turn (null: inserted), role, text, edit."""
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType)] + StructType.fromDDL("place long, turn long, role string, text string, edit string").fields)

    def taken(conv, fold: Fold, end: bool):
        if end:
            fold.result()
        out, fold.kept = [[conv, *r] for r in fold.kept], []
        return out

    return streamed(rows, chunk).mapInArrow(lambda batches: emitted(folds(batches, True), to_arrow_schema(schema), taken), schema)


def streamed(rows: DataFrame, chunk: int) -> DataFrame:
    """Solved chunks and then the rows of each conversation, in order."""
    table = chunks(marked_rows(rows), chunk)
    told = solved_chunks(table, learn_grammar(table)).drop("symbols").withColumn("tag", F.lit(0))
    lines = rows.where("copies > 0").select("conv_id", "turn", "role", "text", digest().alias("digest"), "copies", F.lit(1).alias("tag"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "tag", "part", "no", "turn", "role", "digest")]
    return told.unionByName(lines, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*order).drop("digest")


def folds(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[tuple]:
    """(conversation, fold, whether it is complete), after each row and at the end."""
    conv, fold = None, None
    for batch in batches:
        for part in slices(batch):
            for r in part.to_pylist():
                if fold is None or r["conv_id"] != conv:
                    if fold is not None:
                        yield conv, fold, True
                    conv, fold = r["conv_id"], Fold(keep)
                if r["tag"] == 0:
                    fold.join(r)
                else:
                    fold.row(r["turn"], r["role"], r["text"], r["copies"])
                    if keep:
                        yield conv, fold, False
    if fold is not None:
        yield conv, fold, True


def emitted(found: Iterator[tuple], schema: pa.Schema, take) -> Iterator[pa.RecordBatch]:
    done: list[list] = []
    for conv, fold, end in found:
        done += take(conv, fold, end)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done = []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def longer(value: str, cost: int | str, edits: str) -> str:
    """SQL: a ten-digit cost and its edits, both extended; null stays null."""
    return f"(lpad(CAST(CAST(left({value}, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({value}, 11) || '{edits}')"


ORACLE = rf"""
WITH RECURSIVE bits AS (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i)
), crc AS (SELECT list(c ORDER BY i) AS tab FROM bits
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda s: CAST(ascii(s) AS BIGINT)) AS codes
  FROM conversations
), coded AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit
  FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE hit <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k, regexp_extract(text, '([^ 	-
])[ 	-
]*\z', 1) AS final
  FROM damaged
), faulty AS (
  SELECT *, left(role, 1) AS ini, final = '' AS blank, final <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS twice
  FROM placed
), marked AS (
  SELECT *, blank OR twice AS must, NOT blank AND NOT twice AND final NOT IN ('.', '!', '?') AS cut,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM faulty
), steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, '0000000000' AS p0, CAST(NULL AS VARCHAR) AS p1, CAST(NULL AS VARCHAR) AS p2, CAST(NULL AS VARCHAR) AS p3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, k, {longer('e0', 2, 'D')},
    least({longer('e1', 2, 'D')}, CASE WHEN NOT must AND ini = 's' THEN {longer('e0', 'stays', 'K')} END),
    least({longer('e2', 2, 'D')}, CASE WHEN must THEN NULL WHEN ini = 'u' THEN {longer('least(e0, e1, e3)', 'stays', 'K')} ELSE {longer('least(e0, e1, e3)', 'stays + 1', 'R')} END),
    least({longer('e3', 2, 'D')}, CASE WHEN must THEN NULL WHEN ini = 'a' THEN {longer('e2', 'stays', 'K')} ELSE {longer('e2', 'stays + 1', 'R')} END)
  FROM (
    SELECT s.conv_id, m.k, must, ini, CASE WHEN cut THEN 5 ELSE 0 END AS stays, p0 AS e0, p1 AS e1,
      least(p2, {longer('p0', 5, 'I')}, {longer('p1', 5, 'I')}, {longer('p3', 5, 'I')}) AS e2, least(p3, {longer('p2', 5, 'I')}, {longer('p0', 10, 'II')}, {longer('p1', 10, 'II')}) AS e3
    FROM steps s JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.k = s.k + 1)
), solved AS (
  SELECT conv_id, least(p0, p3, {longer('p2', 5, 'I')}, {longer('p1', 10, 'II')}) AS found
  FROM steps s WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.k = s.k + 1)
), letters AS (
  SELECT conv_id, i, substr(found, CAST(i AS INTEGER) + 10, 1) AS e, sum(CASE WHEN substr(found, CAST(i AS INTEGER) + 10, 1) <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS k
  FROM (SELECT conv_id, found, unnest(range(1, length(found) - 9)) AS i FROM solved)
), kept AS (
  SELECT l.conv_id, l.i, l.e, m.role, m.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.i) - 1 AS p
  FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.k = l.k AND l.e <> 'I' WHERE l.e <> 'D'
), opened AS (
  SELECT *, max(CASE WHEN p = 0 AND e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS shift FROM kept
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role || ':' || text ELSE CASE WHEN (p - shift) % 2 = 0 THEN 'user:' ELSE 'assistant:' END || CASE WHEN e = 'I' THEN '' ELSE text END END, chr(10) ORDER BY i) AS lines
  FROM opened GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (twice) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
)
SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(left(found, 10) AS BIGINT) AS cost, substr(found, 11) AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM solved s LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM s.conv_id
"""
