"""Greedy selection by rank inside each key, as rounds over grid cells.

"Take the best row, drop what conflicts with it, go on" is sequential as written.
Conflicts are local here (angles and positions within a reach), so rows are put into
grid cells as wide as the reach. Per round only the best undecided row of a cell matters;
one that beats the best of all neighbouring cells is final. A huge key is spread over its
cells, no pairs of a cell are formed, and all keys advance together.

A key with at most ``WHOLE`` rows in conflict needs no rounds: its rows pass through one task in
order of rank, each next to the kept rows of its own and the neighbouring cells only (kept rows do
not conflict, so a cell holds few). A chain of conflicts then costs one step a row instead of one
round a link; only larger keys take rounds. Both ways keep the same rows.

``greedy_owned`` takes keys with at most ``WHOLE`` rows at all straight there: one shuffle by key, no
copies in neighbouring cells, and the owner of each row is known as soon as its turn comes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from strokelake.session import cut

Conflict = Callable[[str, str], Column]
#: Rows in conflict of one key that a task decides in order; with coordinates some megabytes.
WHOLE = 50_000
#: Kept rows of a key that are looked through one by one; beyond that the neighbouring cells are.
FEW = 16


def with_cells(df: DataFrame, cells: Mapping[str, tuple[Column, float]]) -> DataFrame:
    return df.withColumns({c: F.floor(value / reach).cast("int") for c, (value, reach) in cells.items()})


def spread(df: DataFrame, cells: Sequence[str], steps: Sequence[tuple[int, ...]] | None = None) -> DataFrame:
    """Repeat each row in its own and the neighbouring cells (a fixed 3^d rows)."""
    steps = steps or list(product((-1, 0, 1), repeat=len(cells)))
    structs = ", ".join("struct(" + ", ".join(f"{v} AS _d{i}" for i, v in enumerate(step)) + ")" for step in steps)
    rows = df.select("*", F.expr(f"inline(array({structs}))"))
    moved = {c: F.col(c) + F.col(f"_d{i}") for i, c in enumerate(cells)}
    return rows.withColumns(moved).drop(*(f"_d{i}" for i in range(len(cells))))


def greedy_keep(
    df: DataFrame,
    keys: Sequence[str],
    rank: Column,
    columns: Sequence[str],
    cells: Mapping[str, tuple[Column, float]],
    conflict: Conflict,
    test: Callable[[tuple, tuple], bool] | None = None,
) -> DataFrame:
    """Rows kept by the greedy rule: ``keys``, ``_rank`` and ``columns`` (with their cells).

    ``rank`` must be unique inside a key, smaller is better. ``conflict(a, b)`` tests two rows
    whose columns carry the prefixes ``a`` and ``b``; rows in conflict lie in neighbouring cells.
    ``test(a, b)`` is the same test on the ``columns`` of two rows as tuples; without it all keys take rounds.
    """
    keys, columns, names = list(keys), list(columns), list(cells)
    place = keys + names
    rows = with_cells(df, cells).select(*place, rank.alias("_rank"), *columns)
    open_rows = cut(_in_conflict(rows, keys, names, columns, conflict))
    kept = rows.join(open_rows.select(*keys, "_rank"), [*keys, "_rank"], "left_anti").select(*place, "_rank", *columns)
    if test is not None:
        large = cut(open_rows.groupBy(*keys).count().where(F.col("count") > WHOLE).select(*keys))
        if large.isEmpty():
            return kept.unionByName(_decided(open_rows, keys, names, columns, test))
        kept = cut(kept.unionByName(_decided(open_rows.join(large, keys, "left_anti"), keys, names, columns, test)))
        open_rows = cut(open_rows.join(large, keys, "left_semi").select(*open_rows.columns))
    if open_rows.isEmpty():
        return kept
    rounds = 0
    while True:
        payload = F.struct("_rank", *columns)
        heads = open_rows.groupBy(*place).agg(F.min_by(payload, F.col("_rank")).alias("_h"))
        heads = heads.select(*place, "_h.*")
        best = spread(heads.select(*place, "_rank"), names).groupBy(*place).agg(F.min("_rank").alias("_best"))
        winners = heads.join(best, place).where(F.col("_rank") == F.col("_best")).drop("_best")
        kept = kept.unionByName(winners)
        strong = spread(winners, names).select(*place, *(F.col(c).alias(f"s_{c}") for c in ["_rank", *columns]))
        weak = open_rows.select(*place, *(F.col(c).alias(f"w_{c}") for c in ["_rank", *columns]))
        hit = (F.col("s__rank") == F.col("w__rank")) | conflict("s_", "w_")
        same = [weak[p] == strong[p] for p in place]
        left = weak.join(strong, [*same, hit], "left_anti")
        open_rows = cut(left.select(*place, *(F.col(f"w_{c}").alias(c) for c in ["_rank", *columns])))
        rounds += 1
        if open_rows.isEmpty():
            return kept
        if rounds % 8 == 0:
            kept = cut(kept)


def greedy_owned(
    df: DataFrame,
    keys: Sequence[str],
    derive: Callable[[DataFrame], DataFrame],
    rank: Column,
    columns: Sequence[str],
    cells: Mapping[str, tuple[Column, float]],
    conflict: Conflict,
    test: Callable[[tuple, tuple], bool],
    carry: Sequence[str],
) -> DataFrame:
    """Every row of ``df`` with the first kept row it conflicts with (itself when kept): ``keys``, ``columns``, ``owner_*``.

    ``derive`` adds the columns that ``df`` lacks; it runs after the shuffle. The rest is as for ``greedy_keep``.
    """
    keys, columns = list(keys), list(columns)
    large = cut(df.groupBy(*keys).count().where(F.col("count") > WHOLE).select(*keys))
    if large.isEmpty():
        return _walked(df, keys, derive, rank, columns, cells, test, carry)
    walked = _walked(df.join(large, keys, "left_anti"), keys, derive, rank, columns, cells, test, carry)
    rows = derive(df.join(large, keys, "left_semi"))
    kept = greedy_keep(rows, keys, rank, columns, cells, conflict, test)
    return walked.unionByName(greedy_owner(rows, kept, keys, rank, columns, cells, conflict, carry).select(*walked.columns))


def _walked(df, keys, derive, rank, columns, cells, test, carry) -> DataFrame:
    """Whole keys in order of rank, each row next to the rows kept before it."""
    names = list(cells)
    rows = with_cells(derive(df.repartition(*keys)), cells).select(*keys, *names, rank.alias("_rank"), *columns)
    ordered = rows.sortWithinPartitions(*keys, "_rank").drop("_rank")
    places = [columns.index(c) for c in carry]
    steps = list(product((-1, 0, 1), repeat=len(names)))
    owners = [f"owner_{c}" for c in carry]

    def run(batches):
        key, kept, kept_cells, grid = None, [], [], None
        for batch in batches:
            own, cell_of, values = ([batch.column(c).to_pylist() for c in part] for part in (keys, names, columns))
            found = []
            for k, cell, row in zip(zip(*own), zip(*cell_of), zip(*values)):
                if k != key:
                    key, kept, kept_cells, grid = k, [], [], None
                if None in row:  # an unknown place is near nothing
                    found.append(row)
                    continue
                if grid is None:
                    first = next((s for s in kept if test(s, row)), None)
                else:
                    near = (grid.get(tuple(c + d for c, d in zip(cell, step)), ()) for step in steps)
                    first = min((n for held in near for n in held if test(kept[n], row)), default=None)
                    first = None if first is None else kept[first]
                if first is None:
                    first = row
                    kept.append(row)
                    kept_cells.append(cell)
                    if grid is not None:
                        grid.setdefault(cell, []).append(len(kept) - 1)
                    elif len(kept) > FEW:
                        grid = {}
                        for n, held in enumerate(kept_cells):
                            grid.setdefault(held, []).append(n)
                found.append(first)
            arrays = [batch.column(c) for c in (*keys, *columns)]
            kinds = [batch.schema.field(columns[i]).type for i in places]
            arrays += [pa.array([s[i] for s in found], kind) for i, kind in zip(places, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, *columns, *owners])

    fields = [ordered.schema[c] for c in (*keys, *columns)]
    schema = StructType([*fields, *(StructField(o, ordered.schema[c].dataType) for o, c in zip(owners, carry))])
    return ordered.mapInArrow(run, schema)


def _decided(rows: DataFrame, keys: list[str], names: list[str], columns: list[str], test: Callable[[tuple, tuple], bool]) -> DataFrame:
    """The kept rows of whole keys, decided one after the other in order of rank."""
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "_rank")
    steps = list(product((-1, 0, 1), repeat=len(names)))

    def run(batches):
        key, grid = None, {}
        for batch in batches:
            own = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in keys]))
            cells = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]))
            values = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]))
            take = []
            for k, cell, row in zip(own, cells, values):
                if k != key:
                    key, grid = k, {}
                near = (grid.get(tuple(c + d for c, d in zip(cell, step))) for step in steps)
                free = not any(test(s, row) for found in near if found for s in found)
                take.append(free)
                if free:
                    grid.setdefault(cell, []).append(row)
            yield batch.filter(pa.array(take, pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema)


def _in_conflict(rows: DataFrame, keys: list[str], names: list[str], columns: list[str], conflict: Conflict) -> DataFrame:
    """Rows with at least one conflict; a semi-join stops at the first one it finds."""
    near = names[:2]
    other = spread(rows.select(*keys, *near, "_rank", *columns), near)
    other = other.select(*(F.col(c).alias(f"s_{c}") for c in [*keys, *near, "_rank", *columns]))
    mine = rows.select(*(F.col(c).alias(f"w_{c}") for c in [*keys, *names, "_rank", *columns]))
    same = [F.col(f"w_{c}") == F.col(f"s_{c}") for c in keys + near]
    differ = F.col("s__rank") != F.col("w__rank")
    hits = mine.join(other, [*same, differ & (conflict("s_", "w_") | conflict("w_", "s_"))], "left_semi")
    return hits.select(*(F.col(f"w_{c}").alias(c) for c in [*keys, *names, "_rank", *columns]))


def greedy_owner(
    df: DataFrame,
    kept: DataFrame,
    keys: Sequence[str],
    rank: Column,
    columns: Sequence[str],
    cells: Mapping[str, tuple[Column, float]],
    conflict: Conflict,
    carry: Sequence[str],
) -> DataFrame:
    """For every row the earliest kept row it conflicts with (itself when kept), as ``owner_*`` columns."""
    keys, columns, names = list(keys), list(columns), list(cells)
    place = keys + names
    rows = with_cells(df, cells).select(*place, rank.alias("w__rank"), *(F.col(c).alias(f"w_{c}") for c in columns))
    known = [c for c in columns if c in kept.columns]
    strong = spread(kept, names).select(*place, *(F.col(c).alias(f"s_{c}") for c in ["_rank", *known]))
    hit = (F.col("s__rank") == F.col("w__rank")) | ((F.col("s__rank") < F.col("w__rank")) & conflict("s_", "w_"))
    pairs = rows.join(strong, place).where(hit)
    chosen = pairs.groupBy(*keys, "w__rank").agg(
        F.first(F.struct(*(F.col(f"w_{c}").alias(c) for c in columns))).alias("_row"),
        F.min_by(F.struct(*(F.col(f"s_{c}").alias(f"owner_{c}") for c in carry)), F.col("s__rank")).alias("_own"),
    )
    return chosen.select(*keys, "_row.*", "_own.*")
