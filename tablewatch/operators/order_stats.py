"""Exact order statistics without sorting a column in one place.

Two tools:

``running_totals`` is a distributed prefix sum over sorted distinct values. Values are
cut into buckets at literal edges, each bucket is summed on its own, and the bucket
totals (at most ``buckets`` rows per key) are added back. Edges are literals, so a
retried task puts every value into the same bucket again.

``select_ranks`` finds the values at given ranks. It narrows an open interval around
every rank with sketches and verifies the interval by exact counts, so the table is
only scanned and never shuffled; the last interval holds at most ``MAX_INTERVAL`` rows.
A value that fills a large part of the column becomes an interval end and is counted
there, never collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .local_rows import constant_rows, union_all

# Largest number of rows ordered inside one task by select_ranks.
MAX_INTERVAL = 200_000
# Sketch resolution: rank error of percentile_approx is at most n / ACCURACY.
ACCURACY = 10_000
# Cut points are picked from one row in SAMPLE_ONE_IN. They only decide how the work is
# divided; everything counted or returned comes from all rows.
SAMPLE_ONE_IN = 16
# Columns searched in one scan.
COLUMNS_PER_SCAN = 16
# Distances from a wanted position at which cut points are proposed.
LADDER = (0.0004, 0.0015, 0.005, 0.02)


def default_buckets(spark: SparkSession) -> int:
    """Ordered parts grow with the parallelism the job is given, without a maximum."""
    return max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


@dataclass(frozen=True)
class Edges:
    """Ascending distinct cut points, and the values that fill a whole bucket or more."""

    cuts: tuple[float, ...]
    hot: tuple[float, ...] = ()


def edges_from(cuts: Sequence[float | None] | None) -> Edges:
    known = [float(c) for c in (cuts or []) if c is not None]
    distinct = sorted(set(known))
    hot = tuple(v for v in distinct if known.count(v) > 1)
    return Edges(tuple(distinct), hot)


def cut_probabilities(buckets: int) -> list[float]:
    return [i / buckets for i in range(1, buckets)]


def with_sample_flag(df: DataFrame) -> DataFrame:
    """Add ``_sampled``, true in one row of SAMPLE_ONE_IN."""
    return df.withColumn("_sampled", F.rand(17) < F.lit(1.0 / SAMPLE_ONE_IN))


def sampled(v: Column) -> Column:
    """The value in sampled rows, else null."""
    return F.when(F.col("_sampled"), v)


def bucket_edges(df: DataFrame, value: str, buckets: int | None = None) -> Edges:
    """One aggregate over the column; brings back at most ``buckets`` - 1 numbers."""
    n = buckets or default_buckets(df.sparkSession)
    cuts = F.percentile_approx(sampled(F.col(value)), F.lit(cut_probabilities(n)), 8 * n)
    row = with_sample_flag(df).agg(cuts.alias("cuts")).first()
    return edges_from(row["cuts"])


def with_position(
    df: DataFrame, found: Mapping[str, tuple[str, Sequence[float]]], inclusive: bool = True
) -> DataFrame:
    """Add columns {name: (value column, ascending cuts)}: the number of cuts <= the value
    (< without ``inclusive``).

    A binary search written as log2(cuts) small projections, so the compiled code stays
    small for any number of cuts.
    """
    steps = max((len(cuts).bit_length() for _, cuts in found.values()), default=0)
    padded = {
        name: F.lit([*cuts, *[math.inf] * (2**steps - 1 - len(cuts))]) for name, (_, cuts) in found.items()
    }
    out = df.withColumns({name: F.lit(0) for name in found})
    for i in reversed(range(steps)):
        step, moved = 2**i, {}
        for name, (value, _) in found.items():
            cut = F.get(padded[name], F.col(name) + (step - 1))
            past = F.col(value) >= cut if inclusive else F.col(value) > cut
            moved[name] = F.col(name) + F.when(past, F.lit(step)).otherwise(F.lit(0))
        out = out.withColumns(moved)
    return out


def running_totals(
    counts: DataFrame,
    value: str,
    sums: Sequence[str],
    edges: Edges,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add ``cum_<s>``: the total of ``s`` over all rows of the key up to this value.

    ``counts`` has one row per (keys, value).
    """
    bucketed = with_position(counts, {"_bucket": (value, edges.cuts)})
    within = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = bucketed.withColumns({f"_in_{s}": F.sum(s).over(within) for s in sums})

    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(*[F.sum(s).alias(f"_tot_{s}") for s in sums])
        .select(
            *keys,
            "_bucket",
            *[F.coalesce(F.sum(f"_tot_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        )
    )
    if not keys:
        # At most len(cuts) + 1 rows.
        offsets = F.broadcast(offsets)
    joined = local.join(offsets, [*keys, "_bucket"])
    return joined.withColumns({f"cum_{s}": F.col(f"_in_{s}") + F.col(f"_off_{s}") for s in sums}).drop(
        "_bucket", *[f"_in_{s}" for s in sums], *[f"_off_{s}" for s in sums]
    )


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def nearest(q: float) -> Callable[[int], int]:
    """Rank round((n - 1) * q), half away from zero."""
    return lambda n: min(n - 1, max(0, _half_up((n - 1) * q)))


def lower(q: float) -> Callable[[int], int]:
    return lambda n: math.floor(q * (n - 1))


def upper(q: float) -> Callable[[int], int]:
    return lambda n: math.ceil(q * (n - 1))


@dataclass
class _Search:
    """One rank and the open interval (low, high) it is known to lie in."""

    label: str
    name: str
    q: float
    rank: int = 0
    rows: int = 0
    low: float | None = None
    high: float | None = None
    below: int = 0  # rows up to and including ``low``
    inside: int = 0  # rows in the interval
    answer: float | None = None

    def holds(self, v: Column) -> Column:
        cond = v.isNotNull()
        if self.low is not None:
            cond = cond & (v > F.lit(self.low))
        if self.high is not None:
            cond = cond & (v < F.lit(self.high))
        return cond

    @property
    def open(self) -> bool:
        return self.answer is None and self.inside > 0


def _around(position: float) -> list[float]:
    """Positions at which cut points are asked for around a wanted one."""
    return [min(1.0, max(0.0, position + sign * d)) for d in LADDER for sign in (-1, 1)]


def _proposed(position: float, n: int, at: Mapping[float, float]) -> set[float]:
    """The two cut points that fit a sketch of n rows."""
    d = _margin(n)
    return {at[p] for p in (max(0.0, position - d), min(1.0, position + d)) if p in at}


def _locate(search: _Search, cuts: Sequence[float], count: Mapping[int, int]) -> None:
    """Narrow a search to the cut or the gap between cuts that holds its rank.

    Cells are numbered in order: 2 * i is the gap before cut i, 2 * i + 1 the cut itself.
    """
    passed = 0
    for cell in range(2 * len(cuts) + 1):
        here = count.get(cell, 0)
        if search.rank < passed + here:
            break
        passed += here
    at = cell // 2
    if cell % 2:
        search.answer = cuts[at]
    else:
        search.low = cuts[at - 1] if at else None
        search.high = cuts[at] if at < len(cuts) else None
        search.below, search.inside = passed, here


def _narrow(
    df: DataFrame, columns: Mapping[str, Column], searches: Sequence[_Search], ends: Mapping[str, set[float]]
) -> None:
    """Count columns between the proposed ends: one scan of them, a few rows of output."""
    cuts = {
        label: sorted(
            values
            | {x for s in searches if s.label == label for x in (s.low, s.high) if x is not None}
        )
        for label, values in ends.items()
    }
    labels = list(cuts)
    values = df.select(*[columns[label].alias(f"v{i}") for i, label in enumerate(labels)])
    placed = with_position(values, {f"i{i}": (f"v{i}", cuts[x]) for i, x in enumerate(labels)}, False)
    cells = []
    for i, label in enumerate(labels):
        at, v = F.col(f"i{i}"), F.col(f"v{i}")
        hit = F.coalesce(F.get(F.lit(cuts[label]), at) == v, F.lit(False)) if cuts[label] else F.lit(False)
        cells.append(
            F.struct(
                F.when(v.isNotNull(), F.lit(i)).alias("part"), (at * 2 + hit.cast("int")).alias("cell")
            )
        )
    rows = (
        placed.select(F.inline(F.array(*cells)))
        .where("part IS NOT NULL")
        .groupBy("part", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    counts: dict[str, dict[int, int]] = {label: {} for label in labels}
    for row in rows:
        counts[labels[row["part"]]][row["cell"]] = row["n"]
    for s in searches:
        _locate(s, cuts[s.label], counts[s.label])


def _margin(n: int) -> float:
    """Smallest ladder step that a sampled sketch of n rows is sure enough to hit."""
    error = 3 * 0.5 / math.sqrt(max(1, n // SAMPLE_ONE_IN)) + 1 / ACCURACY
    return next((d for d in LADDER if d >= error), LADDER[-1])


def select_ranks(
    df: DataFrame,
    columns: Mapping[str, Column],
    wanted: Mapping[str, Mapping[str, tuple[float, Callable[[int], int]]]],
) -> DataFrame:
    """Exact values at ranks of one or more columns: rows (label, name, n, value).

    ``columns`` maps a label to a double expression; nulls are skipped. ``wanted[label]``
    maps a result name to (q, rank function of n). An empty column gives null values.
    """
    searches = [
        _Search(label, name, q) for label, names in wanted.items() for name, (q, _) in names.items()
    ]
    for group in _batches(list(wanted), COLUMNS_PER_SCAN):
        _search(df, columns, [s for s in searches if s.label in group], wanted)
    size = {s.label: s.rows for s in searches}

    schema = "label STRING, name STRING, n BIGINT, value DOUBLE"
    settled = [(s.label, s.name, size[s.label], s.answer) for s in searches if not s.open]
    parts = [constant_rows(df.sparkSession, schema, settled)] if settled else []
    open_searches = [s for s in searches if s.open]
    if open_searches:
        parts.append(_order_intervals(df, columns, open_searches, size))
    return union_all(parts)


def _batches(items: list[str], size: int) -> list[set[str]]:
    return [set(items[i : i + size]) for i in range(0, len(items), size)]


def _search(df: DataFrame, columns: Mapping[str, Column], searches: list[_Search], wanted: Mapping) -> None:
    """Settle every search, or narrow it to at most MAX_INTERVAL rows."""
    labels = list(dict.fromkeys(s.label for s in searches))
    flagged = with_sample_flag(df)
    probs = {x: sorted({p for s in searches if s.label == x for p in _around(s.q)}) for x in labels}
    first: list[Column] = []
    for i, label in enumerate(labels):
        v = columns[label]
        first += [
            F.count(v).alias(f"n{i}"),
            F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}"),
            # One sketch per column serves all of its ranks.
            F.percentile_approx(sampled(v), F.lit(probs[label]), ACCURACY).alias(f"p{i}"),
        ]
    row = flagged.agg(*first).first()
    ends: dict[str, set[float]] = {}
    for i, label in enumerate(labels):
        n, at = row[f"n{i}"], dict(zip(probs[label], row[f"p{i}"] or []))
        ends[label] = set()
        for s in (x for x in searches if x.label == label):
            s.rows = s.inside = n
            if not n:
                continue
            s.rank = wanted[label][s.name][1](n)
            if s.rank in (0, n - 1):
                s.answer = row[f"lo{i}"] if s.rank == 0 else row[f"hi{i}"]
            else:
                ends[label] |= _proposed(s.q, n, at)

    while todo := [s for s in searches if s.open and s.inside > MAX_INTERVAL]:
        busy = {s.label for s in todo}
        before = {id(s): s.inside for s in todo}
        _narrow(df, columns, todo, {label: ends[label] for label in busy})
        todo = [s for s in todo if s.open and s.inside > MAX_INTERVAL]
        if not todo:
            break
        # Sketch the interval itself: all of its rows where the sample did not help.
        sketches, asked = [], []
        for i, s in enumerate(todo):
            v = F.when(s.holds(columns[s.label]), columns[s.label])
            v = v if s.inside > before[id(s)] // 4 else sampled(v)
            asked.append(sorted(set(_around((s.rank - s.below) / s.inside))))
            sketches.append(F.percentile_approx(v, F.lit(asked[i]), ACCURACY).alias(f"p{i}"))
        row = flagged.agg(*sketches).first()
        ends = {label: set() for label in busy}
        for i, s in enumerate(todo):
            at = dict(zip(asked[i], row[f"p{i}"] or []))
            ends[s.label] |= _proposed((s.rank - s.below) / s.inside, s.inside, at)


def _order_intervals(
    df: DataFrame, columns: Mapping[str, Column], searches: Sequence[_Search], size: Mapping[str, int]
) -> DataFrame:
    """Order the rows of each final interval (at most MAX_INTERVAL rows) and pick the ranks."""
    groups: dict[tuple, list[_Search]] = {}
    for s in searches:
        groups.setdefault((s.label, s.low, s.high), []).append(s)
    intervals = list(groups.values())
    entries, picks = [], []
    for i, members in enumerate(intervals):
        v = columns[members[0].label]
        entries.append(F.when(members[0].holds(v), F.struct(F.lit(i).alias("_part"), v.alias("value"))))
        picks += [(i, s.label, s.name, size[s.label], s.rank - s.below) for s in members]

    rows = (
        df.select(F.inline(F.array(*entries)))
        .where("_part IS NOT NULL")
        .groupBy("_part", "value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    upto = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_upto", F.sum("_n").over(upto))
    # One row per requested rank: the size of the request, not of the data.
    asked = F.broadcast(
        constant_rows(
            df.sparkSession, "_part INT, label STRING, name STRING, n BIGINT, _at BIGINT", picks
        )
    )
    return (
        ranked.join(asked, "_part")
        .where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at")))
        .select("label", "name", "n", "value")
    )
