"""Exact quantiles and order statistics with bounded memory per task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, and
sketches are not exact. Here a sketch proposes a bracket around the wanted rank,
counting proves it, and only when few enough values lie inside it does
``percentile`` run on those. Every step is one aggregate over the table that
returns one row; nothing is sorted or shuffled. If the first proven brackets
still hold too many values, these values alone are written and searched
further, so the input is read three times whatever its size; again only where
a sketch missed, which the counts show.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..defaults import ORDER
from ..functions.calendar import micros
from ..functions.numeric import bounded, count_if
from .scale import written

# Values that one exact ``percentile`` buffer may hold.
EXACT_VALUES = 20_000
# Sketch size, and the rank distance kept between the wanted rank and a bracket end.
# A sketch of this size is off by about 0.002 in rank; counting catches the rest.
SKETCH_SIZE = 2_048
SLACK = 0.004


def _between(column: Column, low, high) -> Column:
    return F.when(column.between(F.lit(low), F.lit(high)), column)


@dataclass
class _Search:
    """One wanted rank among the non-null values of a column; ``rank`` may be fractional."""

    column: Column
    whole: bool
    rank: float
    low: float
    high: float
    inside: int
    total: int
    below: int = 0
    distinct: float = math.inf
    answer: float | None = None
    slack: float = SLACK
    #: Whether the bracket was written, and how many values lie below it then.
    written: bool = False
    left_out: int = 0

    @property
    def first(self) -> int:
        return math.floor(self.rank)

    @property
    def second(self) -> int:
        return min(math.ceil(self.rank), self.total - 1)

    def values(self, low=None, high=None) -> Column:
        if low is None and self.inside == self.total:
            return self.column
        return _between(self.column, *((self.low, self.high) if low is None else (low, high)))

    def ready(self, limit: int) -> bool:
        return self.answer is not None or min(self.inside, self.distinct) <= limit

    def reach(self) -> tuple[float, float]:
        """Ranks, relative to the bracket, that the next bracket should span."""
        return (
            max(0.0, (self.first - self.below) / self.inside - self.slack),
            min(1.0, (self.second + 1 - self.below) / self.inside + self.slack),
        )

    def accept(self, low, high, below, inside, distinct, last, following) -> None:
        """Use the counts of a proposed bracket."""
        if below <= self.first and self.second < below + inside:
            if inside == self.inside:
                self.slack = 1.0
            self.low, self.high, self.below, self.inside, self.distinct = low, high, below, inside, distinct
            if low == high:
                self.answer = low
        elif self.slack < 1.0:
            self.slack = min(1.0, self.slack * 8)
        elif self.first == below + inside - 1:
            # The two neighbouring ranks lie on both sides of the middle.
            self.answer = last + (following - last) * (self.rank - self.first)
        else:
            # The lower half was proposed, so the rank lies above it.
            self.inside -= below + inside - self.below
            self.low, self.below, self.distinct = following, below + inside, math.inf


def _first_row(df: DataFrame, columns: Sequence[Column]):
    return df.agg(*[c.alias(f"_{i}") for i, c in enumerate(columns)]).first()


def _sketch(values: Column, ranks: Sequence[float], whole: bool) -> Column:
    """Approximate values at the given ranks, from one sketch."""
    build, read = (
        (F.kll_sketch_agg_bigint, F.kll_sketch_get_quantile_bigint)
        if whole
        else (F.kll_sketch_agg_double, F.kll_sketch_get_quantile_double)
    )
    found = read(build(values, SKETCH_SIZE), F.array(*[F.lit(float(r)) for r in ranks]))
    # An empty sketch cannot be read.
    return F.when(F.count(values) > 0, found)


def _half(s: _Search):
    half = (s.high - s.low) // 2 if s.whole else s.high / 2 - s.low / 2
    return s.low, s.low + half


def _narrow(df: DataFrame, searches: list[_Search], limit: int, brackets: list | None) -> None:
    """One refinement: propose a bracket per search, then use it only as far as the counts prove it."""
    if brackets is None:
        by_sketch = [s for s in searches if s.slack < 1.0]
        proposals = {}
        if by_sketch:
            row = _first_row(df, [_sketch(s.values(), s.reach(), s.whole) for s in by_sketch])
            proposals = {id(s): p for s, p in zip(by_sketch, row)}
        brackets = [proposals[id(s)] if id(s) in proposals else _half(s) for s in searches]
    checks = []
    for s, (low, high) in zip(searches, brackets):
        candidates = s.values(low, high)
        # Distinct values matter only if the bracket may still hold too many rows.
        many = s.inside * (s.slack * 4) > limit
        checks += [
            count_if(s.column < F.lit(low)),
            F.count(candidates),
            F.approx_count_distinct(candidates) if many else F.lit(None),
            # The values next to the bracket's end are needed only when halving.
            F.max(F.when(s.column <= F.lit(high), s.column)) if s.slack >= 1.0 else F.lit(None),
            F.min(F.when(s.column > F.lit(high), s.column)) if s.slack >= 1.0 else F.lit(None),
        ]
    counts = _first_row(df, checks)
    for i, (s, (low, high)) in enumerate(zip(searches, brackets)):
        below, inside, distinct, last, following = counts[5 * i : 5 * i + 5]
        s.accept(low, high, below + s.left_out, inside, math.inf if distinct is None else distinct, last, following)


def _brackets(searches: Sequence[_Search]) -> dict[tuple, list[_Search]]:
    """Searches by what they have left to look at; those that share it share one buffer."""
    groups: dict[tuple, list[_Search]] = {}
    for s in searches:
        groups.setdefault((id(s.column), s.low, s.high), []).append(s)
    return groups


def _write_brackets(df: DataFrame, groups: Sequence[list[_Search]]) -> DataFrame:
    """Write the values inside the brackets; their searches go on with that table."""
    cells = [F.struct(F.lit(i).alias("bracket"), g[0].values().alias("value")) for i, g in enumerate(groups)]
    kept = df.select(F.explode(F.filter(F.array(*cells), lambda c: c["value"].isNotNull())).alias("c"))
    kept = written(kept.select("c.bracket", "c.value"), "brackets")
    for i, group in enumerate(groups):
        column = F.when(F.col("bracket") == i, F.col("value"))
        for s in group:
            s.column, s.written, s.left_out = column, True, s.below
    return kept


def _search(df: DataFrame, searches: list[_Search], limit: int, proposed: dict[int, tuple] | None = None) -> DataFrame:
    """Refine until every bracket is small enough; returns the table of written brackets, else ``df``."""
    waiting = [s for s in searches if not s.ready(limit)]
    while waiting:
        _narrow(df, waiting, limit, [proposed[id(s)] for s in waiting] if proposed else None)
        proposed = None
        waiting = [s for s in waiting if not s.ready(limit)]
        if waiting and not waiting[0].written:
            small = [s for s in searches if s.ready(limit) and s.answer is None and s.inside <= limit]
            groups = list(_brackets(waiting + small).values())
            # No more is written than half a column.
            if sum(g[0].inside for g in groups) <= max(s.total for s in waiting) / 2:
                df = _write_brackets(df, groups)
    return df


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column] | Sequence[str],
    probabilities: Sequence[float],
    limit: int = EXACT_VALUES,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column, as numbers (runs actions).

    Like ``DataFrame.approxQuantile`` but exact. A column without values gives
    ``None`` for every probability.
    """
    if not isinstance(columns, Mapping):
        columns = {c: F.col(c) for c in columns}
    # NaN and infinities have no place among quantiles, and a bracket that ends in one could not be halved.
    columns = {n: bounded(c.cast("double")) for n, c in columns.items()}
    ends = [(max(0.0, p - SLACK), min(1.0, p + SLACK)) for p in probabilities]
    flat_ends = [r for pair in ends for r in pair]
    # One pass finds how many values there are and where the ranks roughly lie.
    start = _first_row(
        df,
        [
            e
            for c in columns.values()
            for e in (F.count(c), F.min(c), F.max(c), _sketch(c, flat_ends, whole=False))
        ],
    )
    searches: dict[str, list[_Search]] = {}
    proposed: dict[int, tuple] = {}
    for i, (name, c) in enumerate(columns.items()):
        total, low, high, sketch = start[4 * i : 4 * i + 4]
        searches[name] = []
        for j, p in enumerate(probabilities if total else ()):
            s = _Search(c, False, p * (total - 1), low, high, total, total, answer=low if low == high else None)
            proposed[id(s)] = (sketch[2 * j], sketch[2 * j + 1])
            searches[name].append(s)
    everyone = [s for group in searches.values() for s in group]
    _finish(df, _search(df, everyone, limit, proposed), everyone)
    return {n: [s.answer for s in group] or [None] * len(probabilities) for n, group in searches.items()}


def _finish(df: DataFrame, brackets: DataFrame, everyone: Sequence[_Search]) -> None:
    """Exact answers from the values that the searches have left: one aggregate of the table, one of the written brackets."""
    for is_written, source in ((True, brackets), (False, df)):
        groups = _brackets([s for s in everyone if s.answer is None and s.written == is_written])
        if not groups:
            continue
        finals = []
        for members in groups.values():
            spots = [(m.rank - m.below) / (m.inside - 1) if m.inside > 1 else 0.0 for m in members]
            finals.append(F.percentile(members[0].values(), F.array(*[F.lit(min(1.0, x)) for x in spots])))
        for members, results in zip(groups.values(), _first_row(source, finals)):
            for s, value in zip(members, results):
                s.answer = value


def bracketed_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probabilities: Sequence[float],
    ends: Mapping[str, Sequence[tuple[float, float]] | None],
    limit: int = EXACT_VALUES,
) -> dict[str, list[float | None]]:
    """Exact quantiles of number columns whose brackets (``ends``, a pair per probability) are known beforehand (runs actions).

    One pass counts the values below each bracket and writes those inside. A
    column that has no brackets, or one that its values are not in, is searched
    by :func:`exact_quantiles`.
    """
    guessed = [(n, j, low, high) for n in columns if ends.get(n) for j, (low, high) in enumerate(ends[n])]
    answers: dict[str, list[float | None]] = {}
    if guessed:
        cells, measures = [], []
        for i, (n, _, low, high) in enumerate(guessed):
            inside = _between(columns[n], low, high)
            cells.append(F.struct(F.lit(i).alias("bracket"), inside.alias("value")))
            measures += [
                F.count(columns[n]).alias(f"total_{i}"), count_if(columns[n] < F.lit(low)).alias(f"below_{i}"), F.count(inside).alias(f"inside_{i}"),
                F.min(inside).alias(f"low_{i}"), F.max(inside).alias(f"high_{i}"),
            ]
        # The counts belong to the tasks that write: a task that runs again is counted once.
        seen = Observation()
        kept = df.observe(seen, *measures).select(F.explode(F.filter(F.array(*cells), lambda c: c["value"].isNotNull())).alias("c"))
        kept = written(kept.select("c.bracket", "c.value"), "brackets")
        counts = seen.get
        found: dict[str, list[_Search]] = {}
        for i, (n, j, *_) in enumerate(guessed):
            total, below, inside = (counts[f"{k}_{i}"] for k in ("total", "below", "inside"))
            low, high = counts[f"low_{i}"], counts[f"high_{i}"]
            s = _Search(F.when(F.col("bracket") == i, F.col("value")), False, probabilities[j] * (total - 1), low, high, inside, total)
            s.below = s.left_out = below
            s.written = True
            s.answer = low if low == high else None
            found.setdefault(n, []).append(s)
        for n, group in found.items():
            if group[0].total == 0:
                answers[n] = [None] * len(probabilities)
            elif all(s.below <= s.first and s.second < s.below + s.inside for s in group):
                answers[n] = []
        everyone = [s for n, group in found.items() if answers.get(n) == [] for s in group]
        _finish(df, _search(kept, everyone, limit), everyone)
        for n in [n for n in found if answers.get(n) == []]:
            answers[n] = [s.answer for s in found[n]]
    rest = {n: c for n, c in columns.items() if n not in answers}
    if rest:
        answers |= exact_quantiles(df, rest, probabilities, limit)
    return {n: answers[n] for n in columns}


def kth_value(df: DataFrame, column: Column, k: int, limit: int = EXACT_VALUES) -> tuple[int, int]:
    """The value at 0-based rank ``k`` of a bigint column, and how many rows lie below it (runs actions)."""
    total, low, high = _first_row(df, [F.count(column), F.min(column), F.max(column)])
    s = _Search(column, True, k, low, high, total, total, answer=low if low == high else None)
    df = _search(df, [s], limit)
    if s.answer is not None:
        return int(s.answer), s.left_out + df.agg(count_if(s.column < F.lit(s.answer))).first()[0]
    # At most ``limit`` distinct values are left, so one window over their counts is bounded.
    counts = df.select(s.values().alias("v")).where("v IS NOT NULL").groupBy("v").count()
    before = F.coalesce(
        F.sum("count").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ) + F.lit(s.below)
    row = counts.select("v", before.alias("b")).where(F.col("b") <= k).agg(F.max(F.struct("b", "v"))).first()[0]
    return row["v"], row["b"]


def first_rows(df: DataFrame, n: int, order: Sequence[str] = ORDER, limit: int = EXACT_VALUES) -> Column:
    """Predicate true for the first ``n`` rows by ``order`` (timestamp, then a unique bigint).

    Finds the boundary key by rank search instead of numbering every row. Rows
    without a timestamp come first, in order of the number. Never NULL. Runs actions.
    """
    if n <= 0:
        return F.lit(False)
    ts, tie = order
    undated = F.col(ts).isNull()
    without = df.where(undated).count()
    if n <= without:
        last, _ = kth_value(df.where(undated), F.col(tie).cast("bigint"), n - 1, limit)
        return F.coalesce(undated & (F.col(tie) <= F.lit(last)), F.lit(False))
    n -= without
    instant, below = kth_value(df, micros(F.col(ts)), n - 1, limit)
    at = df.where(micros(F.col(ts)) == F.lit(instant))
    last_tie, _ = kth_value(at, F.col(tie).cast("bigint"), n - 1 - below, limit)
    edge = F.lit(str(datetime(1970, 1, 1) + timedelta(microseconds=instant))).cast("timestamp_ntz")
    return undated | F.coalesce((F.col(ts) < edge) | ((F.col(ts) == edge) & (F.col(tie) <= F.lit(last_tie))), F.lit(False))
