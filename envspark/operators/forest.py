"""Isolation forest on one column: grown on small samples, scored on every row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .scale import least_tickets

_EULER = 0.5772156649015329


def expected_path(n) -> np.ndarray:
    """Average path length of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    length = 2.0 * (np.log(safe - 1.0) + _EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, length, np.where(n == 2, 1.0, 0.0))


def _grow(values: np.ndarray, rng: np.random.Generator) -> tuple[list[float], list[float]]:
    """One tree as ascending cut points and the path length of each interval between them."""
    limit = math.ceil(math.log2(max(len(values), 2)))
    cuts: list[float] = []
    lengths: list[float] = []
    # Depth first from the left, so leaves come out in ascending order.
    stack = [("node", np.sort(values), 0)]
    while stack:
        kind, part, depth = stack.pop()
        if kind == "cut":
            cuts.append(part)
            continue
        if depth >= limit or len(part) <= 1 or part[0] == part[-1]:
            lengths.append(depth + float(expected_path(len(part))))
            continue
        cut = rng.uniform(part[0], part[-1])
        at = max(1, int(np.searchsorted(part, cut, side="left")))
        stack += [("node", part[at:], depth + 1), ("cut", float(cut), depth), ("node", part[:at], depth + 1)]
    return cuts, lengths


def grow_forest(
    df: DataFrame, column: str, trees: int = 100, sample: int = 256, seed: int = 42, key: str = "record_number"
) -> DataFrame:
    """One row per tree (``cuts``, ``lengths``), each grown on its own sample of at most ``sample`` rows.

    The samples are disjoint and picked by a hash of the row key: a bounded
    number of rows, the same on every run.
    """
    # All 64 bits, so that ties, which go by the key, stay rare however many rows there are.
    ticket = F.xxhash64(F.col(key), F.lit(seed))
    known = df.where(F.col(column).isNotNull()).select(key, F.col(column).cast("double").alias("x"))
    # trees * sample rows at most; ranking them is bounded work.
    picked = least_tickets(known, trees * sample, ticket, F.shiftright(ticket, 32), key)
    number = F.row_number().over(Window.orderBy(ticket, key)) - 1

    def one_tree(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        cuts, lengths = _grow(rows["x"].to_numpy(), np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "cuts": [cuts], "lengths": [lengths], "size": [len(rows)]})

    return (
        picked.withColumn("tree", (number % trees).cast("int"))
        .groupBy("tree")
        .applyInPandas(one_tree, "tree int, cuts array<double>, lengths array<double>, size int")
    )


def isolation_scores(
    df: DataFrame, column: str, trees: int = 100, sample: int = 256, seed: int = 42, key: str = "record_number"
) -> DataFrame:
    """Adds ``score`` in (0, 1): higher is easier to isolate; NULL for a missing value.

    The forest (at most ``trees * sample`` numbers) is collected; scoring runs
    in the tasks on Arrow batches.
    """
    forest = grow_forest(df, column, trees, sample, seed, key).orderBy("tree").collect()
    if not forest:
        return df.withColumn("score", F.lit(None).cast("double"))
    # On one column a tree is a step function, so the whole forest is one as well.
    edges = np.unique(np.concatenate([np.array(r["cuts"], dtype=float) for r in forest]))
    starts = np.concatenate([[-np.inf], edges])
    path = np.zeros(len(starts))
    for r in forest:
        path += np.array(r["lengths"])[np.searchsorted(np.array(r["cuts"], dtype=float), starts, side="right")]
    normaliser = float(np.mean([expected_path(r["size"]) for r in forest])) or 1.0
    levels = np.exp2(-(path / len(forest)) / normaliser)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            x = values.to_numpy(dtype=float)
            yield pd.Series(np.where(np.isnan(x), np.nan, levels[np.searchsorted(edges, x, side="right")]))

    return df.withColumn("score", F.when(F.col(column).isNotNull(), score(F.col(column).cast("double"))))


def isolation_flag(
    df: DataFrame,
    column: str,
    contamination: float = 0.05,
    trees: int = 100,
    sample: int = 256,
    seed: int = 42,
    key: str = "record_number",
) -> DataFrame:
    """Flags the rows whose score lies above its ``1 - contamination`` quantile.

    The forest is a step function, so the scores have at most one level per
    interval between its cuts; rows are counted by level in one pass and the
    quantile, interpolated linearly, is read from these counts.
    """
    scored = isolation_scores(df, column, trees, sample, seed, key)
    levels = scored.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("score").count().collect()
    return scored.withColumn("anomaly", F.coalesce(F.col("score") > F.lit(_from_counts(levels, 1 - contamination)), F.lit(False)))


def _from_counts(counted: list[tuple[float, int]], p: float) -> float | None:
    """Quantile of values given with their numbers of rows; ``None`` without rows."""
    if not counted:
        return None
    values, rows = (np.array(x) for x in zip(*sorted(counted)))
    ends = np.cumsum(rows)
    rank = p * (int(ends[-1]) - 1)
    low, high = (float(values[np.searchsorted(ends, r, side="right")]) for r in (math.floor(rank), math.ceil(rank)))
    return low + (high - low) * (rank - math.floor(rank))
