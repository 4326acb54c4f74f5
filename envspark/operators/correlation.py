"""Pairwise-complete Pearson and Spearman correlation in long form."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import count_if
from .scale import bounded_broadcast, report_rows, running_totals, written


# A broadcast rank table may hold this many numbers (32 MB).
BROADCAST_CELLS = 4_000_000


def _pair_moments(x: Column, y: Column) -> tuple[Column, Column]:
    """Complete pairs and Pearson coefficient; NULL where a side does not vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    return count_if(x.isNotNull() & y.isNotNull()), F.covar_samp(x, y) / F.nullif(spread, F.lit(0.0))


def _upper(df: DataFrame, columns: Sequence[str], pick) -> DataFrame:
    """Upper triangle with the diagonal, from one aggregate. ``pick(i, j)`` gives the two columns."""
    structs = []
    for i in range(len(columns)):
        for j in range(i, len(columns)):
            n, r = _pair_moments(*pick(i, j))
            structs.append(
                F.struct(F.lit(columns[i]).alias("param_1"), F.lit(columns[j]).alias("param_2"), n.alias("n"), r.alias("corr"))
            )
    return report_rows(df, structs)


def _mirrored(upper: DataFrame) -> DataFrame:
    """Both triangles from the upper one, whose aggregate runs once."""
    turned = F.when(
        F.col("param_1") != F.col("param_2"),
        F.struct(F.col("param_2").alias("param_1"), F.col("param_1").alias("param_2")),
    )
    both = F.array_compact(F.array(F.struct("param_1", "param_2"), turned))
    return upper.select(F.inline_outer(both), "n", "corr")


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix; every pair uses the rows where both are known."""
    return _mirrored(_upper(df, columns, lambda i, j: (F.col(columns[i]), F.col(columns[j]))))


def _entries(columns: Sequence[str]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])


def _partner_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Average rank of every distinct value of every column, within the rows where each partner is known.

    One row per (column number, value) with counts ``n0…`` and an array of
    ranks by partner. Equal values are counted before the shuffle, so a value
    that fills most of a column costs one row per task.
    """
    counters = [f"n{j}" for j in range(len(columns))]
    known = [F.col(c).isNotNull().cast("bigint").alias(n) for c, n in zip(columns, counters)]
    counts = (
        df.select(*known, F.explode(_entries(columns)).alias("e"))
        .where("e.v IS NOT NULL")
        .groupBy("e.c", "e.v")
        .agg(*[F.sum(n).alias(n) for n in counters], F.count(F.lit(1)).alias("total"))
    )
    ranked = running_totals(counts, "c", "v", counters)
    ranks = F.array(*[F.col(f"{n}_before") + (F.col(n) + 1) / 2 for n in counters])
    return ranked.select("c", "v", "total", *counters, ranks.alias("ranks"))


def spearman(
    df: DataFrame,
    columns: Sequence[str],
    broadcast_cells: int = BROADCAST_CELLS,
    hot_rows: int | None = None,
) -> DataFrame:
    """Spearman matrix with average ranks; every pair ranks the rows where both are known.

    Ranks are computed per distinct value. Their spread follows from the rank
    table alone, so the rows only add up one product per pair. Ranks reach the
    rows by broadcast if the written rank table is small, otherwise by a
    shuffle in which the few values filling more than ``hot_rows`` rows (an
    eighth of a partition's fair share, if not given) are joined apart. Runs
    writes and one small aggregate.
    """
    slim = df.select(*columns)
    ranks = written(_partner_ranks(slim, columns), "ranks")
    width = range(len(columns))
    moments = ranks.groupBy("c").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(f"n{j}").alias(f"n{j}") for j in width],
        *[count_if(F.col(f"n{j}") > 0).alias(f"d{j}") for j in width],
        # Sum of squared distances of the ranks from their mean (n + 1) / 2.
        *[
            (
                F.sum(F.col(f"n{j}") * F.get("ranks", F.lit(j)) * F.get("ranks", F.lit(j)))
                - F.sum(f"n{j}") * F.pow((F.sum(f"n{j}") + 1) / 2.0, F.lit(2))
            ).alias(f"s{j}")
            for j in width
        ],
    )
    # One row per column.
    facts = {r["c"]: r for r in moments.collect()}
    if sum(r["rows"] for r in facts.values()) * (len(columns) + 2) <= broadcast_cells:
        wide = slim
        for i in width:
            side = ranks.where(F.col("c") == i).select(F.col("v").alias(f"_v{i}"), F.col("ranks").alias(f"_r{i}"))
            wide = wide.join(
                F.broadcast(side), F.col(columns[i]).cast("double") == F.col(f"_v{i}"), "left"
            ).drop(f"_v{i}")
    else:
        cells = sum(r[f"n{i}"] for i, r in facts.items())
        share = cells // (8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        wide = _ranks_by_shuffle(slim, ranks, columns, max(1, share) if hot_rows is None else hot_rows)
    structs = []
    for i in width:
        for j in range(i, len(columns)):
            n = facts[i][f"n{j}"] if i in facts else 0
            # A side with a single distinct value has no correlation.
            varies = i in facts and j in facts and facts[i][f"d{j}"] > 1 and facts[j][f"d{i}"] > 1
            spread = math.sqrt(facts[i][f"s{j}"]) * math.sqrt(facts[j][f"s{i}"]) if varies else 0.0
            if not varies:
                coefficient = F.lit(None).cast("double")
            elif i == j:
                coefficient = F.lit(1.0)
            else:
                middle = (n + 1) / 2
                products = F.sum((F.get(f"_r{i}", F.lit(j)) - middle) * (F.get(f"_r{j}", F.lit(i)) - middle))
                coefficient = products / spread
            structs.append(
                F.struct(
                    F.lit(columns[i]).alias("param_1"),
                    F.lit(columns[j]).alias("param_2"),
                    F.lit(n).cast("bigint").alias("n"),
                    coefficient.alias("corr"),
                )
            )
    return _mirrored(report_rows(wide, structs))


def _ranks_by_shuffle(slim, ranks, columns, hot_rows):
    # The row numbers are written with the rows, so a retried task cannot change them.
    rows = written(slim.withColumn("_row", F.monotonically_increasing_id()), "rows")
    cells = rows.select("_row", F.explode(_entries(columns)).alias("e")).select("_row", "e.c", "e.v").where("v IS NOT NULL")
    # A value is hot by its share of all cells, so at most eight a partition are, whatever the number of rows.
    hot = bounded_broadcast(ranks.where(F.col("total") > hot_rows).select("c", "v", F.col("ranks").alias("hot_ranks")))
    marked = cells.join(hot, ["c", "v"], "left")
    direct = marked.where("hot_ranks IS NOT NULL").select("_row", "c", F.col("hot_ranks").alias("ranks"))
    rest = (
        marked.where("hot_ranks IS NULL")
        .join(ranks.where(F.col("total") <= hot_rows).select("c", "v", "ranks"), ["c", "v"])
        .select("_row", "c", "ranks")
    )
    return (
        direct.unionByName(rest)
        .groupBy("_row")
        .agg(*[F.max(F.when(F.col("c") == i, F.col("ranks"))).alias(f"_r{i}") for i in range(len(columns))])
    )


def correlation(df: DataFrame, columns: Sequence[str], method: str = "spearman") -> DataFrame:
    if method == "pearson":
        return pearson(df, columns)
    if method == "spearman":
        return spearman(df, columns)
    raise ValueError(f"unknown correlation method: {method}")


def pair_counts(df: DataFrame, columns: Sequence[str], min_pairs: int = 5) -> DataFrame:
    """Rows where both parameters are known, and whether any pair has enough of them."""
    cells = [
        F.struct(
            F.lit(a).alias("param_1"),
            F.lit(b).alias("param_2"),
            count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"),
        )
        for a in columns
        for b in columns
    ]
    most = F.greatest(*[F.count(c) for c in columns]) if len(columns) > 1 else F.count(columns[0])
    counted = df.agg(F.array(*cells).alias("_rows"), (most >= min_pairs).alias("enough"))
    return counted.select(F.inline_outer("_rows"), "enough")


def top_correlations(matrix: DataFrame, min_abs: float = 0.3, n: int = 10) -> DataFrame:
    """Strongest pairs of a long matrix (each pair once), by absolute coefficient."""
    strength = F.abs("corr")
    return (
        matrix.where((F.col("param_1") < F.col("param_2")) & (strength >= min_abs))
        .orderBy(F.round(strength, 9).desc(), "param_1", "param_2")
        .limit(n)
    )


def mean_abs_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean over columns of the mean absolute Pearson coefficient, diagonal included, NULLs ignored."""
    per_column = pearson(df, columns).groupBy("param_2").agg(F.avg(F.abs("corr")).alias("m"))
    return per_column.agg(F.avg("m").alias("mean_abs_corr"))
