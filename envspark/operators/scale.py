"""Building blocks that keep order-dependent work spread over the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..defaults import ORDER

# A broadcast side may hold this many rows; above it the join shuffles.
BROADCAST_ROWS = 200_000
# Rows per block of the blocked windows.
BLOCK_ROWS = 250_000
_SLOT_BITS = 33


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's checkpoint directory."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="envspark-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back (an action).

    Later work reads columns from the table and does not depend on executors
    that held shuffle output.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_row(stats: DataFrame) -> Column:
    """A one-row DataFrame as a struct column, by scalar subquery."""
    return stats.select(F.struct(*[F.col(f"`{c}`") for c in stats.columns])).scalar()


def report_rows(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """One output row per struct of aggregates, all from a single aggregate over ``df``."""
    # The outer form keeps the optimizer from testing the size of the whole array expression.
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline_outer("_rows"))


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if at most ``max_rows`` rows are there (runs a bounded count)."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def _unused(df: DataFrame, *names: str) -> list[str]:
    """Names that ``df`` has no columns of."""
    taken = max((c for c in df.columns if c.startswith("_")), key=len, default="")
    return [f"_{n}" if not taken else f"{taken}_{n}" for n in names]


def spread_left_join(left: DataFrame, right: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Left join with a side that is too large to broadcast and has one row for each ``key``.

    A key that fills more than an eighth of a partition's fair share of the
    left rows is dealt over several pieces by a hash of the row, and its one
    right row is copied to each; at most eight keys a partition are that
    frequent, which bounds what is broadcast. Left rows without a key have no
    partner and take no part in the shuffle. Reads ``left`` once more for the counts
    (one write).
    """
    parts = partitions or _range_partitions(left)
    count, pieces, piece = _unused(left.select("*", *[F.lit(None).alias(c) for c in right.columns if c != key]), "count", "pieces", "piece")
    counts = written(left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(count)), "keys")
    share = max(1, (counts.agg(F.sum(count)).first()[0] or 0) // (8 * parts))
    frequent = F.broadcast(counts.where(F.col(count) > share).select(key, F.ceil(F.col(count) / share).cast("int").alias(pieces)))
    known = left.where(F.col(key).isNotNull()).join(frequent, key, "left")
    # The hash of the whole row: a task that runs again deals its rows alike.
    dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.col(pieces)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(pieces), F.lit(1)) - 1))
    joined = (
        known.withColumn(piece, F.coalesce(dealt, F.lit(0))).drop(pieces)
        .join(right.join(frequent, key, "left").withColumn(piece, copies).drop(pieces), [key, piece], "left")
        .drop(piece)
    )
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key]
    without = left.where(F.col(key).isNull()).select(*[F.col(f"`{c}`") for c in joined.columns[: len(left.columns)]], *rest)
    return joined.unionByName(without)


def least_tickets(df: DataFrame, n: int, ticket: Column, high: Column, key: str) -> DataFrame:
    """The ``n`` rows with the least ``ticket`` (then ``key``), without n rows from every task in one.

    ``high`` is the ticket's upper 32 bits as a bigint in the same order. Counts
    by its upper and then its lower half (65,536 numbers at most, each time) tell up to which number
    rows are needed, and only these are sorted. Missing tickets come first.
    """
    high = F.coalesce(high, F.lit(-(1 << 31) - 1).cast("bigint"))
    upper = F.shiftright(high, 16)

    def reached(counted: DataFrame, earlier: Column) -> Column:
        # Numbers of one half: a bounded window.
        sofar = F.sum("rows").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
        before = F.coalesce(sofar, F.lit(0)) + earlier
        needed = counted.select("p", before.alias("b")).where(F.col("b") < n)
        return needed.agg(F.max(F.struct("p", "b"))).scalar()

    rows = F.count(F.lit(1)).alias("rows")
    edge = reached(df.groupBy(upper.alias("p")).agg(rows), F.lit(0))
    inside = df.where(upper == edge["p"]).groupBy(high.alias("p")).agg(rows)
    cut = reached(inside, edge["b"])
    return df.where(high <= cut["p"]).orderBy(ticket, key).limit(n)


def _range_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_position(
    df: DataFrame,
    order: Sequence[str] = ORDER,
    name: str = "position",
    partitions: int | None = None,
    block: str | None = None,
) -> DataFrame:
    """Number all rows from 0 along ``order``, which must be a unique key.

    One range shuffle puts the rows in order; each row's place inside its
    partition is written with it, so only one count per partition is needed to
    turn places into global positions. ``block`` names a column for the number
    of the range partition. Runs one write.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = written(
        df.repartitionByRange(partitions or _range_partitions(df), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("_place", _SLOT_BITS)
    # One row per range partition, so the unpartitioned window is tiny.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    slot = F.col("_place").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(
            *df.columns,
            (F.col("_offset") + slot).alias(name),
            *([F.col("_part").alias(block)] if block else []),
        )
    )


def blocked_window(
    df: DataFrame,
    columns: Callable[[object], dict[str, Column]],
    before: int,
    after: int = 0,
    order: Sequence[str] = ORDER,
    site: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Row-frame window functions over one long series without one big task.

    Rows get a global position and fall into blocks of ``block_rows``; the rows
    next to a block edge are copied into the neighbour so that every frame is
    complete, and the copies are dropped afterwards. ``columns`` receives the
    window specification (partitioned and ordered, no frame) and returns the
    new columns. A site holding most rows is spread over many blocks.
    """
    block_rows = max(block_rows or BLOCK_ROWS, before + after + 1)
    sites = [site] if site else []
    rows = with_position(df, [*sites, *order])
    home = F.floor(F.col("position") / block_rows)
    inside = F.pmod(F.col("position"), F.lit(block_rows))
    copies = F.array(
        home,
        F.when(inside >= block_rows - before, home + 1),
        F.when(inside < after, home - 1),
    )
    spread = rows.withColumn("_home", home).withColumn("_block", F.explode(F.array_compact(copies)))
    window = Window.partitionBy("_block", *sites).orderBy("position")
    made = columns(window)
    return (
        spread.select("*", *[c.alias(n) for n, c in made.items()])
        .where(F.col("_block") == F.col("_home"))
        .drop("_block", "_home")
    )


def carried(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str] = ORDER,
    site: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``<c>_prev`` and ``<c>_next``: nearest non-null value at or before / after each row.

    Each range partition of the ordered table is one block. Inside a block a
    window finds the value; across blocks the last and first known value of
    each block (one row per block and site) are carried along. Both directions
    use growing frames, so every window costs one pass.
    """
    sites = [site] if site else []
    keys = ["_block", *sites]
    rows = with_position(df, [*sites, *order], partitions=partitions, block="_block")
    edges = rows.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(f"_last_{c}") for c in columns],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(f"_first_{c}") for c in columns],
    )
    # One row per range partition and site.
    forth = Window.partitionBy(*sites).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*sites).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *keys,
        *[F.last(f"_last_{c}", ignorenulls=True).over(forth).alias(f"_before_{c}") for c in columns],
        *[F.last(f"_first_{c}", ignorenulls=True).over(back).alias(f"_after_{c}") for c in columns],
    )
    upto = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy(*keys).orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.select(
        "*",
        *[F.last(c, ignorenulls=True).over(upto).alias(f"_in_prev_{c}") for c in columns],
        *[F.last(c, ignorenulls=True).over(onward).alias(f"_in_next_{c}") for c in columns],
    )
    # A missing site is a site of its own, as it is in the windows above.
    same = reduce(and_, [F.col(f"f.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys])
    return filled.alias("f").join(edges.alias("e"), same).select(
        *[F.col(f"f.{c}") for c in df.columns],
        *[F.coalesce(f"_in_prev_{c}", f"_before_{c}").alias(f"{c}_prev") for c in columns],
        *[F.coalesce(f"_in_next_{c}", f"_after_{c}").alias(f"{c}_next") for c in columns],
    )


def last_n(df: DataFrame, n: int, order: Sequence[str] = ORDER) -> DataFrame:
    """The newest ``n`` rows: a bounded heap per task, no full sort."""
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)


def recency(order: Sequence[str] = ORDER) -> Column:
    """Rank 1 for the newest row; only for inputs already cut by :func:`last_n`."""
    return F.row_number().over(Window.orderBy(*[F.col(c).desc_nulls_last() for c in order]))


def order_key(order: Sequence[str] = ORDER) -> Column:
    """The order columns as one comparable value."""
    return F.struct(*order)


def running_totals(
    df: DataFrame, within: str, value: str, counters: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Adds ``<c>_before``: sum of each counter over smaller values of the same ``within``.

    ``(within, value)`` must be unique. Range partitions hold consecutive values
    and only one total per partition crosses between them. Runs one write.
    """
    keys = [F.col(within), F.col(value)]
    parts = written(
        df.repartitionByRange(partitions or _range_partitions(df), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id()),
        "ranked",
    )
    earlier_parts = Window.partitionBy(within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        parts.groupBy(within, "_part")
        .agg(*[F.sum(c).alias(f"_sum_{c}") for c in counters])
        .select(
            within,
            "_part",
            *[F.coalesce(F.sum(f"_sum_{c}").over(earlier_parts), F.lit(0)).alias(f"_off_{c}") for c in counters],
        )
    )
    earlier_rows = Window.partitionBy(within, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.select(
            "*", *[F.coalesce(F.sum(c).over(earlier_rows), F.lit(0)).alias(f"_run_{c}") for c in counters]
        )
        .join(totals, [within, "_part"])
        .select(*df.columns, *[(F.col(f"_off_{c}") + F.col(f"_run_{c}")).alias(f"{c}_before") for c in counters])
    )
