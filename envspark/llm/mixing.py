"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import row_hash, spare_names, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
SEED = 17
_SLOT_BITS = 33


def offset(seed: int = SEED) -> float:
    """The one random offset of a mix."""
    return random.Random(seed).random()


def n_words() -> Column:
    """Plain words of ``text``; null has none."""
    return F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _ranked(rows: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """Write ``rows`` in order with ``_place``: range partition and place in it. Ranks need one count per partition then."""
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return staged(spread.withColumn("_place", F.monotonically_increasing_id()), "ordered")


def _rank(placed: DataFrame, group: str) -> DataFrame:
    """``rank`` from 1 within ``group`` (null is a group), which is spread over as many partitions as it fills."""
    part = F.shiftright("_place", _SLOT_BITS)
    counted = placed.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    # One row for each partition that a group touches.
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("_group", "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    starts = staged(starts, "starts")
    rows = placed.withColumn("_part", part)
    joined = rows.join(starts, rows["_part"].eqNullSafe(starts["_part"]) & rows[group].eqNullSafe(starts["_group"]))
    return joined.select(*[rows[c] for c in placed.columns], (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias("rank"))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING
) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources in code point order (null last) take ``weights`` in turn and share
    ``share`` times all sizes; none gets more than ``ceiling`` times its own
    size, and what is cut off is shared among the rest until nothing is above.
    Each round of resharing passes two sums through the driver.
    """
    totals = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    order = [F.col("source").asc_nulls_last()]
    ranked = _rank(_ranked(totals.withColumn("_all", F.lit(1)), order, 1 + totals.count() // 100_000), "_all")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = staged(ranked.select("source", "source_size", pick.alias("weight")), "weights")
    limit = F.col("source_size") * ceiling
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        # A source once above the level stays capped: the level only rises.
        above = F.lit(False) if level is None else F.col("weight") * level > limit
        held, n, open_weight = table.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)),
            F.count_if(above),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == capped or not open_weight:
            break
        level, capped = (total * share - held) / open_weight, n
    wanted = limit if level is None else F.when(F.col("weight") * level > limit, limit).otherwise(F.col("weight") * level)
    return table.select("source", "source_size", wanted.cast("double").alias("target"))


def copies_by_document(docs: DataFrame, seed: int = SEED, told: Column | None = None, **shares) -> DataFrame:
    """``docs`` (``doc_id, source, text``) as ``doc_id, source, text_hash, size, source_size, target, copies``.

    Every row of a source has ``target / source_size`` expected copies. They are
    summed up along the source in order of size and id, one offset is added,
    and a row is emitted once for each whole number its sum passes. The order
    by size keeps the words taken within about one document of the target.
    Rows of equal id and size count one by one, in order of ``text_hash``: ``told``,
    or else the text's hash. A source of size 0 emits nothing.
    """
    # Written as numbers before the order is sought, so texts are read once and move nowhere.
    sizes = staged(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("source").cast("string"),
            (F.xxhash64(F.col("text").cast("string")) if told is None else told).alias("text_hash"),
            n_words().alias("size"),
        ),
        "sizes",
    )
    targets = staged(source_targets(sizes, **shares), "targets")
    order = [F.col(c).asc_nulls_last() for c in ("source", "size", "doc_id", "text_hash")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = _rank(_ranked(sizes, order, parts), "source")
    rows = ranked.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    passed = lambda k: F.floor(F.lit(offset(seed)) + expected * k)
    copies = passed(F.col("rank")) - passed(F.col("rank") - 1)
    return rows.select("doc_id", "r.source", "text_hash", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """``docs`` with every row repeated as often as its copies say, rows of 0 copies left out.

    Rows that share an id are told apart by all their columns; rows alike in all
    of them stand for each other, so their copies are added.
    """
    i, s, h, n, k = spare_names(docs, "mixed_id", "mixed_source", "mixed_hash", "mixed_copies", "mixed_copy")
    told = row_hash(docs)
    counted = copies_by_document(docs, seed, told, **shares).where("copies > 0")
    counted = counted.groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("text_hash").alias(h)).agg(F.sum("copies").alias(n))
    rows = docs.withColumn(h, told).alias("d")
    joined = rows.join(
        staged(counted, "copies").alias("c"),
        F.col("d.doc_id").cast("long").eqNullSafe(F.col(f"c.{i}"))
        & F.col("d.source").cast("string").eqNullSafe(F.col(f"c.{s}"))
        & (F.col(f"d.{h}") == F.col(f"c.{h}")),
    ).select("d.*", f"c.{i}", f"c.{s}", f"c.{n}")
    many = joined.dropDuplicates([i, s, h]).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    return many.select(*[F.col(f"`{c}`") for c in docs.columns])
