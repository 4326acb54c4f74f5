"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``edges`` (``a, b``, both long); equal roots are connected.

    Each round every node moves to the neighbour of least rank, by a hash drawn
    anew per round, and edges are rewritten to the new ends. A round leaves a
    fraction of the nodes whatever their ids, so the rounds grow with the
    logarithm of the largest component. Nothing but a count of edges reaches
    the driver; every round is a written table.
    """
    live = staged(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    moves: list[DataFrame] = []
    while not live.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("r"), c.alias("n"))
        ways = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min(rank(F.col("b"))).alias("best"))
        move = staged(
            least.select(F.col("a").alias("node"), F.least("best", rank(F.col("a")))["n"].alias("root")), "moves"
        )
        moves.append(move)
        a, b = (move.select(F.col("node").alias(c), F.col("root").alias(f"to_{c}")) for c in "ab")
        moved = live.join(a, "a").join(b, "b").where("to_a <> to_b")
        live = staged(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves[0]
    for move in moves[1:]:
        later = move.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
