"""Nearest neighbours from randomly rotated one-bit codes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import map_rows, shared_folder, staged

#: Queries that one pass over the codes serves; they go to the tasks as one broadcast.
QUERIES_PER_PASS = 1024
#: Width of the error bound: the estimate of a unit inner product is off by more with a chance of about exp(-WIDTH**2 / 2).
WIDTH = 3.0
#: Vectors whose largest component is more than so many times the usual one don't count for the centre.
FAR_OFF = 8.0
#: Squared distances from lengths may be off by so much of the lengths' squares.
ROUNDING = 1e-12
_ROWS = 4096
_PAIRS = 1 << 17


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


@dataclass
class Rotation:
    """A random rotation about the centre of all vectors."""

    centre: np.ndarray
    seed: int = 11

    def matrix(self) -> np.ndarray:
        dim = len(self.centre)
        return np.linalg.qr(np.random.default_rng(self.seed).standard_normal((dim, dim)))[0]

    def encode(self, vectors: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs of the rotated vectors, their distance from the centre, and the inner product of code and unit vector."""
        with np.errstate(over="ignore", invalid="ignore"):
            turned = (vectors - self.centre) @ matrix
            length = np.sqrt((turned**2).sum(axis=1))
            unit = turned / np.where(length == 0, 1, length)[:, None]
        return np.packbits(turned > 0, axis=1), length, np.abs(unit).sum(axis=1) / np.sqrt(turned.shape[1])


def bounds(code, length, match, queries, query_length, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances, rows by queries.

    The inner product of two unit vectors is estimated as that of code and
    query over that of code and vector; how far it can be off follows from the
    angle between vector and code.
    """
    dim = queries.shape[1]
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    with np.errstate(over="ignore", invalid="ignore"):
        unit = (queries / np.where(query_length == 0, 1, query_length)[:, None]).astype(np.float32)
        match = np.maximum(match, 1e-6)
        estimate = signs @ unit.T / (np.sqrt(dim) * match)[:, None]
        off = width * np.sqrt(np.maximum(0, 1 - match**2)) / match / np.sqrt(max(1, dim - 1)) + 1e-5
        far = (length**2)[:, None] + (query_length**2)[None, :]
        twice = 2 * length[:, None] * query_length[None, :]
        low = far * (1 - ROUNDING) - twice * np.minimum(1, estimate + off[:, None])
        high = far * (1 + ROUNDING) - twice * np.maximum(-1, estimate - off[:, None])
    # What is too long for its square bounds nothing: its distance is always computed.
    return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of ``a`` and ``b``, components added in order in double precision.

    Where the squares are beyond doubles, the differences are scaled first.
    """
    total = np.zeros(len(a))
    with np.errstate(over="ignore", under="ignore"):
        for x, y in zip(a.T, b.T):
            total += (x - y) ** 2
        out = np.sqrt(total)
        odd = np.flatnonzero(~np.isfinite(total) | (total < 1e-290))
        if len(odd):
            gap = np.abs(a[odd] - b[odd])
            most = gap.max(axis=1, initial=0)
            scaled = (gap / np.where((most == 0) | np.isinf(most), 1, most)[:, None]) ** 2
            out[odd] = np.where(np.isinf(most), np.inf, most * np.sqrt(scaled.sum(axis=1)))
    return out


def nearest_of(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` least (score, id) of each query among ``query, score, id``; an id counts once for a query."""
    q, s, i = pairs
    order = np.lexsort((s, i, q))
    q, s, i = q[order], s[order], i[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
    q, s, i = q[once], s[once], i[once]
    order = np.lexsort((i, s, q))
    q, s, i = q[order], s[order], i[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], s[keep], i[keep]


def _centre(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The commonest dimension, and the mean of its vectors but for those of far more than usual size.

    A few huge vectors would move the mean away from all others, whose bounds
    then say nothing. What is left out here is only the centre's business.
    """
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").limit(1).collect()
    if not dims:
        return 0, np.zeros(0)
    dim = dims[0].dim
    sized = rows.where(F.size("v") == dim).withColumn("most", F.array_max(F.transform("v", F.abs)))
    usual = sized.where(F.col("most") <= FAR_OFF * sized.agg(F.percentile_approx("most", 0.5)).first()[0])

    def sums(batches: Iterator[dict]) -> Iterator[dict]:
        total, n = np.zeros(dim), 0
        for b in batches:
            total += np.array(b["v"], np.float64).reshape(-1, dim).sum(axis=0)
            n += len(b["v"])
        if n:
            yield {"place": range(dim), "total": total, "n": [n] * dim}

    places = map_rows(usual.select("v"), sums, "place int, total double, n long")
    found = places.groupBy("place").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("place").collect()
    return dim, np.array([r["mean"] for r in found])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, width: float = WIDTH, queries_per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of ``vectors`` to each of ``queries`` (both ``vec_id, embedding``).

    Every vector is coded; a task looks at all its codes, keeps those whose
    lower bound is not above the ``k``-th least upper bound, and ranks them by
    the exact distance. Ties go to the smaller id, a query's own id is left
    out, and there are fewer rows where there are fewer candidates. Rows that
    are not ``usable``, have no id or not the commonest dimension take no part.
    Rows that share an id count once, by their nearest vector; as a query such
    an id stands for its least vector. The codes are a written table, the
    queries of each pass (``queries_per_pass``) go to the tasks together.
    """
    spark = vectors.sparkSession
    exact = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & usable(F.col("v"))
    )
    rows = exact(vectors)
    dim, centre = _centre(rows)
    rotation = Rotation(centre)

    def encode(batches: Iterator[dict]) -> Iterator[dict]:
        matrix = rotation.matrix()
        for b in batches:
            code, length, match = rotation.encode(np.array(b["v"], np.float64).reshape(-1, dim), matrix)
            yield b | {"code": [c.tobytes() for c in code], "length": length, "match": match}

    sized = rows.where(F.size("v") == dim)
    codes = staged(map_rows(sized, encode, "vec_id long, v array<double>, code binary, length double, match double"), "codes")
    asked = exact(queries).where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = staged(asked, "queries")
    passes = -(-asked.count() // queries_per_pass)
    path = f"{shared_folder(spark)}/nearest-{uuid.uuid4().hex}"
    schema = "query_id long, score double, vec_id long"
    staged_none = spark.createDataFrame([], schema)
    staged_none.write.parquet(path)
    for i in range(passes):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).collect()
        block = spark.sparkContext.broadcast((np.array([r.vec_id for r in block]), np.array([r.v for r in block]).reshape(-1, dim)))
        _scan(codes, block, rotation, k, width, schema).write.mode("append").parquet(path)
        block.unpersist()
    found = spark.read.schema(schema).parquet(path).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _scan(codes: DataFrame, block, rotation: Rotation, k: int, width: float, schema: str) -> DataFrame:
    """The nearest of each task's rows to the queries of ``block``."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        query_ids, exact = block.value
        if not len(query_ids):
            return
        turned = (exact - rotation.centre) @ rotation.matrix()
        query_length = np.sqrt((turned**2).sum(axis=1))
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        reach = np.full(len(query_ids), np.inf)
        for b in batches:
            for at in range(0, len(b["vec_id"]), _ROWS):
                part = {n: c[at : at + _ROWS] for n, c in b.items()}
                ids, v = np.array(part["vec_id"]), np.array(part["v"], np.float64)
                code = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(ids), -1)
                low, high = bounds(code, np.array(part["length"]), np.array(part["match"]), turned, query_length, width)
                own = ids[:, None] == query_ids[None, :]
                low[own] = high[own] = np.inf
                # Repeated ids may fill places, so look that much further.
                want = k + len(ids) - len(np.unique(ids))
                limit = np.partition(high, want - 1, axis=0)[want - 1] if len(ids) >= want else np.full(len(query_ids), np.inf)
                r, q = np.nonzero((low <= np.minimum(limit, reach)) & ~own)
                for c in range(0, len(r), _PAIRS):
                    rr, qq = r[c : c + _PAIRS], q[c : c + _PAIRS]
                    new = (qq, distances(v[rr], exact[qq]), ids[rr])
                    best = nearest_of(tuple(np.concatenate(x) for x in zip(best, new)), k)
                ends = np.searchsorted(best[0], np.arange(len(query_ids)), "right")
                full = ends - np.searchsorted(best[0], np.arange(len(query_ids))) == k
                reach[full] = best[1][ends[full] - 1] ** 2 * (1 + 1e-9)
        yield {"query_id": query_ids[best[0]], "score": best[1], "vec_id": best[2]}

    return map_rows(codes, rows, schema)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the rows of ``exact`` (``query_id, vec_id``) that are in ``found``."""
    total = exact.count()
    return exact.join(found, ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0
