"""URL filter: rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..operators.scale import BROADCAST_ROWS, least_tickets, spread_left_join
from .common import staged

#: Host and path joined, and what becomes of urls that fit.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: The trees learn from this many different labelled urls at most, chosen by hash.
FIT_ROWS = 50_000


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


@F.pandas_udf(ArrayType(DoubleType()))
def lexical_features(url: pd.Series) -> pd.Series:
    """Length, depth, ratio of digits, entropy of characters, parameters, hyphens, labels and length of the host."""

    def one(u: str | None) -> list[float]:
        u = u or ""
        rest = u.partition("://")[2]
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        query = rest.partition("?")[2].partition("#")[0]
        n = max(1, len(u))
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(u).values())
        digits = sum(c.isdigit() for c in u)
        return [
            float(x)
            for x in (
                len(u), path.count("/"), digits / n, entropy, query.count("=") + query.count("&"), "#" in rest,
                host.count("-"), host.count("."), len(host), len(path), u.startswith("https"), path.endswith("/"),
            )
        ]

    return url.map(one)


def _suffix(host: Column) -> Column:
    """The last label of the host."""
    return F.substring_index(host, ".", -1)


class UrlFilter:
    """Trees and suffix statistics learned from labelled urls.

    ``suffixes`` is a written table with one row for every suffix that a label
    was seen with: ``suffix``, ``rate``.
    """

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame | None, prior: float):
        self.trees, self.suffixes, self.prior = trees, suffixes, prior

    @classmethod
    def fit(cls, labelled: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 5, iterations: int = 15, depth: int = 4) -> UrlFilter:
        """Learn from ``url, label`` (1: block). The trees see each different url and label once, weighted by its rows.

        If there are more than ``fit_rows`` of these, the ``fit_rows`` with the least hashes are taken.
        Suffix statistics come from all rows: the share of blocked urls for each
        host suffix, drawn to the overall share. With one
        kind of label or none, the filter gives the commoner kind to everything.
        """
        rows = labelled.where("label IS NOT NULL").select("url", F.col("label").cast("int").alias("label"))
        # A url that fills many rows is one row a task here, and one row from here on.
        rows = staged(rows.groupBy("url", "label").agg(F.count(F.lit(1)).cast("double").alias("weight")), "url_labels")
        blocked_rows = F.sum(F.col("weight") * F.col("label"))
        total, blocked = rows.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(blocked_rows, F.lit(0.0))).first()
        prior = blocked / total if total else 0.0
        if not 0 < blocked < total:
            return cls(None, None, prior)
        by_suffix = rows.groupBy(_suffix(host_of(F.col("url"))).alias("suffix")).agg(F.sum("weight").alias("n"), blocked_rows.alias("b"))
        # Urls that are null have the suffix of an empty one.
        rate = (F.col("b") + 5 * prior) / (F.col("n") + 5)
        model = cls(None, staged(by_suffix.where("suffix IS NOT NULL").select("suffix", rate.alias("rate")), "url_suffixes"), prior)
        ticket = F.xxhash64("url", "label", F.lit(seed))
        train = staged(model.features(least_tickets(rows, fit_rows, ticket, F.shiftright(ticket, 32), "url")), "url_features")
        model.trees = GBTClassifier(
            featuresCol="features", labelCol="label", weightCol="weight", maxIter=iterations, maxDepth=depth, stepSize=0.3, seed=seed
        ).fit(train)
        return model

    def features(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``features``; a suffix without statistics gets the overall share."""
        suffix, rate = (f"_{max(rows.columns, key=len)}_{n}" for n in ("suffix", "rate"))
        named = rows.withColumn(suffix, _suffix(host_of(F.coalesce("url", F.lit("")))))
        rates = self.suffixes.select(F.col("suffix").alias(suffix), F.col("rate").alias(rate))
        # One row a suffix; a suffix may hold most urls.
        few = rates.count() <= BROADCAST_ROWS
        known = named.join(F.broadcast(rates), suffix, "left") if few else spread_left_join(named, rates, suffix)
        vector = F.concat(lexical_features("url"), F.array(F.coalesce(rate, F.lit(float(self.prior)))))
        return known.withColumn("features", array_to_vector(vector)).drop(suffix, rate)

    def block_probability(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``url`` gains ``block_probability``; null urls are judged as empty ones."""
        if self.trees is None:
            return rows.withColumn("block_probability", F.lit(float(self.prior)))
        scored = self.trees.transform(self.features(rows))
        judged = scored.withColumn("block_probability", vector_to_array("probability")[1])
        return judged.drop("features", "rawPrediction", "probability", "prediction")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, **fit) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_probability`` of every row of ``pages`` (``page_id, url``).

    The longest fitting rule decides; other urls are blocked if the trees give
    block a probability of one half or more. Without ``labelled`` the urls
    that rules decide are the labels.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = ruled.where("fit IS NOT NULL").select("url", (F.col("fit.verdict") == "block").cast("int").alias("label"))
    scored = UrlFilter.fit(labelled, **fit).block_probability(ruled)
    by_trees = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_trees).alias("verdict"), "block_probability"
    )
