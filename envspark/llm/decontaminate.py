"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index stores postings of the rarest terms of the benchmark: term, row of
the corpus, position and the words around it. A window of benchmark words is
found by intersecting the lists of its two rarest terms, each shifted by the
term's place in the window, and then compared word by word.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import spare_names, staged

WINDOW = 13
#: Terms that one pass over the corpus looks for; they are broadcast, more terms take more passes.
TERMS_PER_PASS = 200_000
#: What stands between letter words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Letter words of a text, A-Z lower-cased; null has none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    # Splitting takes a quarter of the time of extracting; it leaves an empty string at a separator on either end.
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN), ""), F.array().cast("array<string>"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, words``; the hash tells apart rows that share an id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))


def _found_terms(docs: DataFrame, terms: DataFrame, columns: list[Column]) -> DataFrame:
    """``columns`` for every place where a word of ``docs`` is one of ``terms``.

    The terms are broadcast, ``TERMS_PER_PASS`` at a time, so that the exploded
    words meet them inside one stage and only hits are built into rows.
    """
    passes = -(-terms.count() // TERMS_PER_PASS) or 1
    exploded = _keyed(docs).select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "term"))
    shares = [terms.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == i) for i in range(passes)]
    return reduce(DataFrame.union, [exploded.join(F.broadcast(s), "term").select(*columns) for s in shares])


def _items(benchmark: DataFrame) -> DataFrame:
    """``item_id, item, words`` of the items with words; rows without id take no part, repeated rows count once."""
    text = F.col("text").cast("string")
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(text).alias("words"))
    rows = rows.where("item_id IS NOT NULL AND size(words) > 0").distinct()
    return rows.withColumn("item", F.xxhash64("item_id", "words"))


def _anchors(items: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """For each item the pairs of places ``a, b`` that hold the two rarest terms of some window, with the words around ``a``."""
    places = items.select("item", "words", F.posexplode("words").alias("pos", "term"))
    last = F.greatest(F.size("words") - window, F.lit(0))
    starts = F.sequence(F.greatest(F.col("pos") - (window - 1), F.lit(0)), F.least("pos", last))
    rated = (
        places.select("item", "pos", "term", F.explode(starts).alias("start"))
        .join(frequency, "term", "left")
        .select("item", "start", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pos", "term").alias("place"))
    )
    rarest = rated.groupBy("item", "start").agg(F.array_sort(F.collect_list("place")).alias("by_n"))
    pairs = rarest.select("item", F.col("by_n")[0].alias("x"), F.coalesce(F.get("by_n", F.lit(1)), F.col("by_n")[0]).alias("y"))
    pairs = pairs.select(
        "item", F.col("x.pos").alias("a"), F.col("x.term").alias("term_a"), F.col("y.pos").alias("b"), F.col("y.term").alias("term_b")
    ).distinct()
    before = F.reverse(F.slice("words", F.greatest(F.col("a") - window + 2, F.lit(1)), F.least(F.col("a"), F.lit(window - 1))))
    return pairs.join(items, "item").select(
        *pairs.columns, "item_id", before.alias("item_before"), F.slice("words", F.col("a") + 2, window - 1).alias("item_after"),
        F.least(F.size("words"), F.lit(window)).alias("needed"),
    )


class PositionalIndex:
    """Postings of a benchmark's rarest terms in a corpus; building it writes tables to the shared folder."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW):
        items = staged(_items(benchmark), "items")
        terms = staged(items.select(F.explode("words").alias("term")).distinct(), "terms")
        frequency = _found_terms(docs, terms, [F.col("term")]).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        self.window, self.docs = window, docs
        self.anchors = staged(_anchors(items, staged(frequency, "frequency"), window), "anchors")
        rare = staged(self.anchors.select(F.explode(F.array("term_a", "term_b")).alias("term")).distinct(), "rare_terms")
        pos, reach = F.col("pos"), window - 1
        before = F.reverse(F.slice("words", F.greatest(pos - reach + 1, F.lit(1)), F.least(pos, F.lit(reach))))
        after = F.slice("words", pos + 2, reach)
        place = [F.col("doc_id"), F.col("text_hash"), F.col("term"), pos, before.alias("before"), after.alias("after")]
        self.postings = staged(_found_terms(docs, rare, place), "postings")

    def _list(self, which: str, place: str, *extra: str) -> DataFrame:
        """The postings of all terms ``which``, shifted by ``place``: where the item would begin in the row."""
        keyed = self.postings.join(self.anchors, F.col("term") == F.col(which))
        return keyed.select("item", "a", "b", "doc_id", "text_hash", (F.col("pos") - F.col(place)).alias("begin"), *extra)

    def phrases(self) -> DataFrame:
        """``doc_id, text_hash, item_id, first, last``: words of a row equal to words of an item over a whole window or more."""
        on = ["item", "a", "b", "begin"]
        lefts = self._list("term_a", "a", "item_id", "pos", "before", "after", "item_before", "item_after", "needed").alias("l")
        rights = self._list("term_b", "b").distinct().alias("r")
        same = reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*on, "doc_id", "text_hash"]])
        met = lefts.join(rights, same, "left_semi")

        def run(ours: str, theirs: str) -> Column:
            equal = F.zip_with(ours, theirs, lambda x, y: x.eqNullSafe(y))
            stop = F.array_position(equal, False)
            return F.when(stop > 0, stop - 1).otherwise(F.size(equal))

        met = met.withColumn("left", run("before", "item_before")).withColumn("right", run("after", "item_after"))
        return met.where(F.col("left") + F.col("right") + 1 >= F.col("needed")).select(
            "doc_id", "text_hash", "item_id", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right")).alias("last")
        )

    def proximity(self, slack: int) -> DataFrame:
        """``doc_id, text_hash, item_id, at, apart``: the two rarest terms of a window up to ``slack`` words off their distance."""
        step = slack + 1
        cell = F.floor(F.col("begin") / step)
        lefts = self._list("term_a", "a", "item_id", "pos").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).alias("l")
        rights = self._list("term_b", "b").distinct().withColumn("cell", cell).alias("r")
        on = ["item", "a", "b", "cell", "doc_id", "text_hash"]
        same = reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on])
        off = F.abs(F.col("l.begin") - F.col("r.begin"))
        met = lefts.join(rights, same & (off <= slack))
        return met.groupBy("l.doc_id", "l.text_hash", "item_id", F.col("pos").alias("at")).agg(F.min(off).alias("apart"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_hash, n_words, n_hit, items, contaminated``.

    A word is hit inside any occurrence of a window of ``window`` consecutive
    item words, or of a whole shorter item. ``items`` are the ids with such an
    occurrence, sorted as strings. A row is contaminated if one word of
    ``share`` or more is hit. Null texts have no words; items without words or
    id match nothing; repeated rows each get the same result.
    """
    found = staged(PositionalIndex(docs, benchmark, window).phrases(), "phrases")
    key = ["doc_id", "text_hash"]
    spans = found.groupBy(*key, "first").agg(F.max("last").alias("last"))
    # The spans of one row, at most one per word.
    earlier = Window.partitionBy(*key).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("first"), F.coalesce(F.max("last").over(earlier) + 1, F.lit(0)))
    new = spans.select(*key, F.greatest(F.col("last") - reached + 1, F.lit(0)).alias("new"))
    hits = new.groupBy(*key).agg(F.sum("new").alias("n_hit"))
    named = found.select(*key, "item_id").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    h, i = hits.alias("h"), named.alias("i")
    both = lambda x, y: reduce(lambda p, q: p & q, [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in key])
    marked = staged(h.join(i, both("h", "i")).select("h.*", "i.items"), "marked").alias("m")
    rows = _keyed(docs).select(*key, F.size("words").cast("long").alias("n_words")).alias("d")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(marked, both("d", "m"), "left").select(
        "d.doc_id", "d.text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    i, h = spare_names(docs, "bad_id", "bad_hash")
    bad = contamination(docs, benchmark, **options).where("contaminated").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h))
    bad = staged(bad.distinct(), "contaminated").alias("b")
    rows = docs.withColumn(h, F.xxhash64(F.col("text").cast("string"))).alias("d")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col(f"b.{i}")) & (F.col(f"d.{h}") == F.col(f"b.{h}"))
    return rows.join(bad, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
