"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_rows, plain_words, spare_names, staged, text_bytes
from .components import components

BITS = 64
#: A bucket with more fingerprints than this is split by further bits.
HOT_BUCKET = 64


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed integer; 0 for a text without words.

    A bit is set if more than half of the shingles' XXH64 values (seed 42) have
    it, repeats counted. A text of fewer words is one shingle.
    """
    words = plain_words(text)
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    votes = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, len(hashes) // 4096 + 1):
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` per row of ``docs`` (``doc_id``, ``text``); null texts count as empty.

    ``text_hash`` tells apart rows that share an id.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            b["fp"] = [fingerprint(t, width) for t in b.pop("text")]
            yield b

    asked = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), text_bytes().alias("text")
    )
    return map_rows(asked, rows, "doc_id long, text_hash long, fp long")


def _segments(width: int, ball: bool) -> Column:
    """The two halves of the bits ``lo .. lo + 2 * width`` as buckets; with ``ball`` also all values one bit away.

    ``rest`` is where the bits begin that the bucket leaves open.
    """
    found = []
    for here, other in ((0, width), (width, 0)):
        value = F.expr(f"shiftrightunsigned(fp, lo + {here})").bitwiseAND(F.lit((1 << width) - 1))
        near = [value, *(value.bitwiseXOR(F.lit(1 << j)) for j in range(width if ball else 0))]
        found += [F.struct(F.xxhash64("bucket", F.col("lo") + here, v).alias("bucket"), (F.col("lo") + other).alias("lo")) for v in near]
    return F.explode(F.array(*found))


def near_pairs(prints: DataFrame, radius: int = 3, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """All pairs ``a < b`` of the distinct ``fp`` in ``prints`` that differ in at most ``radius`` (up to 3) bits.

    Fingerprints are cut into two segments. Of two that differ in three bits at
    most, one segment differs in one bit at most, so each fingerprint looks up
    the Hamming ball of radius one around both segments in a table of segment
    values, and complete distances are verified. Buckets of the table with many
    fingerprints are not joined: their open bits are segmented in the same way,
    until 56 bits are fixed and a bucket can hold 256 at most.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two segments and balls of radius one cover radius 0 to 3")
    level = prints.select("fp", F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("lo"))
    table_rows = probe_rows = level
    pairs, width = None, BITS // 2
    while True:
        stored = table_rows.select("fp", _segments(width, False).alias("at")).select("fp", "at.bucket", "at.lo")
        probes = probe_rows.select("fp", _segments(width, True).alias("at")).select("fp", "at.bucket", "at.lo")
        crowded = None
        if width > 8:
            crowded = staged(stored.groupBy("bucket").count().where(F.col("count") > hot_bucket).select("bucket"), "crowded")
            if crowded.isEmpty():
                crowded = None
        calm = stored if crowded is None else stored.join(crowded, "bucket", "left_anti")
        asking, kept = probes.alias("p"), calm.alias("t")
        met = asking.join(kept, F.col("p.bucket") == F.col("t.bucket")).where(
            (F.col("p.fp") < F.col("t.fp")) & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp"))) <= radius)
        )
        met = met.select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b"))
        pairs = met if pairs is None else pairs.union(met)
        if crowded is None:
            return pairs.distinct()
        table_rows = staged(stored.join(crowded, "bucket", "left_semi"), "crowded_table")
        probe_rows = staged(probes.join(crowded, "bucket", "left_semi"), "crowded_probes")
        width //= 2


def near_duplicate_groups(docs: DataFrame, radius: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp, component_id, keep_hash``: each row with the smallest id its fingerprint is linked to.

    ``component_id`` and ``keep_hash`` name the row that stands for the group
    (smallest id, then smallest hash); a group whose ids are all null has a null
    id. Links run between distinct fingerprints, so copies cost nothing there.
    """
    rows = staged(fingerprints(docs), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    classes = staged(rows.groupBy("fp").agg(first.alias("first")), "classes")
    linked = staged(components(near_pairs(classes.select("fp"), radius)), "linked")
    ends = linked.withColumnRenamed("node", "fp")
    least = staged(classes.join(ends, "fp").groupBy("root").agg(F.min("first").alias("least")), "least")
    # Only linked fingerprints look for their root's name, and from written tables, so that a large component is split.
    named = classes.join(ends.join(least, "root").select("fp", "least"), "fp", "left")
    named = staged(named.select("fp", F.coalesce("least", "first").alias("keep")), "named")
    # Both sides are written tables: a fingerprint with many copies is split by the skew join.
    return rows.join(named, "fp").select(
        "doc_id", "text_hash", "fp", F.col("keep.doc_id").alias("component_id"), F.col("keep.text_hash").alias("keep_hash")
    )


def drop_near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row of each near-duplicate group: the smallest id, with all columns of ``docs``."""
    groups = near_duplicate_groups(docs, radius)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("keep_hash")))
    i, h = spare_names(docs, "kept_id", "kept_hash")
    kept = staged(kept.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct(), "kept")
    asked = docs.withColumn(h, F.xxhash64(F.col("text").cast("string"))).withColumn(i, F.col("doc_id").cast("long"))
    same = asked.alias("d").join(kept.alias("k"), F.col(f"d.{i}").eqNullSafe(F.col(f"k.{i}")) & (F.col(f"d.{h}") == F.col(f"k.{h}")), "left_semi")
    return same.dropDuplicates([i, h]).select(*[f"`{c}`" for c in docs.columns])
