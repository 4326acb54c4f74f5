"""Bigram language model by deleted interpolation, counted and scored in hash partitions."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import plain_words, text_bytes

#: A word is a class of its own if it makes up one in so many training tokens, so this bounds such words; the rest share one class.
COMMON_SHARE = 65_000
RARE = 0xFFFF
#: No word has a space in it.
END = b" "
FOLDS = 7
#: This fold of the training rows is held out when the mixture weights are learned, and counted again for scoring.
HELD_FOLD = 6
#: Distinct words that a task counts before it passes them on, tokens and rows of a block, bytes of text for each hash partition.
COUNTED_WORDS = 120_000
BLOCK_TOKENS = 1 << 17
BLOCK_ROWS = 1 << 11
PARTITION_BYTES = 12_000_000
_GRID = 8  # steps to an octave in the statistics for EM
_SPAN = 512


def buckets_of(counts: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: its number of binary digits; 0 for a context never seen."""
    return np.frexp(np.asarray(counts, np.float64))[1].clip(0, 63)


def learn_weights(bucket: np.ndarray, p: np.ndarray, weight: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Mixture weights (64 buckets by bigram, unigram, uniform) by expectation-maximisation.

    ``p`` holds the three probabilities of held-out tokens, ``weight`` how often
    they occur. A bucket without held-out tokens takes the weights of all; every
    part keeps a weight of one millionth. Contexts never seen have no bigrams.
    """

    def em(p: np.ndarray, w: np.ndarray) -> np.ndarray:
        mix = np.full(3, 1 / 3)
        for _ in range(rounds):
            part = p * mix
            total = np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
            mix = np.maximum((part / total * w[:, None]).sum(axis=0) / w.sum(), 1e-6)
            mix /= mix.sum()
        return mix

    overall = em(p, weight) if len(weight) else np.array([0.6, 0.3, 0.1])
    found = np.tile(overall, (64, 1))
    for b in np.unique(bucket):
        found[b] = em(p[bucket == b], weight[bucket == b])
    found[0, 0] = 0
    found[0] /= found[0].sum()
    return found


@dataclass
class Vocabulary:
    """Counts of the common words (class by place) and totals; class ``RARE`` holds all other words."""

    words: list[bytes]
    counts: np.ndarray  # by class, of all training rows
    kept: np.ndarray  # by class, without the held-out fold
    tokens: int
    distinct: int
    rare_words: int

    @classmethod
    def count(cls, rows: RDD, parts: int) -> Vocabulary:
        """From training rows of ``fold`` and ``text``. Common words go to the driver, which their share bounds."""
        counted = rows.mapPartitions(_count_words(parts)).partitionBy(parts, lambda p: p)
        total, total_held, distinct = 0, 0, 0
        for n, held, words in counted.mapPartitions(lambda m: [_totals(m)]).collect():
            total, total_held, distinct = total + n, total_held + held, distinct + words

        def common(messages: Iterable) -> list[tuple[bytes, int, int]]:
            counts, held = _merged(messages)
            return [(w, n, held[w]) for w, n in counts.items() if w == END or n * COMMON_SHARE >= total]

        # The same shuffle files serve this second job.
        found = sorted(counted.mapPartitions(common).collect(), key=lambda r: (r[0] != END, -r[1], r[0]))
        if not found or found[0][0] != END:
            found.insert(0, (END, 0, 0))
        counts, kept = np.zeros(RARE + 1, np.int64), np.zeros(RARE + 1, np.int64)
        counts[: len(found)] = [n for _, n, _ in found]
        kept[: len(found)] = [n - held for _, n, held in found]
        counts[RARE], kept[RARE] = total - counts.sum(), total - total_held - kept.sum()
        return cls([w for w, _, _ in found], counts, kept, total, distinct, distinct - sum(n > 0 for _, n, _ in found))


def _count_words(parts: int):
    """A function for each input partition: its counts of distinct words as messages (hash partition, content)."""

    def run(rows: Iterable) -> Iterator[tuple]:
        seen: dict[bool, Counter] = {False: Counter(), True: Counter()}

        def flush(held: bool) -> Iterator[tuple]:
            to: dict[int, tuple[list, list]] = {}
            for w, n in seen[held].items():
                words, counts = to.setdefault(zlib.crc32(w) % parts, ([], []))
                words.append(w)
                counts.append(n)
            seen[held].clear()
            for p, (words, counts) in to.items():
                yield p, (b"\n".join(words), np.array(counts, np.int64).tobytes(), held)

        for fold, text in rows:
            held = fold == HELD_FOLD
            seen[held].update(plain_words(bytes(text) if text is not None else None))
            seen[held][END] += 1
            if len(seen[held]) > COUNTED_WORDS:
                yield from flush(held)
        yield from flush(False)
        yield from flush(True)

    return run


def _merged(messages: Iterable) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """Counts by word of one hash partition, and those of the held-out fold."""
    counts: dict[bytes, int] = defaultdict(int)
    held: dict[bytes, int] = defaultdict(int)
    for _, (words, numbers, is_held) in messages:
        # No word has a line break in it either.
        for w, n in zip(words.split(b"\n"), np.frombuffer(numbers, np.int64).tolist()):
            counts[w] += n
            if is_held:
                held[w] += n
    return counts, held


def _totals(messages: Iterable) -> tuple[int, int, int]:
    counts, held = _merged(messages)
    return sum(counts.values()), sum(held.values()), len(counts)


@dataclass
class BigramModel:
    """Probability of a class after a class, and of a rare word in its class."""

    vocabulary: Vocabulary
    weights: np.ndarray

    def probabilities(self, before, after, together, counts: np.ndarray) -> np.ndarray:
        """Bigram and unigram maximum-likelihood estimates and the uniform part, by column, for classes and the count of the pair."""
        context = counts[before]
        bigram = np.where(context > 0, together / np.maximum(context, 1), 0.0)
        unigram = counts[after] / max(1, counts.sum())
        return np.stack([bigram, unigram, np.full(len(bigram), 1 / (len(self.vocabulary.words) + 1))], axis=1)

    def log10(self, before: np.ndarray, after: np.ndarray, together: np.ndarray) -> np.ndarray:
        v = self.vocabulary
        parts = self.probabilities(before, after, together, v.counts)
        mixed = (parts * self.weights[buckets_of(v.counts[before])]).sum(axis=1)
        return np.log10(mixed) - np.where(after == RARE, math.log10(v.rare_words + 1), 0.0)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs of equal values."""
    edges = np.flatnonzero(np.diff(values)) + 1
    starts = np.concatenate([[0], edges]).astype(np.int64)
    return values[starts], np.diff(np.concatenate([starts, [len(values)]]))


def _emit(shared, parts: int):
    """A function for each input partition: its rows become messages (hash partition, block, content)."""

    def blocks(index: int, rows: Iterable) -> Iterator[tuple]:
        classes, log_count, known_class = shared.value
        held: list[tuple] = []
        words: list[bytes] = []
        number = 0

        def block() -> Iterator[tuple]:
            name = (index << 32) + number
            lengths = np.array([h[2] for h in held])
            row = np.repeat(np.arange(len(held), dtype=np.uint16), lengths)
            after = np.array([classes.get(w, RARE) for w in words], np.uint32)
            before = np.concatenate([[0], after[:-1]]).astype(np.uint32)
            keys = before << np.uint32(16) | after
            rare = np.flatnonzero(after == RARE)
            digest = xxhash.xxh64_intdigest
            hashes = np.fromiter((digest(words[i]) for i in rare.tolist()), np.uint64, len(rare))
            common = after != RARE
            base = np.bincount(row, np.where(common, log_count[after], 0.0), len(held))
            known = np.bincount(row, common & known_class[after], len(held)).astype(np.int64)
            part = np.array([h[1] for h in held], np.uint8)
            meta = ([h[0] for h in held], [h[3] for h in held], lengths.tolist(), base, known)
            yield (name >> 1) % parts, ("rows", name, meta)
            spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for kind, key, mix, of in (("pairs", keys, spread, row), ("rare", hashes, hashes, row[rare])):
                to = (mix >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                order = np.argsort(to.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
                to, key, of = to[order], key[order], of[order]
                ids, sizes = _runs(to) if len(to) else (to, [])
                at = 0
                for p, size in zip(np.asarray(ids).tolist(), np.asarray(sizes).tolist()):
                    which, counts = _runs(of[at : at + size])
                    content = (key[at : at + size].tobytes(), which.tobytes(), counts.astype(np.uint32).tobytes(), part[which].tobytes())
                    yield p, (kind, name, content)
                    at += size

        for doc_id, fold, part, text in rows:
            found = plain_words(bytes(text) if text is not None else None)
            held.append((doc_id, part, len(found) + 1, fold))
            words += found
            words.append(END)
            if len(words) >= BLOCK_TOKENS or len(held) == BLOCK_ROWS:
                yield from block()
                held, words, number = [], [], number + 1
        if held:
            yield from block()

    return blocks


def _by_kind(messages: Iterable) -> dict[str, list]:
    """Messages of one hash partition as (block, content), by kind; whoever gathers a kind takes it out."""
    found: dict[str, list] = {}
    for _, (kind, name, content) in messages:
        found.setdefault(kind, []).append((name, content))
    return found


def _gather(messages: list, dtype) -> tuple:
    """Keys of one hash partition with, for every run of keys of one row, its row, length, part and block."""
    join = lambda i, t: np.concatenate([np.frombuffer(c[i], t) for _, c in messages] or [np.zeros(0, t)])
    runs = [len(c[1]) // 2 for _, c in messages]
    block = np.repeat(np.array([name for name, _ in messages], np.int64), runs)
    return join(0, dtype), join(1, np.uint16), join(2, np.uint32).astype(np.int64), join(3, np.uint8), block


def _em_statistics(model: BigramModel):
    """Held-out tokens of a partition by bucket and, on a logarithmic grid, the ratio of both estimates to the uniform part."""

    def statistics(parts: Iterable) -> Iterator[tuple[int, int]]:
        keys, _, size, train, _ = _gather(_by_kind(parts).pop("pairs", []), np.uint32)
        kind = np.repeat(train, size)  # 0: not for training, 1: kept, 2: held out
        distinct, which = np.unique(keys, return_inverse=True)
        kept = np.bincount(which, kind == 1, len(distinct))
        held = np.bincount(which, kind == 2, len(distinct)).astype(np.int64)
        at = np.flatnonzero(held)
        before, after = (distinct[at] >> 16).astype(np.int64), (distinct[at] & RARE).astype(np.int64)
        p = model.probabilities(before, after, kept[at], model.vocabulary.kept)
        with np.errstate(divide="ignore"):
            steps = np.round(_GRID * np.log2(p[:, :2] / p[:, 2:])).clip(-_SPAN // 2 + 1, _SPAN // 2 - 1)
        cell = (steps + _SPAN // 2).astype(np.int64)
        cell[p[:, :2] == 0] = 0
        code = (buckets_of(model.vocabulary.kept[before]) * _SPAN + cell[:, 0]) * _SPAN + cell[:, 1]
        codes, back = np.unique(code, return_inverse=True)
        sums = np.bincount(back, held[at], len(codes)).astype(np.int64)
        return zip(codes.tolist(), sums.tolist())

    return statistics


def _scores(shared_model):
    """Sums for each block and row of a hash partition: log probability, base score, known words."""

    def scores(parts: Iterable) -> Iterator[tuple]:
        model: BigramModel = shared_model.value
        v, messages = model.vocabulary, _by_kind(parts)
        keys, row, size, train, block = _gather(messages.pop("pairs", []), np.uint32)
        distinct, which = np.unique(keys, return_inverse=True)
        counts = np.bincount(which, np.repeat(train > 0, size), len(distinct))
        value = model.log10((distinct >> 16).astype(np.int64), (distinct & RARE).astype(np.int64), counts)
        yield from _by_block(block, row, size, [value[which]])
        keys, row, size, train, block = _gather(messages.pop("rare", []), np.uint64)
        distinct, which = np.unique(keys, return_inverse=True)
        counts = np.bincount(which, np.repeat(train > 0, size), len(distinct))
        base = np.log10((counts + 1) / (v.tokens + v.distinct + 1))
        yield from _by_block(block, row, size, [np.zeros(len(which)), base[which], (counts > 0)[which].astype(float)])
        for name, content in messages.pop("rows", []):
            yield name, ("rows", content)

    return scores


def _by_block(block: np.ndarray, row: np.ndarray, size: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple]:
    if not len(row):
        return
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    sums = [np.add.reduceat(x, starts) for x in values]
    order = np.argsort(block, kind="stable")
    names, lengths = _runs(block[order])
    at = 0
    for name, n in zip(names.tolist(), lengths.tolist()):
        pick = order[at : at + n]
        yield name, ("sums", (row[pick].tobytes(), [s[pick].tobytes() for s in sums]))
        at += n


def _finish(parts: Iterable) -> Iterator[tuple]:
    """Rows of blocks from their parts: ids and own sums once, and sums from hash partitions."""
    blocks: dict[int, list] = {}
    totals: dict[int, np.ndarray] = {}
    for name, (kind, content) in parts:
        if kind == "rows":
            blocks[name] = content
            continue
        # Sized on first sight for the largest block; only the rows that exist are read.
        total = totals.setdefault(name, np.zeros((3, BLOCK_ROWS)))
        row = np.frombuffer(content[0], np.uint16)
        for k, x in enumerate(content[1]):
            np.add.at(total[k], row, np.frombuffer(x))
    for name, (ids, folds, lengths, base, known) in blocks.items():
        total = totals[name]
        for i, (doc_id, fold, n) in enumerate(zip(ids, folds, lengths)):
            yield doc_id, fold, n, int(known[i] + total[2, i]), float(base[i] + total[1, i]), float(total[0, i])


def score(docs: DataFrame, fold: Column, held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs`` (``doc_id, text``).

    ``fold`` numbers rows from 0 to ``FOLDS`` - 1; the model learns from all rows
    but those of fold ``held_out``; a null fold (a null id) trains. Tokens are
    plain words and one end for each row; a null text is empty. ``base_score``
    is the add-one unigram score, ``score`` the model's log10 probability:
    the class of each token given the class before, times one over the number
    of rare words (and one) for a rare word. With nothing to learn from, the
    base is 0 and the model uniform.

    Rows are read in blocks; all their bigrams and rare words go to hash
    partitions, which count them, once, and serve both the statistics for the
    mixture weights and the scores. Only numbers come back to the blocks.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(
        F.col("doc_id").cast("long"), fold.cast("int").alias("fold"), text_bytes().alias("text"),
    )
    trains = F.coalesce(F.col("fold") != held_out, F.lit(True))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // PARTITION_BYTES))
    vocabulary = Vocabulary.count(rows.where(trains).select("fold", "text").rdd, parts)
    denominator = vocabulary.tokens + vocabulary.distinct + 1
    shared = context.broadcast((
        {w: i for i, w in enumerate(vocabulary.words)},
        np.log10((vocabulary.counts + 1) / denominator),
        vocabulary.counts > 0,
    ))
    # 0: not for training, 1: kept, 2: held out while the weights are learned.
    part_of = F.when(~trains, 0).when(F.col("fold") == HELD_FOLD, 2).otherwise(1)
    source = rows.select("doc_id", "fold", part_of.alias("part"), "text").rdd
    messages = source.mapPartitionsWithIndex(_emit(shared, parts)).partitionBy(parts, lambda p: p)
    flat = BigramModel(vocabulary, np.full((64, 3), 1 / 3))
    # The grid bounds what is collected.
    cells = messages.mapPartitions(_em_statistics(flat)).reduceByKey(lambda a, b: a + b, 16).collect()
    code = np.array([c for c, _ in sorted(cells)], np.int64)
    weight = np.array([w for _, w in sorted(cells)], np.float64)
    grid = np.stack([code // _SPAN % _SPAN, code % _SPAN], axis=1)
    ratio = np.where(grid == 0, 0.0, 2.0 ** ((grid - _SPAN // 2) / _GRID))
    p = np.concatenate([ratio, np.ones((len(code), 1))], axis=1) / (len(vocabulary.words) + 1)
    model = context.broadcast(BigramModel(vocabulary, learn_weights(code // _SPAN**2, p, weight)))
    # The same shuffle files serve this second job.
    sums = messages.mapPartitions(_scores(model))
    done = sums.partitionBy(max(1, parts // 2), lambda name: hash((name >> 32, name & 0xFFFFFFFF))).mapPartitions(_finish)
    schema = "doc_id long, fold int, n_tokens long, n_known long, base_score double, score double"
    scored = spark.createDataFrame(done, StructType.fromDDL(schema), verifySchema=False)
    return scored.select(
        "doc_id", F.coalesce(F.col("fold") == held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
