"""Bigram language model by deleted interpolation over all words, counted in hash partitions block by block."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import plain_words, text_bytes
from .ngram_lm import END, HELD_FOLD, PARTITION_BYTES, buckets_of, learn_weights

#: Tokens of a block, at least; only a block's last row goes beyond.
BLOCK_TOKENS = 1 << 19
_GRID = 8  # steps to an octave in the statistics for EM
_SPAN = 1024  # steps in all; 0 stands for a count of 0


def packed(values: np.ndarray, low: bool = True) -> tuple[int, bytes]:
    """Numbers from 0 on as bytes of equal rank, without ranks that are all zero; ``low`` numbers are also deflated."""
    values = np.ascontiguousarray(values, "<u8")
    ranks = -(-int(values.max(initial=0)).bit_length() // 8)
    planes = values.view(np.uint8).reshape(-1, 8).T[:ranks].tobytes()
    return len(values), zlib.compress(planes, 1) if low else planes


def unpacked(content: tuple[int, bytes], low: bool = True) -> np.ndarray:
    n, planes = content
    found = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(zlib.decompress(planes) if low else planes, np.uint8)
    if len(planes):
        found[:, : len(planes) // n] = planes.reshape(-1, n).T
    return found.view("<u8").ravel()


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64 bits for each pair of word hashes, by order."""
    return before * np.uint64(0x9E3779B97F4A7C15) + after


@dataclass
class Block:
    """Rows with the tokens of all of them: each token is a place in ``table``, the hashes of the block's words; place 0 is the end."""

    ids: list
    folds: list
    parts: np.ndarray  # by row; 0: not for training, 1: kept, 2: held out while the weights are learned
    lengths: np.ndarray
    table: np.ndarray
    tokens: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs, as ``before * len(table) + after``, and for each token which one it ends."""
        after = self.tokens.astype(np.int64)
        before = np.concatenate([[0], after[:-1]])
        return np.unique(before * len(self.table) + after, return_inverse=True)

    def keys(self, pairs: np.ndarray) -> np.ndarray:
        return pair_keys(self.table[pairs // len(self.table)], self.table[pairs % len(self.table)])

    def packed(self) -> tuple:
        return self.ids, self.folds, self.parts.tobytes(), self.lengths.tobytes(), self.table.tobytes(), packed(self.tokens)

    @classmethod
    def unpacked(cls, content: tuple) -> Block:
        ids, folds, parts, lengths, table, tokens = content
        table = np.frombuffer(table, np.uint64)
        return cls(ids, folds, np.frombuffer(parts, np.uint8), np.frombuffer(lengths, np.int64), table, unpacked(tokens).astype(np.uint32))


def blocks_of(rows: Iterable) -> Iterator[Block]:
    """Blocks of rows of ``doc_id, fold, part, text``."""
    held: list[tuple] = []
    at: list[int] = []
    seen: dict[bytes, int] = {END: 0}

    def block() -> Block:
        table = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))
        ids, folds, parts, lengths = zip(*held)
        return Block(list(ids), list(folds), np.array(parts, np.uint8), np.array(lengths, np.int64), table, np.array(at, np.uint32))

    for doc_id, fold, part, text in rows:
        words = plain_words(bytes(text) if text is not None else None)
        held.append((doc_id, fold, part, len(words) + 1))
        at += [seen.setdefault(w, len(seen)) for w in words]
        at.append(0)
        if len(at) >= BLOCK_TOKENS:
            yield block()
            held, at, seen = [], [], {END: 0}
    if held:
        yield block()


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys spread over 64 bits in rising order, their order, and the edges between hash partitions."""
    spread = keys * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(spread)
    spread = spread[order]
    to = ((spread >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return spread, order, np.searchsorted(to, np.arange(parts + 1))


def _asked(parts: int):
    """A function for each input partition: the distinct words and pairs of each block with their counts, by hash partition."""

    def run(index: int, rows: Iterable) -> Iterator[tuple]:
        for number, block in enumerate(blocks_of(rows)):
            part = np.repeat(block.parts, block.lengths)
            pairs, which = block.pairs()
            sides = []
            for keys, at in ((block.table, block.tokens), (block.keys(pairs), which)):
                spread, order, edges = _dealt(keys, parts)
                counts = [np.bincount(at[part == k], minlength=len(keys))[order] for k in (1, 2)]
                sides.append((edges, spread, *counts))
            for p in range(parts):
                cut = [[x[e[p] : e[p + 1]] for x in arrays] for e, *arrays in sides]
                if len(cut[0][0]) or len(cut[1][0]):
                    # Keys rise, so their distances are smaller than they are.
                    keys = [(int(k[0]), packed(np.diff(k), False)) if len(k) else None for k, *_ in cut]
                    yield p, ((index << 32) + number, keys, packed(np.concatenate([x for _, *counts in cut for x in counts])))

    return run


def _keys_of(content: tuple | None) -> np.ndarray:
    if content is None:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.array([content[0]], np.uint64), unpacked(content[1], False)]), dtype=np.uint64)


def _answered(messages: Iterable) -> Iterator[tuple]:
    """Counts of one hash partition back to each block, in the order in which it asked; and the number of words seen in training."""
    asked, p = [], None
    for p, message in messages:
        asked.append(message)
    if p is None:
        return
    answers = []
    for side in range(2):
        keys = [_keys_of(m[1][side]) for m in asked]
        sizes = np.array([len(k) for k in keys])
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros((2, len(distinct)), np.int64)
        at = 0
        for (_, (words, pairs), counts), n in zip(asked, sizes.tolist()):
            counts, mine = unpacked(counts).astype(np.int64), which[at : at + n]
            counts = counts[: 2 * n] if side == 0 else counts[len(counts) - 2 * n :]
            # A message has a key once.
            sums[:, mine] += counts.reshape(2, n)
            at += n
        if side == 0:
            yield -1 - p, ("distinct", int(np.count_nonzero(sums.sum(axis=0))))
        edges = np.cumsum([0, *sizes])
        answers.append((sums, [which[a:b] for a, b in zip(edges, edges[1:])]))
    (words, word_at), (pairs, pair_at) = answers
    for (name, _, _), w, q in zip(asked, word_at, pair_at):
        yield name, ("counts", (p, len(w), packed(np.concatenate([words[:, w].ravel(), pairs[:, q].ravel()]))))


def _told(rows: Iterable, index: int) -> Iterator[tuple]:
    for number, block in enumerate(blocks_of(rows)):
        yield (index << 32) + number, ("rows", block.packed())


@dataclass
class Counted:
    """A block with the counts of its words (by place in the table) and pairs in all training rows and without the held-out fold."""

    block: Block
    which: np.ndarray  # pair of each token
    words: tuple[np.ndarray, np.ndarray]  # all, kept
    pairs: tuple[np.ndarray, np.ndarray]

    def of_tokens(self, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each token's context, of itself, and of both together."""
        mine = self.words[kept][self.block.tokens]
        return np.concatenate([self.words[kept][:1], mine[:-1]]), mine, self.pairs[kept][self.which]


def _joined(messages: Iterable, parts: int) -> Iterator[Counted]:
    """The blocks of one partition, put together from their rows and the counts that hash partitions sent."""
    rows: dict[int, tuple] = {}
    counts: dict[int, list[tuple]] = {}
    for name, (kind, content) in messages:
        if kind == "rows":
            rows[name] = content
        elif kind == "counts":
            counts.setdefault(name, []).append(content)
    if counts.keys() != rows.keys():
        raise RuntimeError("the input was read in two different orders")
    for name in sorted(rows):
        block, got = Block.unpacked(rows.pop(name)), sorted(counts.pop(name))
        pairs, which = block.pairs()
        values = [unpacked(c[2]).astype(np.int64) for c in got]
        sides = ([v[: 2 * c[1]] for c, v in zip(got, values)], [v[2 * c[1] :] for c, v in zip(got, values)])
        found = []
        for side, keys in zip(sides, (block.table, block.keys(pairs))):
            _, order, edges = _dealt(keys, parts)
            sizes = {c[0]: len(v) // 2 for c, v in zip(got, side)}
            if [sizes.get(p, 0) for p in range(parts)] != np.diff(edges).tolist():
                raise RuntimeError("the input was read in two different orders")
            kept, held = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
            kept[order] = np.concatenate([v[: len(v) // 2] for v in side])
            held[order] = np.concatenate([v[len(v) // 2 :] for v in side])
            found.append((kept + held, kept))
        yield Counted(block, which, *found)


def _cells(parts: int):
    """Held-out tokens by bucket and, on a logarithmic grid, count of the pair over that of its context and count of the word; and totals."""

    def grid(values: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            steps = np.round(_GRID * np.log2(values)).clip(-_SPAN // 2 + 1, _SPAN // 2 - 1)
        return np.where(values > 0, steps + _SPAN // 2, 0).astype(np.int64)

    def run(messages: Iterable) -> Iterator[tuple]:
        distinct = 0

        def others() -> Iterator[tuple]:
            nonlocal distinct
            for name, (kind, content) in messages:
                if kind == "distinct":
                    distinct += content
                else:
                    yield name, (kind, content)

        for counted in _joined(others(), parts):
            part = np.repeat(counted.block.parts, counted.block.lengths)
            yield "kept", int(np.count_nonzero(part == 1))
            yield "held", int(np.count_nonzero(part == 2))
            context, mine, both = (x[part == 2] for x in counted.of_tokens(1))
            code = (buckets_of(context) * _SPAN + grid(both / np.maximum(context, 1))) * _SPAN + grid(mine)
            codes, n = np.unique(code, return_counts=True)
            yield from zip(codes.tolist(), n.tolist())
        yield "distinct", distinct

    return run


@dataclass
class WordModel:
    """Weights by bucket, and totals: training tokens, and distinct words of them. One more class stands for all words never seen."""

    weights: np.ndarray
    tokens: int
    distinct: int

    def log10(self, context: np.ndarray, mine: np.ndarray, both: np.ndarray) -> np.ndarray:
        """From the counts of the context, of the word, and of both together."""
        pair = np.where(context > 0, both / np.maximum(context, 1), 0.0)
        parts = np.stack([pair, mine / max(1, self.tokens), np.full(len(pair), 1 / (self.distinct + 1))], axis=1)
        return np.log10((parts * self.weights[buckets_of(context)]).sum(axis=1))

    def base(self, mine: np.ndarray) -> np.ndarray:
        return np.log10((mine + 1) / (self.tokens + self.distinct + 1))


def _scored(model: WordModel, parts: int):
    def run(messages: Iterable) -> Iterator[tuple]:
        for counted in _joined(((n, m) for n, m in messages if m[0] != "distinct"), parts):
            block = counted.block
            context, mine, both = counted.of_tokens(0)
            starts = np.cumsum(block.lengths) - block.lengths
            known, base, score = (np.add.reduceat(x, starts) for x in ((mine > 0).astype(np.int64), model.base(mine), model.log10(context, mine, both)))
            yield from zip(block.ids, block.folds, block.lengths.tolist(), known.tolist(), base.tolist(), score.tolist())

    return run


def score(docs: DataFrame, fold: Column, held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs`` (``doc_id, text``).

    The model learns from all rows but those whose ``fold`` is ``held_out``; a
    null fold (a null id) trains. Tokens are plain words and one end for each
    row; a null text is empty. ``base_score`` is the add-one unigram score,
    ``score`` the log10 probability by bigrams, unigrams and a uniform part.
    Every word has counts of its own, by its 64-bit hash. With nothing to learn
    from, the base is 0 and the model uniform.

    A block of rows sends each of its distinct words and pairs once, with their
    counts, to hash partitions, so a key that fills the corpus is as many
    entries as there are blocks. The sums go back to the blocks, which score
    their rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), fold.cast("int").alias("fold"), text_bytes().alias("text"))
    trains = F.coalesce(F.col("fold") != held_out, F.lit(True))
    part_of = F.when(~trains, 0).when(F.col("fold") == HELD_FOLD, 2).otherwise(1)
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // PARTITION_BYTES))
    source = rows.select("doc_id", "fold", part_of.alias("part"), "text").rdd
    answers = source.mapPartitionsWithIndex(_asked(parts)).partitionBy(parts, lambda p: p).mapPartitions(_answered)
    told = source.mapPartitionsWithIndex(lambda index, rows: _told(rows, index))
    # Both jobs below use the same shuffle files.
    blocks = told.union(answers).partitionBy(parts, lambda name: hash((name >> 32, name & 0xFFFFFFFF)))
    # The grid bounds what is collected.
    cells = dict(blocks.mapPartitions(_cells(parts)).reduceByKey(lambda a, b: a + b, 16).collect())
    kept, held, distinct = (cells.pop(n, 0) for n in ("kept", "held", "distinct"))
    code = np.array(sorted(cells), np.int64)
    weight = np.array([cells[c] for c in sorted(cells)], np.float64)
    grid = np.stack([code // _SPAN % _SPAN, code % _SPAN], axis=1)
    pair, word = np.where(grid == 0, 0.0, 2.0 ** ((grid - _SPAN // 2) / _GRID)).T
    p = np.stack([pair, word / max(1, kept), np.full(len(code), 1 / (distinct + 1))], axis=1)
    weights = learn_weights(code // _SPAN**2, p, weight) if kept + held else np.tile([0.0, 0.0, 1.0], (64, 1))
    model = WordModel(weights, kept + held, distinct)
    schema = "doc_id long, fold int, n_tokens long, n_known long, base_score double, score double"
    scored = spark.createDataFrame(blocks.mapPartitions(_scored(model, parts)), StructType.fromDDL(schema), verifySchema=False)
    return scored.select(
        "doc_id", F.coalesce(F.col("fold") == held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
