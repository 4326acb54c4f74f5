"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import letter_words, map_rows, text_bytes

BUCKETS = 1 << 16
EMBEDDING = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Labelled rows of each class that training takes at most, chosen by a hash of the id.
FIT_ROWS = 3_000
EPOCHS = 4
CUT = 0.7
# Common words by which a text's language is told for calibration.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with on by this are from or as be at he",
    "de": "der die und das nicht von sie ist des sich mit dem dass er es ein ich auf so eine zu",
    "fr": "le la les et des en un du une que est pour qui dans pas au par sur ce plus se",
    "es": "el los las y del que en un por con una para es al lo como más pero sus se su",
}
OTHER = "other"
#: Stands for every text; its threshold serves languages with few toxic ones.
ALL = "all"
#: Bins of the threshold search for one unit of log odds.
BINS = 100
_VOTES: dict[bytes, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _VOTES.setdefault(_w.encode(), []).append(_lang)


def buckets_of(word: bytes) -> tuple[int, int, int]:
    """Hash buckets of a word and of its first four and five characters, which stand for its forms."""
    text = word.decode("utf-8", "replace")
    pieces = (word, b"4" + text[:4].encode(), b"5" + text[:5].encode())
    return tuple(1 + zlib.crc32(p) % (BUCKETS - 1) for p in pieces)


def language_of(words: list[bytes]) -> str:
    """The language with most function words among ``words``; ``other`` without any, ties by name."""
    votes = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in words:
        for lang in _VOTES.get(w, ()):
            votes[lang] += 1
    best = min(votes, key=lambda x: (-votes[x], x))
    return best if votes[best] else OTHER


def word_index(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct words, index of every word in them, and number of words of each text."""
    seen: dict[bytes, int] = {}
    at = [seen.setdefault(w, len(seen)) for words in texts for w in words]
    table = np.array([buckets_of(w) for w in seen], np.int32).reshape(-1, 3)
    return table, np.array(at, np.int32), np.array([len(t) for t in texts], np.int64)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


@dataclass
class ToxicityModel:
    """Embedding, filters by width and offset, output layer, and the raw score that counts as ``CUT`` by language."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, EMBEDDING, FILTERS)
    out: np.ndarray
    bias: float
    cuts: dict[str, float]

    def pooled(self, table: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Largest response of each filter in each text, 0 if none is above; and where it is, by width."""
        n, starts = len(lengths), _starts(lengths)
        word = self.embedding[table].sum(axis=1)
        found = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        where: dict[int, np.ndarray] = {}
        for k, width in enumerate(WIDTHS):
            has = np.flatnonzero(lengths >= width)
            where[width] = np.full((n, FILTERS), -1, np.int64)
            if not len(has):
                continue
            # Rows that begin a window; windows that would cross into the next text stay out.
            counts = lengths[has] - width + 1
            begins = np.repeat(starts[has] - _starts(counts), counts) + np.arange(counts.sum())
            response = sum((word @ self.filters[width][j])[at[begins + j]] for j in range(width))
            edges = _starts(counts)
            top = np.maximum.reduceat(response, edges, axis=0)
            found[has, k * FILTERS : (k + 1) * FILTERS] = np.maximum(top, 0)
            if self.training:
                for f in range(FILTERS):
                    same = np.flatnonzero(response[:, f] == np.repeat(top[:, f], counts))
                    text = np.searchsorted(edges, same, "right") - 1
                    first = np.full(len(has), -1, np.int64)
                    first[text[::-1]] = begins[same[::-1]]
                    first[top[:, f] <= 0] = -1
                    where[width][has, f] = first
        return found, where

    training = False

    def raw(self, table: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        found, _ = self.pooled(table, at, lengths)
        return 1 / (1 + np.exp(-np.clip(found @ self.out + self.bias, -30, 30)))

    def calibrated(self, raw: np.ndarray, langs: list[str]) -> np.ndarray:
        """Raw scores stretched on both sides of the language's threshold, which becomes ``CUT``."""
        cut = np.array([self.cuts.get(x, self.cuts[ALL]) for x in langs])
        low, high = CUT * raw / cut, CUT + (1 - CUT) * (raw - cut) / (1 - cut)
        # Rounding must not lift a score over the cut.
        return np.where(raw >= cut, np.clip(high, CUT, 1), np.clip(low, 0, np.nextafter(CUT, 0)))


def _init(table: np.ndarray, at: np.ndarray, lengths: np.ndarray, y: np.ndarray, rng) -> ToxicityModel:
    """Random weights, but the first embedding component starts at the log odds of the label by bucket."""
    for_one, for_none, starts = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), _starts(lengths)
    for i in range(0, len(lengths), 256):
        size = lengths[i : i + 256]
        text = np.repeat(np.arange(len(size)), size)
        # A bucket counts once for a text.
        pairs = np.unique(text[:, None] * BUCKETS + table[at[starts[i] : starts[i] + size.sum()]])
        label, bucket = y[i + pairs // BUCKETS], pairs % BUCKETS
        for_one += np.bincount(bucket[label == 1], minlength=BUCKETS)
        for_none += np.bincount(bucket[label == 0], minlength=BUCKETS)
    odds = np.log((for_one + 0.5) / (y.sum() + 1)) - np.log((for_none + 0.5) / (len(y) - y.sum() + 1))
    odds[for_one + for_none < 2] = 0
    embedding = rng.normal(0, 0.05, (BUCKETS, EMBEDDING)).astype(np.float32)
    embedding[:, 0] = np.clip(odds, -1, 8) / 8
    embedding[0] = 0
    filters = {w: rng.normal(0, 0.2, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][:, 0, : FILTERS // 2] = 1.0
    out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS)
    out[: FILTERS // 2] = 0.5
    return ToxicityModel(embedding, filters, out.astype(np.float32), -1.0, {ALL: 0.5})


#: Weight and number of labelled texts by language, bin of the raw score, and label.
Cells = dict[tuple[str, int, int], tuple[float, int]]


def train(
    texts: list[np.ndarray], y: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 3
) -> tuple[ToxicityModel, Cells]:
    """Train on labelled texts, each an array of words, a word its three buckets in one number; a fifth is kept for the thresholds.

    The cells hold that fifth, weighted to stand for all texts of its class.
    Without texts of both classes the score is the share of class 1.
    """
    rng = np.random.default_rng(seed)
    lengths = np.array([len(t) for t in texts], np.int64)
    codes, at = np.unique(np.concatenate([*texts, np.zeros(0, np.uint64)]), return_inverse=True)
    at = at.astype(np.int32)
    table = np.stack([codes >> np.uint64(shift) & np.uint64(BUCKETS - 1) for shift in (0, 16, 32)], axis=1).astype(np.int32)
    kept = rng.random(len(y)) < 0.2
    if y[~kept].sum() < 5 or y[kept].sum() < 2:
        kept[:] = False
    starts = _starts(lengths) if len(lengths) else lengths

    def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([at[starts[i] : starts[i] + lengths[i]] for i in rows] or [at[:0]]), lengths[rows]

    learn = np.flatnonzero(~kept)
    model = _init(table, *part(learn), y[learn], rng) if len(learn) else _init(table, at, lengths, y, rng)
    if not 0 < y.sum() < len(y):
        model.out[:] = 0
        share = float(np.clip(y.mean() if len(y) else 0, 0.01, 0.99))
        model.bias = float(np.log(share / (1 - share)))
        return model, {}
    model.training = True
    weights = [model.embedding, *model.filters.values(), model.out]
    squares = [np.full_like(w, 1e-4) for w in weights]

    def step(k: int, gradient: np.ndarray, rows=...) -> None:
        """One step of Adagrad."""
        squares[k][rows] += gradient**2
        weights[k][rows] -= 0.05 * gradient / np.sqrt(squares[k][rows])

    bias_square = 1e-4
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(learn), -(-len(learn) // 32)):
            part_at, part_lengths = part(batch)
            used, local = np.unique(part_at, return_inverse=True)
            sub = table[used]
            found, where = model.pooled(sub, local, part_lengths)
            p = 1 / (1 + np.exp(-np.clip(found @ model.out + model.bias, -30, 30)))
            error = ((p - y[batch]) / len(batch)).astype(np.float32)
            back = error[:, None] * model.out
            touched: list[tuple[np.ndarray, np.ndarray]] = []
            word = model.embedding[sub].sum(axis=1)
            for k, width in enumerate(WIDTHS):
                grad = np.zeros_like(model.filters[width])
                for f in range(FILTERS):
                    text = np.flatnonzero(where[width][:, f] >= 0)
                    if not len(text):
                        continue
                    g = back[text, k * FILTERS + f]
                    for j in range(width):
                        w = local[where[width][text, f] + j]
                        grad[j, :, f] = g @ word[w]
                        touched.append((w, g[:, None] * model.filters[width][j, :, f]))
                step(1 + k, grad)
            step(len(weights) - 1, found.T @ error)
            bias_square += error.sum() ** 2
            model.bias -= 0.05 * float(error.sum()) / float(np.sqrt(bias_square))
            if touched:
                w = np.concatenate([t[0] for t in touched])
                g = np.concatenate([t[1] for t in touched])
                buckets, which = np.unique(sub[w].ravel(), return_inverse=True)
                total = np.zeros((len(buckets), EMBEDDING), np.float32)
                np.add.at(total, which, np.repeat(g, 3, axis=0))
                step(0, total, buckets)
    model.training = False
    judged = np.flatnonzero(kept) if kept.any() else learn
    judged = np.concatenate([judged[:0], judged])
    raw = np.concatenate([model.raw(table, *part(b)) for b in np.array_split(judged, -(-len(judged) // 256))])
    cells: Cells = {}
    for i, at_bin in zip(judged.tolist(), bins_of(raw).tolist()):
        weight, n = cells.get((langs[i], at_bin, int(y[i])), (0.0, 0))
        cells[langs[i], at_bin, int(y[i])] = weight + float((y == y[i]).sum() / (y[judged] == y[i]).sum()), n + 1
    return model, cells


def bins_of(raw: np.ndarray) -> np.ndarray:
    """Bins of raw scores, even in the log odds."""
    raw = np.clip(raw.astype(np.float64), 1e-9, 1 - 1e-9)
    return np.floor(np.log(raw / (1 - raw)) * BINS).astype(np.int64)


def thresholds(cells: Cells, least: int = 20) -> dict[str, float]:
    """For each language the raw score, half-way between neighbouring bins, of the best F1; languages with few toxic texts take that of all."""

    def best(mine: list[tuple]) -> float:
        of_bin: dict[int, list[float]] = {}
        for (_, at_bin, toxic), (weight, _) in mine:
            of_bin.setdefault(at_bin, [0.0, 0.0])[toxic] += weight
        order = sorted(of_bin, reverse=True)
        none, some = np.cumsum([of_bin[b] for b in order], axis=0).T
        at = int(np.argmax(2 * some / (none + some + some[-1])))
        edge = lambda b: 1 / (1 + np.exp(-b / BINS))
        below = edge(order[at + 1] + 1) if at + 1 < len(order) else 0
        return float(np.clip((edge(order[at]) + below) / 2, 1e-3, 1 - 1e-3))

    rows = sorted(cells.items())
    cuts = {ALL: best(rows) if any(toxic for (_, _, toxic), _ in rows) else 0.5}
    for lang in sorted({lang for lang, _, _ in cells}):
        mine = [r for r in rows if r[0][0] == lang]
        if sum(n for (_, _, toxic), (_, n) in mine if toxic) >= least:
            cuts[lang] = best(mine)
    return cuts


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, fit_rows: int = FIT_ROWS, epochs: int = EPOCHS) -> ToxicityModel:
    """Train on up to ``fit_rows`` rows of each class among the rows of ``labels`` (``doc_id, toxic``) where ``learn_from`` holds.

    The rows are those of least hash of the id; they are the only ones whose
    words leave Spark, as hash buckets. The thresholds are from all labelled
    rows where ``learn_from`` holds: those outside the sample are scored in
    Spark and counted by language, bin of the score and label; a fifth of the
    sample, not learned from, stands for the sample, so classes keep their
    ratio. An id labelled both ways or more than once counts as toxic if any
    label says so.
    """
    known = labels.where(learn_from & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    order = [F.xxhash64("_id", F.lit(1)), F.col("_id")]
    chosen = known.where("_toxic = 1").orderBy(*order).limit(fit_rows).union(known.where("_toxic = 0").orderBy(*order).limit(fit_rows))
    # Two limits bound this side.
    asked = docs.select(F.col("doc_id").cast("long").alias("_id"), text_bytes().alias("text")).join(F.broadcast(chosen), "_id")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            texts = [letter_words(t) for t in b["text"]]
            table, at, lengths = word_index(texts)
            codes = table.astype("<u8") @ np.array([1, 1 << 16, 1 << 32], "<u8")
            parts = np.split(codes[at], np.cumsum(lengths)[:-1])
            yield {
                "id": b["_id"], "toxic": b["_toxic"], "lang": [language_of(t) for t in texts],
                "cells": [p.tobytes() for p in parts],
            }

    got = map_rows(asked, rows, "id long, toxic int, lang string, cells binary").collect()
    got.sort(key=lambda r: (r.id, r.cells))
    cells = [np.frombuffer(r.cells, "<u8") for r in got]
    model, judged = train(cells, np.array([r.toxic for r in got], np.int64), [r.lang for r in got], epochs)
    if not judged:
        return model

    def bins(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            raw, langs = _raw_scores(b["text"], model)
            yield {"id": b["_id"], "lang": langs, "bin": bins_of(raw)}

    # Texts are not shuffled: all rows with an id are scored, and their bins meet the labels.
    asked = docs.select(F.col("doc_id").cast("long").alias("_id"), text_bytes().alias("text")).where("_id IS NOT NULL")
    scored = map_rows(asked, bins, "id long, lang string, bin long").groupBy("id", "lang", "bin").count()
    others = known.join(F.broadcast(chosen.select("_id")), "_id", "left_anti")
    found = scored.join(others, scored.id == others._id).groupBy("lang", "bin", "_toxic").agg(F.sum("count").alias("n"))
    # Bounded by languages, bins and labels.
    for r in found.collect():
        weight, n = judged.get((r.lang, r.bin, r._toxic), (0.0, 0))
        judged[r.lang, r.bin, r._toxic] = weight + r.n, n + r.n
    model.cuts = thresholds(judged)
    return model


def _raw_scores(texts: list[bytes | None], model: ToxicityModel) -> tuple[np.ndarray, list[str]]:
    """Raw scores and languages of texts, some 200,000 words at a time."""
    found, langs = [np.zeros(0)], []
    held: list[list[bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        held.append(letter_words(t))
        size += len(held[-1])
        if size > 200_000 or i == len(texts) - 1:
            found.append(model.raw(*word_index(held)))
            langs += [language_of(w) for w in held]
            held, size = [], 0
    return np.concatenate(found), langs


def score(docs: DataFrame, model: ToxicityModel, keep: dict[str, Column]) -> DataFrame:
    """``keep`` and ``score`` (0 to 1, at least ``CUT`` for toxic) per row; null and empty texts get the score of no words."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            scores = model.calibrated(*_raw_scores(b.pop("text"), model))
            yield b | {"score": scores}

    asked = docs.select(*[c.alias(n) for n, c in keep.items()], text_bytes().alias("text"))
    kinds = ", ".join(f"`{n}` {k}" for n, k in asked.dtypes if n != "text")
    return map_rows(asked, rows, f"{kinds}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` whose score is under ``CUT``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            for at in range(0, len(texts), 256):
                words = [letter_words(t) for t in texts.slice(at, 256).to_pylist()]
                scores = model.calibrated(model.raw(*word_index(words)), [language_of(w) for w in words])
                yield batch.slice(at, 256).filter(pa.array(scores < CUT))

    return docs.mapInArrow(run, docs.schema)
