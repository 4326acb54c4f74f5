"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_rows

UNKNOWN = "und"
DIM = 512
#: Letters fall into this many classes; class 0 stands for whatever is no letter.
CLASSES = 64
SHARES = 32
#: A worker keeps the vectors of this many trigrams before it starts anew.
CACHED_TRIGRAMS = 32_000


def _letter_classes() -> np.ndarray:
    """Class of every code point of the first plane: a-z have their own, other letters share the rest by a hash."""
    table = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low * 40503 % 65521 % (CLASSES - 27)
    return table


_TABLE: list[np.ndarray] = []


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the letter trigrams of a text; words are set off by one class-0 letter on either side."""
    if not _TABLE:
        _TABLE.append(_letter_classes())
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    letters = _TABLE[0][np.minimum(points, 0xFFFF)]
    beyond = np.flatnonzero(points > 0xFFFF)
    if len(beyond):
        letters[beyond] = [27 + p % (CLASSES - 27) if chr(p).isalpha() else 0 for p in points[beyond].tolist()]
    letters = np.concatenate([[0], letters, [0]]).astype(np.int32)
    keep = letters > 0
    if not keep.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep[1:] |= letters[:-1] > 0  # one gap after each word
    keep[0] = True
    letters = letters[keep]
    codes = (letters[:-2] * CLASSES + letters[1:-1]) * CLASSES + letters[2:]
    codes = codes[letters[1:-1] > 0]
    return np.unique(codes, return_counts=True)


@dataclass
class Hyperspace:
    """Vectors of trigrams: those of their letters, permuted by place and multiplied."""

    dim: int = DIM
    seed: int = 7
    _rows: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        letters = np.random.default_rng(self.seed).choice(np.array([-1, 1], np.int8), (CLASSES, self.dim))
        self.first, self.second, self.third = (np.roll(letters, shift, axis=1) for shift in (2, 1, 0))

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = codes // CLASSES**2, codes // CLASSES % CLASSES, codes % CLASSES
        return (self.first[a] * self.second[b] * self.third[c]).astype(np.float32)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors of trigrams, each as often as it is counted."""
        total = np.zeros(self.dim)
        for at in range(0, len(codes), 4096):
            total += counts[at : at + 4096].astype(np.float32) @ self.vectors(codes[at : at + 4096])
        return total


class CachedSpace(Hyperspace):
    """Keeps the vectors of trigrams it has met in one matrix."""

    def __post_init__(self):
        super().__post_init__()
        self.slot = np.full(CLASSES**3, -1, np.int32)
        self.matrix, self.used = np.zeros((1024, self.dim), np.float32), 0

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        new = codes[self.slot[codes] < 0]
        if len(new) > CACHED_TRIGRAMS:
            return super().bundle(codes, counts)
        if self.used + len(new) > CACHED_TRIGRAMS:
            self.slot[:], self.used = -1, 0
            new = codes
        if len(new):
            while self.used + len(new) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[self.used : self.used + len(new)] = self.vectors(new)
            self.slot[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return counts.astype(np.float32) @ self.matrix[self.slot[codes]]


@dataclass
class LanguageModel:
    """Prototype of each language: its bundled trigrams, less what all languages share."""

    languages: list[str]
    prototypes: np.ndarray
    common: np.ndarray
    space: Hyperspace

    @classmethod
    def fit(cls, docs: DataFrame, space: Hyperspace | None = None) -> LanguageModel:
        """Learn from ``text, lang`` of ``docs``; rows without either are left out.

        Trigrams are counted for each language over all rows. The prototypes,
        ``SHARES`` vectors for each distinct language, go to the driver.
        """
        space = space or Hyperspace()

        def counts(batches: Iterator[dict]) -> Iterator[dict]:
            totals: dict[str, np.ndarray] = {}
            for b in batches:
                for text, lang in zip(b["text"], b["lang"]):
                    codes, n = trigram_counts(text)
                    if lang not in totals:
                        totals[lang] = np.zeros(CLASSES**3, np.int64)
                    totals[lang][codes] += n
            for lang, total in totals.items():
                codes = np.flatnonzero(total)
                yield {"lang": [lang] * len(codes), "code": codes, "n": total[codes]}

        asked = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
        counted = map_rows(asked, counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
        # A language is at most all trigrams; shares of them are bundled apart.
        dims = "lang string, proto array<double>"

        def bundle(key, rows):
            import pyarrow as pa

            total = space.bundle(np.array(rows["code"]), np.array(rows["n"]))
            return pa.table({"lang": [key[0].as_py()], "proto": [total.tolist()]})

        shares = counted.withColumn("share", F.pmod(F.xxhash64("code"), F.lit(SHARES))).groupBy("lang", "share")
        bundles: dict[str, list] = {}
        for r in shares.applyInArrow(bundle, dims).orderBy("lang", "proto").collect():
            bundles.setdefault(r.lang, []).append(r.proto)
        protos = np.array([np.sum(b, axis=0) for b in bundles.values()]).reshape(-1, space.dim)
        unit = protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
        common = unit.mean(axis=0) if len(unit) > 1 else np.zeros(space.dim)
        unit = unit - common
        return cls(list(bundles), unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12), common, space)

    def predict_one(self, text: str | None, space: Hyperspace) -> tuple[str, float]:
        codes, counts = trigram_counts(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        v = space.bundle(codes, counts)
        v = v / max(np.linalg.norm(v), 1e-12) - self.common
        cosines = self.prototypes @ v / max(np.linalg.norm(v), 1e-12)
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1, max(0, (1 + cosines[best]) / 2)))

    def predict(self, docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
        """``keep`` (long or boolean columns), ``lang_pred`` and ``score`` (half of one plus the cosine) per row.

        Null texts and texts without letters are ``und`` with score 0, and so is
        everything if nothing was learned. Of equal cosines the first language
        in order wins.
        """
        model = self

        def rows(batches: Iterator[dict]) -> Iterator[dict]:
            space = CachedSpace(model.space.dim, model.space.seed)
            for b in batches:
                done = [model.predict_one(t, space) for t in b.pop("text")]
                yield b | {"lang_pred": [d[0] for d in done], "score": [d[1] for d in done]}

        asked = docs.select(*[c.alias(n) for n, c in keep.items()], F.col("text").cast("string"))
        kinds = ", ".join(f"{n} {k}" for n, k in asked.dtypes if n != "text")
        return map_rows(asked, rows, f"{kinds}, lang_pred string, score double")
