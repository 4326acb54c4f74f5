"""Secret scan: pattern rules, and a linear-chain conditional random field over tokens.

A token is a run of letters and digits (everything beyond ASCII counts as a
letter) or one other character that isn't white space. The field tags tokens
as *outside*, *begin* or *inside* of a secret. A tag's weight at a token is
the sum of weights of the token's shape, of hashed words around it, and of
features of the whole text; tag pairs have weights too. It learns from a
bounded sample of text slices labelled by the rules, and decodes whole texts
by Viterbi.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_rows, staged, text_bytes

# Kinds in their order, patterns, and the least lengths of what they find.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ASSIGN_LEAST = 12
# A run of 16 or 18 and more is what the open patterns find of that length: their runs can't be longer.
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(rb"[0-9a-f]{16,}")
#: Without one of these no assignment can match.
_KEYS = (b"passw", b"secret", b"token", b"api")
#: The kind of spans that only the field finds.
LEARNED = "crf"
#: They have at least so many bytes.
LEAST_LEARNED = 8

#: About so many rows, by hash, are looked through for slices to learn from, and about so many slices of each kind (with and without a secret) are kept.
FIT_ROWS = 20_000
FIT_SLICES = 600
#: Bytes on either side of a secret (or of a place without one) that a slice holds.
SLICE_BYTES = 120
EPOCHS = 25
#: Added to each token's weight of *outside* when texts are tagged, since the sample holds far more secrets than texts do.
CAUTION = 0.5

OUTSIDE, BEGIN, INSIDE = range(3)


class Span(NamedTuple):
    start: int
    kind: str
    end: int


def base_spans(text: bytes) -> list[Span]:
    """What the rules find: byte offsets, by start, then in the order of ``KINDS``.

    Each kind's matches are leftmost and don't overlap, whole matches; those
    too short are dropped afterwards.
    """
    found = [Span(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    if b"AKIA" in text:
        found += [Span(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [Span(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def _secret_parts(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the secrets themselves, keys left out: what the field learns to tag."""
    found = [m.span() for m in _HEX.finditer(text)] + [m.span() for m in _ACCESS.finditer(text)]
    found += [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start < merged[-1][1]:
            start, end = merged[-1][0], max(end, merged.pop()[1])
        merged.append((start, end))
    return merged


# Features. Bytes are of five classes.
_SPACE, _DIGIT, _LOWER, _UPPER, _MARK = range(5)
_BEYOND = 5
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = _DIGIT, _UPPER, _LOWER, _BEYOND
_HEXDIGIT = np.zeros(256, bool)
_HEXDIGIT[[*range(48, 58), *range(97, 103)]] = True
_FOLDED = np.arange(256, dtype=np.uint64)
_FOLDED[65:91] += 32

_LENGTHS = np.array([2, 3, 4, 6, 8, 12, 16, 24, 40])  # least lengths of the classes after the first
_CHANGES = np.array([1, 2, 3, 5, 9])
_N_LENGTHS, _N_CHANGES = len(_LENGTHS) + 1, len(_CHANGES) + 1
_N_SHAPES = 128 + _N_LENGTHS * 16
_WORDS = 4096
_POWERS = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(64)], np.uint64)
#: Words so many tokens away are features.
_NEAR = (-4, -3, -2, -1, 1)
_SIZES = {
    "shape": _N_SHAPES, "before": _N_SHAPES + 1, "after": _N_SHAPES + 1, "changes": _N_LENGTHS * _N_CHANGES, "hex": _N_LENGTHS * 2,
    "glued": 4, **{f"word{d}": _WORDS + 1 for d in (0, *_NEAR)}, "marks": 5, "digits": 5, "long": 4,
}
_AT = dict(zip(_SIZES, np.cumsum([0, *_SIZES.values()])))
N_FEATURES = sum(_SIZES.values())


class Tokens(NamedTuple):
    """Tokens of several texts one after the other: byte ranges in all of them, the text of each, and feature numbers, a row a kind."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    features: list[np.ndarray]


def tokens_of(texts: list[bytes]) -> Tokens:
    """Tokens and features of ``texts``; offsets count from the first text, each followed by one byte of white space."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    kind = _CLASS[raw]
    word = (kind != _SPACE) & (kind != _MARK)
    joined = word[1:] & word[:-1]
    first = kind != _SPACE
    first[1:] &= ~joined
    last = kind != _SPACE
    last[:-1] &= ~joined
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    n = len(start)
    if not n:
        return Tokens(start, end, start, [])
    length = end - start
    text = np.searchsorted(bounds, start, "right") - 1

    def within(counted: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(counted, dtype=np.int32)])
        return upto[end] - upto[start]

    digits = within(kind == _DIGIT)
    mask = (digits > 0) + 2 * (within(kind == _LOWER) > 0) + 4 * (within(kind == _UPPER) > 0) + 8 * (within(kind == _BEYOND) > 0)
    changed = np.zeros(len(raw), bool)
    changed[1:] = joined & (kind[1:] != kind[:-1])
    changes = within(changed)
    size = np.searchsorted(_LENGTHS, length, "right")
    a_word = word[start]
    shape = np.where(a_word, 128 + size * 16 + mask, raw[start] & 127)

    # The first 64 bytes of a word give its hash; other tokens hash to their byte.
    covered = np.flatnonzero(word)
    place = covered - np.repeat(start[a_word], length[a_word])
    terms = np.zeros(len(raw), np.uint64)
    near = place < len(_POWERS)
    terms[covered[near]] = (_FOLDED[raw[covered[near]]] + np.uint64(1)) * _POWERS[place[near]]
    with np.errstate(over="ignore"):
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        code = np.where(a_word, upto[end] - upto[start], raw[start].astype(np.uint64))
        hashed = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64) + 1

    def moved(values: np.ndarray, by: int) -> np.ndarray:
        """Values ``by`` tokens away in the same text, else 0."""
        out = np.zeros(n, np.int64)
        if abs(by) < n:
            here, there = (slice(-by, None), slice(None, by)) if by < 0 else (slice(None, -by), slice(by, None))
            out[here] = np.where(text[here] == text[there], values[there], 0)
        return out

    gap = np.zeros(n + 1, bool)
    gap[1:-1] = start[1:] == end[:-1]
    per_text = np.bincount(text, minlength=len(texts))

    def share(counted: np.ndarray, cuts: tuple[float, ...]) -> np.ndarray:
        part = np.bincount(text, counted, len(texts)) / np.maximum(per_text, 1)
        return np.searchsorted(np.array(cuts), part, "right")[text]

    features = [
        shape, moved(shape + 1, -1), moved(shape + 1, 1), size * _N_CHANGES + np.searchsorted(_CHANGES, changes, "right"),
        size * 2 + (within(_HEXDIGIT[raw]) == length), 2 * gap[:-1] + gap[1:], np.where((length <= 20) & (digits == 0), hashed, 0),
        *(moved(hashed, d) for d in _NEAR),
        share(~a_word, (0.05, 0.15, 0.3, 0.5)), share(a_word & (digits == length), (0.01, 0.05, 0.1, 0.3)),
        share(length >= 16, (0.001, 0.01, 0.05)),
    ]
    return Tokens(start, end, text, [f.astype(np.int64) + at for f, at in zip(features, _AT.values())])


class Field(NamedTuple):
    """Weights of (feature, tag) and of (tag, next tag)."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, tokens: Tokens) -> np.ndarray:
        return sum((self.emit[f] for f in tokens.features), np.zeros((len(tokens.start), 3), np.float32) + np.float32([CAUTION, 0, 0]))

    def tags(self, tokens: Tokens) -> np.ndarray:
        """The best tag sequence of each text.

        A token whose weight of *outside* exceeds the others by more than twice
        the range of the pair weights is outside on every best path, whatever
        surrounds it. Texts are cut there; what lies between is decoded.
        """
        n = len(tokens.start)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        scores = self.scores(tokens)
        sure = scores[:, OUTSIDE] - scores[:, 1:].max(axis=1) > 2 * (self.move.max() - self.move.min()) + 1e-3
        opens = ~sure
        opens[1:] &= sure[:-1] | (tokens.text[1:] != tokens.text[:-1])
        closes = ~sure
        closes[:-1] &= sure[1:] | (tokens.text[1:] != tokens.text[:-1])
        first, last = np.flatnonzero(opens), np.flatnonzero(closes)
        inner = lambda at, by: (at + by >= 0) & (at + by < n) & (tokens.text[np.clip(at + by, 0, n - 1)] == tokens.text[at])
        enter = np.where(inner(first, -1)[:, None], self.move[OUTSIDE], 0)
        leave = np.where(inner(last, 1)[:, None], self.move[:, OUTSIDE], 0)
        decode(scores, self.move, first, last, enter, leave, tags)
        return tags


def decode(scores, move, first, last, enter, leave, tags) -> None:
    """Viterbi over the stretches ``first[i] .. last[i]``, side by side; ties go to the smaller tag. Fills ``tags``."""
    order = np.argsort(first - last, kind="stable")
    first, last = first[order], last[order]
    length = last - first + 1
    if not len(first):
        return
    steps = int(length[0])
    alive = np.searchsorted(-length, -np.arange(steps), "left")  # stretches longer than the step
    best = scores[first] + enter[order]
    back = [None]
    final = np.zeros((len(first), 3), best.dtype)
    for t in range(1, steps + 1):
        going = alive[t] if t < steps else 0
        final[going : len(best)] = best[going:]
        if t == steps:
            break
        reach = best[:going, :, None] + move
        back.append(reach.argmax(axis=1).astype(np.int8))
        best = reach.max(axis=1) + scores[first[:going] + t]
    at = (final + leave[order]).argmax(axis=1)
    tags[last] = at
    for t in range(steps - 1, 0, -1):
        going = alive[t]
        at[:going] = back[t][np.arange(going), at[:going]]
        tags[first[:going] + t - 1] = at[:going]


def fit_field(slices: list[bytes], epochs: int = EPOCHS, decay: float = 1e-4, rate: float = 0.3, seed: int = 0) -> Field:
    """Learn the weights from ``slices``, whose labels the rules give, by the likelihood's gradient (Adagrad).

    Each slice with a secret is learned from three times: as it is, with other
    characters in its secret, and with another key before it as well, so that
    surroundings and shape count and not the patterns alone.
    """
    emit, move = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for raw in slices:
        parts = _secret_parts(raw)
        texts.append(raw), labels.append(parts)
        for other_key in (False, True) if parts else ():
            text, moved_parts = _varied(raw, parts, other_key, rng)
            texts.append(text), labels.append(moved_parts)
    tokens = tokens_of(texts)
    n = len(tokens.start)
    if not n or not any(labels):
        emit[_AT["shape"] : _AT["before"], OUTSIDE] = 1.0
        return Field(emit.astype(np.float32), move.astype(np.float32))
    gold = np.zeros(n, np.int64)
    base = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for i, parts in enumerate(labels):
        for start, end in parts:
            a, b = np.searchsorted(tokens.end, base[i] + start, "right"), np.searchsorted(tokens.start, base[i] + end)
            gold[a:b] = INSIDE
            gold[a : a + 1] = BEGIN
    # Slices in a grid, the shorter ones padded.
    length = np.bincount(tokens.text, minlength=len(texts))
    width, begin = int(length.max()), np.cumsum(length) - length
    held = np.arange(width) < length[:, None]
    cell = np.where(held, begin[:, None] + np.arange(width), 0)
    both = held[:, 1:] & held[:, :-1]
    want_emit, want_move = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    for f in tokens.features:
        np.add.at(want_emit, (f, gold), 1.0)
    np.add.at(want_move, (gold[cell][:, :-1][both], gold[cell][:, 1:][both]), 1.0)
    seen_emit, seen_move = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    for _ in range(epochs):
        scores = sum(emit[f] for f in tokens.features)[cell]
        share, pairs = _expected(scores, move, held)
        flat = share[held]
        got = np.stack([sum(np.bincount(f, flat[:, s], N_FEATURES) for f in tokens.features) for s in range(3)], axis=1)
        for weights, seen, slope in (
            (emit, seen_emit, (want_emit - got) / len(texts) - decay * emit), (move, seen_move, (want_move - pairs) / len(texts) - decay * move),
        ):
            seen += slope**2
            weights += rate * slope / np.sqrt(seen)
    return Field(emit.astype(np.float32), move.astype(np.float32))


def _expected(scores: np.ndarray, move: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: probability of each tag at each place, and expected number of each pair of tags."""
    rows, width, _ = scores.shape
    weight = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(move)
    ahead, scale = np.empty_like(weight), np.ones((rows, width, 1))
    for t in range(width):
        now = weight[:, t] * (ahead[:, t - 1] @ step if t else 1.0)
        scale[:, t] = now.sum(axis=1, keepdims=True)
        ahead[:, t] = now / scale[:, t]
        if t:
            ahead[:, t] = np.where(held[:, t, None], ahead[:, t], ahead[:, t - 1])
    behind = np.ones_like(weight)
    pairs = np.zeros((3, 3))
    for t in range(width - 2, -1, -1):
        later = weight[:, t + 1] * behind[:, t + 1] / scale[:, t + 1]
        on = held[:, t + 1, None]
        behind[:, t] = np.where(on, later @ step.T, 1.0)
        pairs += step * (np.where(on, ahead[:, t], 0).T @ later)
    share = ahead * behind
    return share / share.sum(axis=2, keepdims=True), pairs


# Keys that stand before secrets, and alphabets that secrets are written in.
_OTHER_KEYS = (b"pwd", b"passphrase", b"auth", b"bearer", b"credential", b"private_key", b"access_key", b"client_secret", b"authorization")
_ALPHABETS = (
    b"0123456789abcdef",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
)


def _varied(raw: bytes, parts: list[tuple[int, int]], other_key: bool, rng) -> tuple[bytes, list[tuple[int, int]]]:
    """A slice with its secrets written anew, after another key if there is one to replace."""
    out, at, found = b"", 0, []
    keys = {m.end(1): m.start(1) for m in _ASSIGN.finditer(raw)}
    for start, end in parts:
        before = raw[at:start]
        if other_key:
            stop = max((k for k in keys if at < k <= start), default=None)
            if stop is not None and keys[stop] >= at:
                before = raw[at : keys[stop]] + _OTHER_KEYS[rng.integers(len(_OTHER_KEYS))] + raw[stop:start]
        letters = np.frombuffer(_ALPHABETS[rng.integers(len(_ALPHABETS))], np.uint8)
        secret = rng.choice(letters, int(rng.integers(16, 49))).tobytes()
        out += before
        found.append((len(out), len(out) + len(secret)))
        out += secret
        at = end
    return out + raw[at:], found


def fit(docs: DataFrame) -> Field:
    """The field learned from a bounded sample of ``docs`` (``text``), labelled by the rules.

    About ``FIT_ROWS`` rows, by hash of id and text, are looked through in tasks; the driver gets at most ``FIT_SLICES`` slices with a secret and as many
    without, of at most ``2 * SLICE_BYTES`` bytes beside a secret's first
    ``SLICE_BYTES``, equal ones once. No text or no secret: a field that tags
    all tokens as outside.
    """
    h = F.xxhash64(F.col("doc_id"), F.col("text").cast("string"))
    rows = docs.where(F.col("text").isNotNull()).select(text_bytes().alias("text"), h.alias("h"))
    total = docs.count()
    if total > FIT_ROWS:
        rows = rows.where(F.pmod("h", F.lit(1 << 40)) < int(FIT_ROWS / total * (1 << 40)) + 1)

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {"secret": [], "slice": []}
            for text, h in zip(b["text"], b["h"]):
                parts = _secret_parts(text)
                # Without a secret: a place by hash, and the longest word, which looks most like one.
                long = text.find(max(text.split(), key=len, default=b""))
                for start, end in parts or [(at, at) for at in (h % (len(text) + 1), long)]:
                    out["secret"].append(bool(parts))
                    out["slice"].append(text[max(0, start - SLICE_BYTES) : min(end, start + SLICE_BYTES) + SLICE_BYTES])
            yield out

    slices = map_rows(rows, cut, "secret boolean, slice binary").withColumn("h", F.xxhash64("slice", F.lit(1)))
    once = staged(slices.groupBy("secret", "h").agg(F.first("slice").alias("slice")), "slices")
    found = {r["secret"]: r["count"] for r in once.groupBy("secret").count().collect()}
    share = F.when(F.col("secret"), FIT_SLICES / found.get(True, 1)).otherwise(FIT_SLICES / found.get(False, 1))
    chosen = once.where(F.pmod("h", F.lit(1 << 40)) < share * (1 << 40)).collect()
    return fit_field([bytes(r["slice"]) for r in sorted(chosen, key=lambda r: r["h"])])


#: Texts are tagged together until they have so many bytes.
_TAGGED_BYTES = 1 << 20


def _learned(texts: list[bytes], field: Field, found: list[list[Span]]) -> None:
    """Add to ``found`` the spans that the field tags in ``texts`` and that overlap none of the rules'."""
    tokens = tokens_of(texts)
    tags = field.tags(tokens)
    hits = np.flatnonzero(tags)
    if not len(hits):
        return
    fresh = np.ones(len(hits), bool)
    fresh[1:] = (np.diff(hits) > 1) | (tags[hits[1:]] == BEGIN) | (tokens.text[hits[1:]] != tokens.text[hits[:-1]])
    opens = np.flatnonzero(fresh)
    closes = np.append(opens[1:], len(hits)) - 1
    base = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for a, b in zip(hits[opens], hits[closes]):
        i = tokens.text[a]
        start, end = int(tokens.start[a] - base[i]), int(tokens.end[b] - base[i])
        if end - start >= LEAST_LEARNED and not any(s.start < end and start < s.end for s in found[i] if s.kind != LEARNED):
            found[i].append(Span(start, LEARNED, end))


def find_spans(texts: list[bytes], field: Field) -> list[list[Span]]:
    """Spans of each text in code points, end exclusive, by start, then kind: the rules' and those that the field adds."""
    found = [base_spans(t) for t in texts]
    held: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        held.append(i)
        size += len(t)
        if size >= _TAGGED_BYTES or i + 1 == len(texts):
            _learned([texts[j] for j in held], field, part := [found[j] for j in held])
            for j, p in zip(held, part):
                found[j] = p
            held, size = [], 0
    kinds = (*KINDS, LEARNED)
    for i, t in enumerate(texts):
        spans = found[i]
        if spans and not t.isascii():
            points = np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)])
            spans = [Span(int(points[s.start]), s.kind, int(points[s.end])) for s in spans]
        found[i] = sorted(spans, key=lambda s: (s.start, kinds.index(s.kind)))
    return found


def scan(docs: DataFrame, field: Field, key: Column | None = None) -> DataFrame:
    """``doc_id, spans`` per row of ``docs`` (``doc_id, text``): ``spans`` holds ``kind, start, end``.

    Whole texts; a null text is empty and has no spans. Repeated rows each give
    a row. Other columns aren't read.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = find_spans([t or b"" for t in b["text"]], field)
            spans = [[{"kind": s.kind, "start": s.start, "end": s.end} for s in one] for one in found]
            yield {"doc_id": b["doc_id"], "spans": spans}

    asked = docs.select((F.col("doc_id") if key is None else key).cast("long").alias("doc_id"), text_bytes().alias("text"))
    return map_rows(asked, rows, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
