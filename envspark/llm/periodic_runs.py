"""Runs of periodic words: Lyndon roots extended by longest common extensions from suffix trees.

A run is a stretch of consecutive words with a smallest period ``q`` (words
``q`` apart are equal) that no neighbouring word extends keeping ``q``. Every
run of two periods or more has a root that is the longest Lyndon word starting
at its place, for the order of words or for the reversed order; so the two
longest Lyndon words of each place are all candidates. How far one's period
reaches to the right is the longest common extension of two places in the
text, to the left that of two places in its reversal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, text_bytes

#: A run has at least so many words, and at least so many of its periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
_BLOCK = 16


class SuffixTree:
    """Ukkonen's suffix tree of integers ``0 .. k - 1``, with constant-time longest common extensions.

    An extension of two suffixes is the depth of their leaves' lowest common
    ancestor: the least depth between their places in the Euler tour. The tour
    is kept as blocks with prefix and suffix minima and a sparse table of block
    minima, so memory is linear and a question looks at a fixed number of cells.
    """

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        self._build(symbols)
        self._tour()

    def _build(self, symbols: list[int]) -> None:
        n = self.n
        text = [s + 1 for s in symbols] + [0]  # the end is smaller than any word
        base = max(text) + 1
        self.base = base
        start, stop, link = [0], [0], [0]
        child: dict[int, int] = {}  # node * base + first symbol
        open_end = n + 1
        node = edge = length = 0
        waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            fresh = 0
            while waiting:
                if not length:
                    edge = i
                key = node * base + text[edge]
                below = child.get(key)
                if below is None:
                    start.append(i), stop.append(open_end), link.append(0)
                    child[key] = len(start) - 1
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    reach = min(stop[below], i + 1) - start[below]
                    if length >= reach:
                        edge += reach
                        length -= reach
                        node = below
                        continue
                    if text[start[below] + length] == symbol:
                        if fresh:
                            link[fresh] = node
                        length += 1
                        break
                    at = start[below]
                    start.append(at), stop.append(at + length), link.append(0)
                    middle = len(start) - 1
                    child[key] = middle
                    start.append(i), stop.append(open_end), link.append(0)
                    child[middle * base + symbol] = len(start) - 1
                    start[below] = at + length
                    child[middle * base + text[at + length]] = below
                    if fresh:
                        link[fresh] = middle
                    fresh = middle
                waiting -= 1
                if not node and length:
                    length -= 1
                    edge = i - waiting + 1
                elif node:
                    node = link[node]
        keys = np.fromiter(child.keys(), np.int64, len(child))
        below = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)
        self.parent, self.symbol, self.below = keys[order] // base, keys[order] % base, below[order]
        self.edge = np.array(stop) - np.array(start)

    def _tour(self) -> None:
        """Euler tour with children by symbol, the end first; leaves in its order are the sorted suffixes."""
        n, nodes = self.n, len(self.edge)
        first = np.searchsorted(self.parent, np.arange(nodes + 1)).tolist()
        below, edge = self.below.tolist(), self.edge.tolist()
        depth_of = [0] * nodes
        tour, leaf_at, leaves = [0], [0] * (n + 1), []
        stack, at = [0], first[:nodes]
        while stack:
            node = stack[-1]
            here = at[node]
            if here == first[node + 1]:
                stack.pop()
                if stack:
                    tour.append(depth_of[stack[-1]])
                continue
            at[node] = here + 1
            to = below[here]
            depth = depth_of[node] + edge[to]
            if first[to] == first[to + 1]:  # a leaf: its depth tells its suffix, whose end symbol isn't counted
                suffix = n + 1 - depth
                leaf_at[suffix] = len(tour)
                leaves.append(suffix)
                tour.append(depth - 1)
                tour.append(depth_of[node])
            else:
                depth_of[to] = depth
                tour.append(depth)
                stack.append(to)
        self.sorted = leaves
        self.leaf_at = np.array(leaf_at)
        cells = np.array(tour, np.int32)
        cells = np.concatenate([cells, np.full(-len(cells) % _BLOCK, np.iinfo(np.int32).max, np.int32)]).reshape(-1, _BLOCK)
        self.cells = cells
        self.ahead = np.minimum.accumulate(cells, axis=1)
        self.behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1]
        table = [cells.min(axis=1)]
        while 2 << len(table) - 1 <= len(cells):
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.table = table

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and at ``b`` (different, up to the length)."""
        x, y = self.leaf_at[a], self.leaf_at[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        bx, by = x // _BLOCK, y // _BLOCK
        out = np.minimum(self.behind[bx, x % _BLOCK], self.ahead[by, y % _BLOCK])
        near = np.flatnonzero(bx == by)
        if len(near):
            cells = self.cells[bx[near]]
            place = np.arange(_BLOCK)
            inside = (place >= (x[near] % _BLOCK)[:, None]) & (place <= (y[near] % _BLOCK)[:, None])
            out[near] = np.where(inside, cells, np.iinfo(np.int32).max).min(axis=1)
        far = np.flatnonzero(by - bx > 1)
        if len(far):
            lo, wide = bx[far] + 1, by[far] - bx[far] - 1
            level = np.frexp(wide)[1] - 1
            least = np.empty(len(far), np.int32)
            for k in np.unique(level):
                at = level == k
                least[at] = np.minimum(self.table[k][lo[at]], self.table[k][lo[at] + wide[at] - (1 << k)])
            out[far] = np.minimum(out[far], least)
        return out

    def reversed_order(self) -> list[int]:
        """The suffixes sorted by the reversed order of symbols, the end still first."""
        nodes = len(self.edge)
        first = np.searchsorted(self.parent, np.arange(nodes + 1)).tolist()
        below, edge, symbol = self.below.tolist(), self.edge.tolist(), self.symbol.tolist()
        leaves, stack = [], [(0, 0)]
        while stack:
            node, depth = stack.pop()
            a, b = first[node], first[node + 1]
            if a == b:
                leaves.append(self.n + 1 - depth)
                continue
            # What is pushed last comes first: the end, then the greatest symbol.
            kids = range(a, b) if symbol[a] else [*range(a + 1, b), a]
            stack += [(below[i], depth + edge[below[i]]) for i in kids]
        return leaves


def _lyndon_ends(order: list[int], n: int) -> np.ndarray:
    """For each place where its longest Lyndon word ends: the next place with a smaller suffix."""
    rank = [0] * (n + 1)
    for r, s in enumerate(order):
        rank[s] = r
    ends, stack = [0] * n, [n]
    for i in range(n - 1, -1, -1):
        while rank[stack[-1]] > rank[i]:
            stack.pop()
        ends[i] = stack[-1]
        stack.append(i)
    return np.array(ends)


def all_runs(symbols: list[int]) -> set[tuple[int, int, int]]:
    """All runs of two periods or more as (start, length, smallest period)."""
    n = len(symbols)
    if n < 2:
        return set()
    tree, mirror = SuffixTree(symbols), SuffixTree(symbols[::-1])
    found: set[tuple[int, int, int]] = set()
    here = np.arange(n)
    for order in (tree.sorted, tree.reversed_order()):
        nxt = _lyndon_ends(order, n)
        period = nxt - here
        end = nxt + tree.extension(here, nxt)
        # Words before both places, read backwards.
        start = here - mirror.extension(n - here, n - nxt)
        good = end - start >= 2 * period
        found.update(zip(start[good].tolist(), (end - start)[good].tolist(), period[good].tolist()))
    return found


def _stretches(codes: np.ndarray, text: np.ndarray, size: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches of words (in all texts' words) outside which no run of ``LEAST_WORDS`` and ``LEAST_PERIODS`` lies.

    In a run of at least three periods and three times ``width`` words, each
    ``width`` words that follow each other stand again one period on or back, so
    within a third of the text. Where no such repeat is, no run is; what is
    left is looked at again by itself, until it no longer shrinks.
    """
    weight = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(width)], np.uint64)
    n = len(codes) - width + 1
    if n <= 0:
        return []
    gram = sum((codes[i : i + n] * weight[i] for i in range(width)), np.zeros(n, np.uint64))
    part, limit = text.astype(np.int64), size
    alive = np.flatnonzero(text[:n] == text[width - 1 :])
    while len(alive):
        key = gram[alive] ^ (part[alive].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        at, key = alive[order], key[order]
        close = (key[1:] == key[:-1]) & (np.diff(at) <= limit[part[at[1:]]] // LEAST_PERIODS)
        kept = np.zeros(len(at), bool)
        kept[1:] |= close
        kept[:-1] |= close
        left = np.sort(at[kept])
        # Windows that follow each other are one stretch; it takes LEAST_WORDS words at least.
        breaks = np.flatnonzero((np.diff(left) > 1) | (np.diff(part[left]) != 0)) + 1
        first, last = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(left)]])
        long = last - first >= LEAST_WORDS - width + 1
        first, last = first[long], last[long]
        if not len(first):
            return []
        left = np.concatenate([left[a:b] for a, b in zip(first, last)])
        counts = last - first
        if len(left) == len(alive):
            starts = left[np.cumsum(counts) - counts]
            return [(int(a), int(a + c + width - 1)) for a, c in zip(starts, counts)]
        part = part.copy()
        part[left] = np.repeat(np.arange(len(counts)), counts)
        limit = counts + width - 1
        alive = left
    return []


#: Texts are looked through together until they have so many words.
_WORDS_TOGETHER = 1 << 18


def find_runs(texts: list[list[bytes]], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Runs of each text (a list of words) as (start, length, period), by start, then period.

    At least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods: smaller values are refused, since
    stretches without repeats of eight words are left out of the trees.
    """
    if least < LEAST_WORDS or periods < LEAST_PERIODS:
        raise ValueError(f"runs have {LEAST_WORDS} words and {LEAST_PERIODS} periods at least")
    known: dict[bytes, int] = {}
    codes = [known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for t in texts for w in t]
    codes = np.array(codes, np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    found: list[set[tuple[int, int, int]]] = [set() for _ in texts]
    for a, b in _stretches(codes, text, sizes, LEAST_WORDS // LEAST_PERIODS):
        i = int(text[a])
        a, b = a - int(begin[i]), b - int(begin[i])
        # Words themselves, not their hashes, are numbered.
        number: dict[bytes, int] = {}
        for start, length, q in all_runs([number.setdefault(w, len(number)) for w in texts[i][a:b]]):
            if length >= max(least, periods * q):
                found[i].add((a + start, length, q))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that some run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or (run[1] * best[2], -run[0], -run[2]) > (best[1] * run[2], -best[0], -best[2]):
            best = run
    return best


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, strongest, collapsed`` per row of ``docs`` (``doc_id, text``).

    ``runs`` holds ``start, length, period`` in words ``[^\\x20\\x09-\\x0D]+`` of
    the whole text, numbered from 0, by start, then period; ``strongest`` is the
    one with the greatest length by period, or null; ``collapsed`` the kept
    words, joined by one space. A null text has no words. Repeated rows each
    give a row; other columns aren't read.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        as_row = lambda r: r and dict(zip(("start", "length", "period"), r))
        for b in batches:
            ids, held, n = [], [], 0
            for k, (doc_id, text) in enumerate(zip(b["doc_id"], b["text"])):
                ids.append(doc_id)
                held.append(text.split() if text else [])
                n += len(held[-1])
                if n >= _WORDS_TOGETHER or k + 1 == len(b["text"]):
                    found = find_runs(held)
                    yield {
                        "doc_id": ids, "runs": [[as_row(r) for r in f] for f in found], "strongest": [as_row(strongest(f)) for f in found],
                        "collapsed": [b" ".join(collapsed(w, f)).decode() for w, f in zip(held, found)],
                    }
                    ids, held, n = [], [], 0

    run = "struct<start:long,length:long,period:long>"
    asked = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return map_rows(asked, rows, f"doc_id long, runs array<{run}>, strongest {run}, collapsed string")
