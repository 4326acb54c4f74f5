"""Alignment of two tokenizers over the same bytes, by divide and conquer at shared cuts.

Both tokenizers cut ``space + text`` into tokens. Byte offsets where tokens of
both end are shared cuts; between two of them lies a group of tokens of either
side. A shared cut links the two tokens that end there; how often two ids are
linked is counted over all texts.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, staged

#: Texts are aligned together until they have so many bytes.
BYTES_TOGETHER = 1 << 19
#: Places on either side of the middle that are tried one by one before all others of an interval are.
NEAR_STEPS = 6


def _byte_letters() -> dict[str, int]:
    """The byte that a letter of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class ByteLevel:
    """A byte-level vocabulary of the ``tokenizers`` library: ids of ``space + text``, and the bytes of each id.

    Special tokens inside texts are plain text. Where ids follow the order of
    merges and the file splits by its default pattern, merges by rank give the
    same ids, and ``tiktoken`` does that faster; a file of any other make, and
    texts with white space too long for its pattern, take the library itself.
    """

    # The library's default pattern, and the parts of a file that make merges by rank the same.
    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    _SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    _PLAIN_MODEL = {
        "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
        "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
    }
    _LONG_SPACE = re.compile(r"\s{2000}")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        shape = json.loads(self.tokenizer.to_str())
        special = {t["content"]: t["id"] for t in shape["added_tokens"]}
        model = shape["model"]
        vocabulary, merges = model.pop("vocab"), model.pop("merges")
        letters = _byte_letters()
        self.bytes = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for token, i in {**special, **vocabulary}.items():
            self.bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ranked = [vocabulary.get("".join(p)) for p in pairs] == [*range(256, 256 + len(pairs))]
        self.ranked = None
        if ranked and shape["normalizer"] is None and shape["pre_tokenizer"] == self._SPLIT and model == self._PLAIN_MODEL:
            import tiktoken

            ranks = {self.bytes[i]: i for t, i in vocabulary.items() if t not in special}
            self.ranked = tiktoken.Encoding("ranked", pat_str=self._PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return [e.ids for e in self.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        by_rank, long_space = self.ranked.encode_ordinary, self._LONG_SPACE.search
        whole = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        return [whole(" " + t) if long_space(t) else by_rank(" " + t) for t in texts]


class Pieces:
    """A ``sentencepiece`` vocabulary, which puts the space before the text itself: ids, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if raw else p.replace("▁", " ").encode() for p, raw in pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Numbers of the tokens of A that end where a token of B does, in order.

    ``first .. last`` are A's tokens of each text; all ends ascend, and both
    sides end a text together. An interval is divided at the shared end nearest
    to its middle, found by bisecting B's ends, and both halves go on, all
    intervals of a depth side by side. Without a shared end inside it is a leaf.
    """
    lo, hi, cuts = first, last, [last]
    while len(lo):
        several = hi > lo
        lo, hi = lo[several], hi[several]
        middle = (lo + hi - 1) // 2
        at = np.full(len(lo), -1, np.int64)
        todo = np.arange(len(lo))
        for step in range(NEAR_STEPS):
            for tried in (middle - step, middle + step + 1):
                here = tried[todo]
                inside = (here >= lo[todo]) & (here < hi[todo])
                hit = np.zeros(len(todo), bool)
                hit[inside] = _ends_together(ends_a[here[inside]], ends_b)
                at[todo[hit]] = here[hit]
                todo = todo[~hit]
        todo = todo[hi[todo] - lo[todo] > NEAR_STEPS]
        if len(todo):
            # All ends of these intervals at once; the hit nearest to the middle divides.
            size = hi[todo] - lo[todo]
            owner = np.repeat(np.arange(len(todo)), size)
            here = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[todo][owner]
            hit = _ends_together(ends_a[here], ends_b)
            here, owner = here[hit], owner[hit]
            order = np.lexsort((here, np.abs(here - middle[todo][owner]), owner))
            owner, where = np.unique(owner[order], return_index=True)
            at[todo[owner]] = here[order][where]
        split = at >= 0
        cuts.append(at[split])
        lo, hi = np.concatenate([lo[split], at[split] + 1]), np.concatenate([at[split], hi[split]])
    return np.sort(np.concatenate(cuts))


def _ends_together(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    return others[np.searchsorted(others, ends)] == ends


class Aligned(NamedTuple):
    """Texts one after the other: ids of both sides, and for each shared cut the tokens that end there.

    ``upto_a``, ``upto_b`` and ``upto_cut`` give what lies before each text, and the sum at the end.
    """

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    upto_a: np.ndarray
    upto_b: np.ndarray
    upto_cut: np.ndarray


class Aligner:
    """Two tokenizers and the id pairs that can be linked.

    Of two tokens that end together one's bytes end the other's. So the pairs
    follow from the vocabularies: at most one an id and suffix of its bytes (and
    ids of equal bytes), whatever the texts are. Pairs are numbered in order.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        by_bytes: list[dict[bytes, list[int]]] = [{}, {}]
        for known, side in zip(by_bytes, (self.a, self.b)):
            for i, x in enumerate(side.bytes):
                if x:
                    known.setdefault(x, []).append(i)
        pairs = {(i, j) for x, ids in by_bytes[0].items() for k in range(len(x)) for j in by_bytes[1].get(x[k:], ()) for i in ids}
        pairs |= {(i, j) for x, ids in by_bytes[1].items() for k in range(len(x)) for i in by_bytes[0].get(x[k:], ()) for j in ids}
        self.pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys = self.pairs[:, 0] * len(self.b.bytes) + self.pairs[:, 1]

    def __call__(self, texts: list[str | None]) -> Aligned:
        """Null and empty texts, and texts that a side doesn't give back byte by byte, have no tokens."""
        asked = [i for i, t in enumerate(texts) if t]
        ids_a, ids_b = self.a.encode([texts[i] for i in asked]), self.b.encode([texts[i] for i in asked])
        kept_a, kept_b, sizes = [], [], np.zeros((len(texts), 2), np.int64)
        bytes_a, bytes_b = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        for i, a, b in zip(asked, ids_a, ids_b):
            want = b" " + texts[i].encode()
            if b"".join(map(bytes_a, a)) == want and b"".join(map(bytes_b, b)) == want:
                kept_a += a
                kept_b += b
                sizes[i] = len(a), len(b)
        a, b = np.array(kept_a, np.int64), np.array(kept_b, np.int64)
        upto = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(sizes, axis=0)])
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        filled = sizes[:, 0] > 0
        cut_a = shared_cuts(ends_a, ends_b, upto[:-1, 0][filled], upto[1:, 0][filled] - 1)
        cut_b = np.searchsorted(ends_b, ends_a[cut_a])
        return Aligned(a, b, cut_a, cut_b, upto[:, 0], upto[:, 1], np.searchsorted(cut_a, upto[:, 0]))

    def links(self, found: Aligned) -> np.ndarray:
        """The pair's number of each shared cut."""
        return np.searchsorted(self.keys, found.a[found.cut_a] * len(self.b.bytes) + found.b[found.cut_b])

    @functools.cached_property
    def _shown(self) -> list[str]:
        """An id of A with ``,`` and with ``|`` after it, then an id of B with ``,`` and with ``;``."""
        return [f"{i}{s}" for side, ends in ((self.a, ",|"), (self.b, ",;")) for i in range(len(side.bytes)) for s in ends]

    def written(self, found: Aligned) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        shown, (n_a, n_b) = self._shown, (len(found.a), len(found.b))
        last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        last_a[found.cut_a] = last_b[found.cut_b] = 1
        # A group's tokens of A come after all of B's before the group, those of B after all of A's up to its end.
        group_a = np.repeat(np.arange(len(found.cut_a)), np.diff(found.cut_a, prepend=-1))
        group_b = np.repeat(np.arange(len(found.cut_b)), np.diff(found.cut_b, prepend=-1))
        codes = np.empty(n_a + n_b, np.int64)
        codes[np.arange(n_a) + (np.concatenate([[-1], found.cut_b]) + 1)[group_a]] = 2 * found.a + last_a
        codes[np.arange(n_b) + (found.cut_a + 1)[group_b]] = 2 * (len(self.a.bytes) + found.b) + last_b
        codes, upto = codes.tolist(), (found.upto_a + found.upto_b).tolist()
        return ["".join(map(shown.__getitem__, codes[x:y]))[:-1] for x, y in zip(upto, upto[1:])]


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker, which keeps it from task to task."""
    return Aligner(path_a, path_b)


def _together(batches: Iterator[dict]) -> Iterator[dict]:
    """Rows of batches in smaller parts of about ``BYTES_TOGETHER`` bytes of text."""
    for b in batches:
        at = size = 0
        for i, t in enumerate(b["text"]):
            size += len(t or "")
            if size >= BYTES_TOGETHER or i + 1 == len(b["text"]):
                yield {k: v[at : i + 1] for k, v in b.items()}
                at, size = i + 1, 0


def _asked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, a_ids, b_ids, a_cuts, b_cuts`` per row of ``docs`` (``doc_id, text``).

    ``a_cuts`` and ``b_cuts`` count the tokens of each side up to each shared
    cut: group ``k`` are the ids from one count to the next. Null and empty
    texts, and those that a tokenizer doesn't give back, have empty arrays.
    Repeated rows each give a row; other columns aren't read.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        run = aligner(path_a, path_b)
        for b in _together(batches):
            found = run(b["text"])
            out = {"doc_id": b["doc_id"]}
            for name, values, upto in (("a_ids", found.a, found.upto_a), ("b_ids", found.b, found.upto_b)):
                out[name] = [values[x:y] for x, y in zip(upto, upto[1:])]
            for name, values, before in (("a_cuts", found.cut_a, found.upto_a), ("b_cuts", found.cut_b, found.upto_b)):
                out[name] = [values[x:y] + 1 - z for x, y, z in zip(found.upto_cut, found.upto_cut[1:], before)]
            yield out

    return map_rows(_asked(docs), rows, "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, groups_sha256, links`` per row: a table in the shared folder, since two passes read it.

    ``links`` holds the pair's number of each shared cut, as little-endian
    unsigned 32-bit integers. ``groups_sha256`` is that of the groups as text,
    empty for a row without tokens.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        run = aligner(path_a, path_b)
        for b in _together(batches):
            found = run(b["text"])
            links, cuts = run.links(found).astype("<u4"), found.upto_cut
            yield {
                "doc_id": b["doc_id"], "n_a": np.diff(found.upto_a), "n_b": np.diff(found.upto_b),
                "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in run.written(found)],
                "links": [links[x:y].tobytes() for x, y in zip(cuts, cuts[1:])],
            }

    return staged(map_rows(_asked(docs), rows, "doc_id long, n_a long, n_b long, groups_sha256 string, links binary"), "links")


def link_counts(links: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``pair, n``: how many links of the whole table hold each pair, by its number; pairs without links are left out.

    Each task adds up its own counts, one number a possible pair, before the shuffle.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(len(aligner(path_a, path_b).pairs), np.int64)
        for b in batches:
            for x in b["links"]:
                np.add.at(total, np.frombuffer(x, "<u4"), 1)
        pair = np.flatnonzero(total)
        yield {"pair": pair, "n": total[pair]}

    return map_rows(links.select("links"), rows, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``a_id, b_id, n``: how many links of all ``docs`` hold each id pair."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        pairs = aligner(path_a, path_b).pairs
        for b in batches:
            at = np.array(b["pair"], np.int64)
            yield {"a_id": pairs[at, 0], "b_id": pairs[at, 1], "n": b["n"]}

    return map_rows(link_counts(linked(docs, path_a, path_b), path_a, path_b), rows, "a_id int, b_id int, n long")


def agreement(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs`` the numbers of tokens, groups and links, and how common its links' pairs are among all texts.

    ``n_best`` counts the links whose pair is the most common one of its B id
    (ties included), ``count_sum`` adds up their pairs' counts.

    The counts of all pairs go to every task. They are as many as pairs can be
    linked, which the vocabularies bound (about 324,000 for the files of the
    query), whatever the input is.
    """
    links = linked(docs, path_a, path_b)
    counted = link_counts(links, path_a, path_b).toArrow()
    pairs = Aligner(path_a, path_b).pairs
    count = np.zeros(len(pairs), np.int64)
    count[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    top = np.zeros(pairs[:, 1].max(initial=-1) + 1, np.int64)
    np.maximum.at(top, pairs[:, 1], count)
    best = count == top[pairs[:, 1]]

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = [np.frombuffer(x, "<u4") for x in b.pop("links")]
            b["n_groups"] = b["n_links"] = [len(x) for x in found]
            b["n_best"] = [int(best[x].sum()) for x in found]
            b["count_sum"] = [int(count[x].sum()) for x in found]
            yield b

    return map_rows(
        links, rows, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
