"""Licence scan: matching statistics from a generalised suffix automaton of licence words."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import takewhile

from pyspark.sql import DataFrame, functions as F

from .common import letter_words, map_rows, text_bytes

# Phrases of which every place counts, and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Wording that licences are recognised by, and labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)
LEAST_MATCH = 3
MOST_GAP = 4
LEAST_COVER = 0.7


class LicenceAutomaton:
    """All substrings of the phrases and templates, as sequences of words.

    ``fail`` is the suffix link and ``length`` the longest string of a state;
    ``ends`` holds the (text, end) places of a state's strings, ``phrases`` the
    (length, label) of phrases that are suffixes of its longest string.
    """

    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES):
        self.texts = [(letter_words(t.encode()), label) for t, label in (*phrases, *templates)]
        self.n_phrases = len(phrases)
        self.moves: list[dict[bytes, int]] = [{}]
        self.fail, self.length = [-1], [0]
        last_of = []
        for words, _ in self.texts:
            state, path = 0, []
            for w in words:
                state = self._extend(state, w)
                path.append(state)
            last_of.append(path)
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.moves]
        for text, (words, _) in enumerate(self.texts):
            state = 0
            for end, w in enumerate(words):
                state = self.moves[state][w]
                self.ends[state].add((text, end))
        by_length = sorted(range(1, len(self.moves)), key=self.length.__getitem__, reverse=True)
        for s in by_length:
            if self.fail[s] > 0:
                self.ends[self.fail[s]] |= self.ends[s]
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.moves]
        for text in range(self.n_phrases):
            state = 0
            for w in self.texts[text][0]:
                state = self.moves[state][w]
            self.phrases[state].append((len(self.texts[text][0]), text))
        for s in reversed(by_length):
            self.phrases[s] = self.phrases[s] + self.phrases[self.fail[s]]

    def _extend(self, last: int, word: bytes) -> int:
        """Add ``word`` after state ``last`` and return the state of the whole prefix."""
        if word in self.moves[last]:
            there = self.moves[last][word]
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        new = self._state({}, self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.moves[at]:
            self.moves[at][word] = new
            at = self.fail[at]
        if at < 0:
            self.fail[new] = 0
        else:
            there = self.moves[at][word]
            self.fail[new] = there if self.length[there] == self.length[at] + 1 else self._split(at, word, there)
        return new

    def _split(self, at: int, word: bytes, there: int) -> int:
        copy = self._state(dict(self.moves[there]), self.length[at] + 1)
        self.fail[copy], self.fail[there] = self.fail[there], copy
        while at >= 0 and self.moves[at].get(word) == there:
            self.moves[at][word] = copy
            at = self.fail[at]
        return copy

    def _state(self, moves: dict[bytes, int], length: int) -> int:
        self.moves.append(moves)
        self.fail.append(0)
        self.length.append(length)
        return len(self.moves) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places of phrases as (start, text), and maximal matches as (last word, length, state)."""
        moves, fail, length, phrases = self.moves, self.fail, self.length, self.phrases
        root, known = moves[0], moves[0].get
        places, matches = [], []
        state = held = 0
        for i, w in enumerate(words):
            if not state:
                state = known(w, 0)
                held = 1 if state else 0
            else:
                to = moves[state].get(w)
                if to is not None:
                    state, held = to, held + 1
                else:
                    if held >= LEAST_MATCH:
                        matches.append((i - 1, held, state))
                    while state > 0 and w not in moves[state]:
                        state = fail[state]
                        held = length[state]
                    if w in moves[state]:
                        state, held = moves[state][w], held + 1
                    else:
                        state = held = 0
            if state and phrases[state]:
                places += [(i - n + 1, text) for n, text in phrases[state] if n <= held]
        if held >= LEAST_MATCH:
            matches.append((len(words) - 1, held, state))
        return places, matches

    def spans(self, matches: list[tuple[int, int, int]], most_gap: int = MOST_GAP, least_cover: float = LEAST_COVER) -> list[dict]:
        """Templates covered by chains of matches.

        Matches of one template are chained where both sides go forward and at
        most ``most_gap`` words lie between. A chain that covers ``least_cover``
        of the template's words is a span, unless one of greater cover overlaps it.
        """
        by_text: dict[int, list[tuple[int, int, int]]] = {}
        for last, held, state in matches:
            for text, end in self.ends[state]:
                if text >= self.n_phrases:
                    by_text.setdefault(text, []).append((last, end, held))
        found = []
        for text, parts in sorted(by_text.items()):
            size, label = len(self.texts[text][0]), self.texts[text][1]
            best: list[tuple[int, int, int, int]] = []  # covered, first word, last word, last template word
            for last, end, held in sorted(parts):
                cover, first = held, last - held + 1
                # Only chains that end within the gap of this match's beginning can go on with it.
                for c, f, at, tpl in takewhile(lambda b: b[2] >= last - held - most_gap, reversed(best)):  # noqa: B023
                    new = min(held, last - at, end - tpl)
                    if new > 0 and last - new - at <= most_gap and end - new - tpl <= most_gap and c + new > cover:
                        cover, first = c + new, f
                best.append((cover, first, last, end))
            kept: list[tuple[int, int]] = []  # in order, none overlaps another
            for cover, first, last, _ in sorted(best, key=lambda x: (-x[0], x[1])):
                at = bisect_left(kept, (first, last))
                free = (not at or kept[at - 1][1] < first) and (at == len(kept) or last < kept[at][0])
                if cover >= least_cover * size and free:
                    found.append({"label": label, "first": first, "last": last, "cover": cover / size})
                    kept.insert(at, (first, last))
        return found


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``) the phrases and licence spans of its whole text.

    ``n_words``; ``n_base`` places of phrases, ``first_word`` and ``last_word``
    their smallest and largest start (words from 0; null without any);
    ``base_labels`` of phrases and ``labels`` of phrases and spans, distinct,
    sorted, comma-joined; ``score``, 1 with a phrase, else the largest cover of
    a template by matches; ``spans`` of templates. A null text is empty.
    """
    automaton = LicenceAutomaton(phrases, templates)

    def one(words: list[bytes]) -> dict:
        places, matches = automaton.scan(words)
        spans = automaton.spans(matches, least_cover=0.0) if matches else []
        base = {automaton.texts[t][1] for _, t in places}
        good = [s for s in spans if s["cover"] >= LEAST_COVER]
        starts = [s for s, _ in places]
        return {
            "n_words": len(words), "n_base": len(places),
            "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s["label"] for s in good})),
            "score": 1.0 if places else min(1.0, max((s["cover"] for s in spans), default=0.0)), "spans": good,
        }

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            done = [one(letter_words(t)) for t in b["text"]]
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
            yield {"doc_id": b["doc_id"]} | {n: [d[n] for d in done] for n in names}

    return map_rows(
        docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")), rows,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first:long,last:long,cover:double>>",
    )
