"""Tables and brute-force versions for the training-data operators."""

from __future__ import annotations

import re

import xxhash

PLAIN = re.compile(rb"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return PLAIN.findall((text or "").translate(AZ).encode())


def letter(text):
    return LETTER.findall((text or "").translate(AZ))


def brute_print(text):
    words = plain(text)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    """Least node of each component, by plain union-find."""
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def table(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def docs(spark, texts, extra="n_words long, labels string, fp long, `text_hash` long, pos int, term string, size long, rank int"):
    """Documents 0, 1, … with columns whose names operators use for their own."""
    width = len(extra.split(",")) if extra else 0
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), *([None] * width)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (f", {extra}" if extra else "")
    return spark.createDataFrame(rows, schema)


AWKWARD = [
    None, "", "   \t\n", "one", "One", "one two", "ONE two\x0bthree", "a" * 100_000, "word " * 20_000, "éÉ ñ ß 中文 words\u00a0glued\u0085here",
    "...!!!---", "one two", "\x1cone\x1dtwo\x7f", None, "0 1 2 3 4 5 6 7 8 9",
]
