"""Registered queries over a whole fixture, and the pipeline's stages one after the other, against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from envspark.llm import language, mixing, queries
from tests.llm.helpers import AWKWARD, brute_print, classes, letter, plain

WORDS = {
    "en": "the of and there with house water stone river light morning little people under".split(),
    "de": "der und nicht zwischen wasser straße über fluß morgen kleine leute häuser stein".split(),
    "es": "el de los niños agua mañana pequeño gente casas río piedra entre señor luz".split(),
}
BENCH = "what is the least number of coins that a merchant needs to pay every sum up to one hundred".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents in three languages with copies, near copies, benchmark passages, insults and awkward texts."""
    rng = random.Random(3)
    texts, langs = [], []

    def add(text, lang):
        texts.append(text), langs.append(lang)

    for i in range(240):
        lang = "en de es".split()[i % 3]
        words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "", str(rng.randrange(90))]) for _ in range(rng.randrange(12, 90))]
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), ["grubbly", "grubblish", "snork"][i % 3])
        add(" ".join(words), lang)
    long = " ".join(rng.choice(WORDS["en"]) + str(k) for k in range(400))
    for k in (3, 57, 200):
        add(long.replace(f"{long.split()[k]} ", "changed "), "en")
    for i in (1, 2, 4):
        add(texts[i].upper(), langs[i])
    add(" ".join([*texts[7].split()[:20], *BENCH, *texts[7].split()[:20]]), "en")
    add(" ".join(BENCH[:13]), "en")
    add(" ".join(BENCH[:12] + ["else"] * 30), "en")
    for t in AWKWARD:
        add(t, None)
    rows = [(i, t, langs[i], None if i % 11 == 0 else f"s{i * i % 4}", len(t or "")) for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("corpus")
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("b1", " ".join(BENCH)), ("b2", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    marks = [(i, 1, int(i % 5 == 0)) for i in range(240)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_language_query_equals_plain_cosines(spark, corpus):
    """Trigram vectors bound, bundled and compared one by one, with the model's letter vectors."""
    sf_dir, rows = corpus
    space = language.Hyperspace()

    def bundle(pairs):
        total = np.zeros(space.dim)
        for code, n in pairs:
            a, b, c = code // language.CLASSES**2, code // language.CLASSES % language.CLASSES, code % language.CLASSES
            total += n * (space.first[a].astype(float) * space.second[b] * space.third[c])
        return total

    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows}
    grams = {r[0]: list(zip(*map(np.ndarray.tolist, language.trigram_counts(r[1])))) for r in rows}
    learned = defaultdict(Counter)
    for i, text, lang, *_ in rows:
        if text is not None and lang is not None and not held[i]:
            learned[lang].update(dict(grams[i]))
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    protos = {lang: unit(bundle(n.items())) for lang, n in learned.items()}
    common = np.mean(list(protos.values()), axis=0)
    protos = {lang: unit(v - common) for lang, v in protos.items()}
    got = {r.doc_id: r for r in queries.op5_language(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, text, lang, *_ in rows:
        r = got[i]
        assert r.held_out == held[i]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = unit(unit(bundle(grams[i])) - common)
        cosines = {lang: float(p @ v) for lang, p in protos.items()}
        assert r.score == pytest.approx((1 + max(cosines.values())) / 2, abs=1e-4)
        assert cosines[r.lang_pred] == pytest.approx(max(cosines.values()), abs=1e-4)
    assert np.mean([got[i].lang_pred == lang for i, _, lang, *_ in rows if lang and held[i]]) > 0.95


def test_other_queries_give_a_row_for_each_document(spark, corpus):
    sf_dir, rows = corpus
    prints = {r.doc_id: r for r in queries.op1_simhash(spark, sf_dir).collect()}
    want = {r[0]: brute_print(r[1]) for r in rows}
    assert {i: int(r.fingerprint, 16) for i, r in prints.items()} == want
    near = [(a, b) for a in want for b in want if a < b and bin(want[a] ^ want[b]).count("1") <= 3]
    assert {i: r.component_id for i, r in prints.items()} == classes(want, near)
    places = {r.doc_id: r for r in queries.op3_licenses(spark, sf_dir).collect()}
    assert {i: r.n_words for i, r in places.items()} == {r[0]: len(letter(r[1])) for r in rows}
    scored = {r.doc_id: r for r in queries.op7_toxicity(spark, sf_dir).collect()}
    assert len(scored) == len(rows) and all(r.predicted == (r.score >= 0.7) for r in scored.values())


def _targets(sizes):
    """Plain water-filling of source targets."""
    total = defaultdict(int)
    for source, size in sizes:
        total[source] += size
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % len(mixing.WEIGHTS)] for k, s in enumerate(names)}
    goal, open_, left = {}, set(names), mixing.SHARE * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > mixing.CEILING * total[s]}
        if not over:
            goal |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            goal[s] = mixing.CEILING * total[s]
            left -= goal[s]
        open_ -= over
    return total, goal


def test_pipeline_stage_by_stage(spark, corpus, tmp_path):
    sf_dir, rows = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "tokens"]
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = [tuple(r) for r in docs.collect()]
    whole = {tuple(r) for r in rows}
    # Toxicity: insults go, others stay, rows unchanged.
    clean = kept["toxicity"]
    assert set(clean) <= whole and len(clean) == len(set(clean))
    ids = {r[0] for r in clean}
    assert np.mean([i in ids for i in range(0, 240, 5)]) < 0.1
    assert np.mean([r[0] in ids for r in rows if r[0] >= 240 or r[0] % 5]) > 0.95
    # SimHash: the smallest id of each group.
    prints = {r[0]: brute_print(r[1]) for r in clean}
    near = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    roots = set(classes(prints, near).values())
    assert sorted(kept["simhash"], key=str) == sorted((r for r in clean if r[0] in roots), key=str)
    assert len(kept["simhash"]) < len(clean)
    # Decontamination: rows with a twentieth of their words or more inside windows of the benchmark.
    windows = {tuple(BENCH[i : i + 13]) for i in range(len(BENCH) - 12)}

    def dirty(text):
        w = letter(text)
        hit = {p for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for p in range(i, i + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert sorted(kept["decontamination"], key=str) == sorted((r for r in kept["simhash"] if not dirty(r[1])), key=str)
    assert len(kept["decontamination"]) == len(kept["simhash"]) - 2
    # Mixing: each row as often as whole numbers are passed along its source.
    before = kept["decontamination"]
    total, goal = _targets([(r[3], len(plain(r[1]))) for r in before])
    want = Counter()
    for source, n in total.items():
        mine = sorted((r for r in before if r[3] == source), key=lambda r: (len(plain(r[1])), r[0]))
        rate = goal[source] / n if n else 0.0
        for k, r in enumerate(mine):
            passed = lambda x: math.floor(mixing.offset() + rate * x)  # noqa: B023, E731
            want[r] += passed(k + 1) - passed(k) if n else 0
    assert Counter(kept["mixing"]) == +want
    # Tokens: ids of the library, in order of ids.
    library = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    at, expected = 0, []
    for r in sorted(kept["mixing"], key=lambda r: r[0]):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        expected.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    names = spark.read.parquet(f"{tmp_path}/4").select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, names.collect())) == expected
    again = corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, again.collect())) == expected


def test_pipeline_of_empty_tables(spark, corpus, tmp_path):
    sf_dir, _ = corpus
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
