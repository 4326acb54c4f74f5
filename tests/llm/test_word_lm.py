"""The language model over all words, against a direct one."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from envspark.llm import ngram_lm, queries, word_lm

from .helpers import AWKWARD, docs, plain, table


def seventh():
    return F.pmod(F.col("doc_id"), F.lit(7))


def test_every_word_has_its_own_counts(spark, monkeypatch):
    monkeypatch.setattr(word_lm, "BLOCK_TOKENS", 300)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    texts = AWKWARD + [" ".join(rng.choice(words, rng.integers(1, 50), p=np.arange(60, 0, -1) / 1830)) for _ in range(150)] + ["unseen words here"]
    df = docs(spark, texts).repartition(6)
    rows = {r.doc_id: r for r in word_lm.score(df, seventh()).collect()}
    tokens = {i: [*plain(t), b" "] for i, t in enumerate(texts)}

    def counts(keep):
        one, two = Counter(), Counter()
        for i, ws in tokens.items():
            if keep(i % 7):
                one.update(ws)
                two.update(zip([b" ", *ws], ws))
        return one, two

    full, kept = counts(lambda f: f != 2), counts(lambda f: f not in (2, 6))
    total, distinct = full[0].total(), len(full[0])

    def parts(one, two, a, b):
        return [two[a, b] / one[a] if one[a] else 0, one[b] / one.total(), 1 / (distinct + 1)]

    seen = [(a, b) for i, ws in tokens.items() if i % 7 == 6 for a, b in zip([b" ", *ws], ws)]
    bucket = np.array([int(kept[0][a]).bit_length() for a, _ in seen])
    lam = ngram_lm.learn_weights(bucket, np.array([parts(*kept, a, b) for a, b in seen]), np.ones(len(seen)))
    assert len(rows) == len(texts)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 7 == 2, len(ws), sum(full[0][w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((full[0][w] + 1) / (total + distinct + 1)) for w in ws))
        want = sum(math.log10(np.dot(lam[int(full[0][a]).bit_length()], parts(*full, a, b))) for a, b in zip([b" ", *ws], ws))
        assert r.score == pytest.approx(want, rel=0.02)  # the statistics for the weights lie on a grid


def test_query_tells_a_seldom_word_from_one_never_seen(spark, tmp_path):
    # 200,000 tokens: a word seen twice is below one in 65,000.
    texts = ["common words " * 500] * 200 + ["seldom", "seldom", "x"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    ids = spark.range(1000, 1100).where(queries.fold_of(F.col("id"), 7) == 2).limit(2).collect()
    rows += [(ids[0].id, "seldom", "en", "s", 0), (ids[1].id, "never", "en", "s", 0)]
    trained = spark.range(300, 400).where(queries.fold_of(F.col("id"), 7) < 2).limit(2).collect()
    rows += [(t.id, "seldom", "en", "s", 0) for t in trained]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_lm(spark, str(tmp_path)).collect()}
    assert got[ids[0].id].score > got[ids[1].id].score + 0.3


def test_one_entry_a_block_for_a_frequent_pair():
    rows = [(i, 0, 1, b"same " * 5_000) for i in range(40)]
    sent = list(word_lm._asked(4)(0, rows))
    pairs = sum(len(word_lm._keys_of(keys[1])) for _, (_, keys, _) in sent)
    assert len(list(word_lm.blocks_of(rows))) == 1 and pairs == 3
    back = [m for p in range(4) for m in word_lm._answered(s for s in sent if s[0] == p)]
    assert sum(c for _, (kind, c) in back if kind == "distinct") == 2
    counts = [word_lm.unpacked(c[2])[2 * c[1] :].reshape(2, -1)[0] for _, (kind, c) in back if kind == "counts"]
    assert sorted(np.concatenate(counts).tolist()) == [40, 40, 40 * 4_999]


def test_packed_numbers():
    for values in ([], [0], [0, 0], [1, 255], [256, 3], [2**63 + 5, 0, 2**40]):
        for low in (True, False):
            assert word_lm.unpacked(word_lm.packed(np.array(values, np.uint64), low), low).tolist() == values


def test_word_model_is_a_distribution():
    model = word_lm.WordModel(np.tile([0.5, 0.3, 0.2], (64, 1)), 12, 3)
    # Three words follow a context seen five times 1, 3 and 1 times; the fourth class is all others.
    p = 10 ** model.log10(np.full(4, 5), np.array([3, 5, 4, 0]), np.array([1, 3, 1, 0]))
    assert p.sum() == pytest.approx(1)


def test_word_model_of_nothing(spark):
    assert word_lm.score(table(spark, []), seventh()).count() == 0
    r = word_lm.score(table(spark, [(2, "a b", "", "", 0)]), seventh()).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
    twice = word_lm.score(table(spark, [(1, "a b", "", "", 0)] * 2 + [(None, None, "", "", 0)]), seventh()).collect()
    assert len(twice) == 3 and {r.n_tokens for r in twice} == {3, 1}
