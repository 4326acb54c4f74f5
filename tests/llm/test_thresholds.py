"""Thresholds of the toxicity model over all labelled rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from envspark.llm import toxicity

from .helpers import table


def corpus(spark, n=1200):
    """One text of 20 is called toxic; an insult is in all of these and in every tenth of the others. German ones are as many."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        words = rng.choice([f"w{k}" for k in range(80)], 12).tolist() + (["the", "of"] if i % 2 else ["und", "nicht"])
        if i % 20 < 2 or i % 10 == 5:
            words.insert(3, "snork")
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(i % 20 < 2)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_all_labelled_rows_have_a_say(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "thresholds", lambda cells, found=toxicity.thresholds: seen.update(cells) or found(cells))
    df, labels = corpus(spark)
    model = toxicity.fit(df, labels, F.col("doc_id") % 3 != 1, fit_rows=40)
    # 800 rows are for learning, 80 of them toxic: the sample is 40 of each class.
    weights = [sum(w for (_, _, toxic), (w, _) in seen.items() if toxic == k) for k in (0, 1)]
    assert weights == pytest.approx([720, 80])
    assert {"en", "de"} <= model.cuts.keys()


def test_thresholds_equal_a_search_over_rows():
    rng = np.random.default_rng(1)
    langs, y = rng.choice(["de", "en", "other"], 3000, p=[0.5, 0.49, 0.01]), (rng.random(3000) < 0.2).astype(int)
    raw = np.round(rng.beta(2 + 3 * y, 5), 2).clip(0.01, 0.99)
    cells = {}
    for lang, b, t in zip(langs.tolist(), toxicity.bins_of(raw).tolist(), y.tolist()):
        w, n = cells.get((lang, b, t), (0.0, 0))
        cells[lang, b, t] = w + 1, n + 1
    cuts = toxicity.thresholds(cells)
    assert cuts.keys() == {"all", "de", "en"}

    def f1(cut, r, t):
        return 2 * t[r >= cut].sum() / ((r >= cut).sum() + t.sum())

    for lang, cut in cuts.items():
        mine = langs == lang if lang != "all" else np.ones(3000, bool)
        assert f1(cut, raw[mine], y[mine]) == pytest.approx(max(f1(c, raw[mine], y[mine]) for c in np.unique(raw[mine])))
