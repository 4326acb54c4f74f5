"""Suffix statistics of every suffix, and a bounded sample that repeated urls can't fill."""

import pytest
from pyspark.sql import functions as F

from envspark.llm import url_filter


@pytest.fixture(scope="module")
def labelled(spark):
    # 300 suffixes; one url fills a third of the rows; a missing url.
    rows = [(f"http://h{i}.s{i % 300}/p{i}", int(i % 300 < 150)) for i in range(1200)] + [("http://hot.s0/x", 1)] * 600 + [(None, 0)]
    return spark.createDataFrame(rows, "url string, label int")


def test_every_suffix_has_its_own_share(labelled):
    model = url_filter.UrlFilter.fit(labelled, iterations=2)
    rates = {r["suffix"]: r["rate"] for r in model.suffixes.collect()}
    prior = (600 + 600) / 1801
    assert model.prior == pytest.approx(prior)
    want = {f"s{i}": ((4 if i < 150 else 0) + 5 * prior) / 9 for i in range(300)}
    want["s0"] = (604 + 5 * prior) / 609
    want[""] = 5 * prior / 6
    assert rates == pytest.approx(want)


def test_the_sample_is_bounded_and_repeats_are_weights(labelled, monkeypatch):
    seen = []

    def staged(df, name):
        kept = df.cache()
        seen.append((name, kept))
        return kept

    monkeypatch.setattr(url_filter, "staged", staged)
    url_filter.UrlFilter.fit(labelled, fit_rows=100, iterations=1)
    tables = dict(seen)
    assert tables["url_features"].count() == 100
    assert tables["url_labels"].where("url = 'http://hot.s0/x'").collect()[0]["weight"] == 600.0


def test_many_suffixes_are_joined_by_a_shuffle(labelled, monkeypatch):
    model = url_filter.UrlFilter.fit(labelled, iterations=2)
    urls = labelled.select("url", F.lit(1).alias("suffix"), F.lit("r").alias("rate"))
    plain = {(r["url"], round(r["block_probability"], 9)) for r in model.block_probability(urls).collect()}
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 10)
    spread = model.block_probability(urls)
    assert spread.count() == 1801
    assert {(r["url"], round(r["block_probability"], 9)) for r in spread.collect()} == plain
