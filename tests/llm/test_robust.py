"""Clashing names, rows that differ in one column only, far-off vectors, and spans of licences."""

import numpy as np
import pytest

from envspark.llm import decontaminate, licenses, mixing, onebit_search, simhash
from envspark.llm.common import letter_words
from tests.llm.helpers import docs

OWN = "_id long, _hash string, _h long, _copies long, _copy int, _source string, kept_id string, KEPT_HASH int, mixed_hash int, bad_id int, bad_hash string"


def owned(spark, texts):
    """Documents whose extra columns hold values that must come back."""
    df = docs(spark, texts, OWN)
    names = df.columns[5:]
    rows = [(*r[:5], *[(str(r[0]) if kind == "string" else r[0] + j) for j, (_, kind) in enumerate(df.dtypes[5:])]) for r in df.collect()]
    return spark.createDataFrame(rows, df.schema), names


def expected(row, names, dtypes):
    return [str(row.doc_id) if dtypes[n] == "string" else row.doc_id + j for j, n in enumerate(names)]


@pytest.mark.parametrize("stage", ["mix", "near", "contaminated"])
def test_columns_of_any_name_come_back(spark, stage):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen"
    df, names = owned(spark, [f"text number {i} of its own kind {i * 7} and {i * 13}" for i in range(12)] + [words, "text number 3 of its own kind 21 and 39"])
    bench = spark.createDataFrame([("b", words)], "item_id string, text string")
    run = {"mix": mixing.mix, "near": simhash.drop_near_duplicates, "contaminated": lambda d: decontaminate.drop_contaminated(d, bench)}[stage]
    out = run(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    rows, dtypes = out.collect(), dict(df.dtypes)
    assert rows and all([r[n] for n in names] == expected(r, names, dtypes) for r in rows)
    ids = sorted(r.doc_id for r in rows)
    if stage == "near":
        assert ids == list(range(13))
    if stage == "contaminated":
        assert ids == [*range(12), 13]
    if stage == "mix":
        copies = {r.doc_id: int(r.copies) for r in mixing.copies_by_document(df).collect()}
        assert ids == sorted(i for i, n in copies.items() for _ in range(n))


def test_rows_that_differ_in_another_column_are_mixed_each_for_itself(spark):
    rows = [(1, "a b c d", "s", x) for x in range(4)] + [(1, "a b c d", "s", 0)] + [(2, "e f", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other long")
    got = [r.other for r in mixing.mix(df).collect()]
    assert sorted(set(got)) == [0, 1, 2, 3, 9]  # a share of 1.5 gives each row one copy at least
    assert len(got) == sum(int(r.copies) for r in mixing.copies_by_document(df).collect())
    assert all(got.count(x) <= 2 for x in (1, 2, 3, 9)) and got.count(0) <= 4
    maps = df.selectExpr("*", "map(other, text) AS m")
    assert sorted(r.m[r.other] for r in mixing.mix(maps).collect()) == sorted(r.text for r in mixing.mix(maps).collect())


@pytest.mark.parametrize("odd", [[], [1e12], [1e20], [1e160], [1e160, -1e160, 1e12, 1e308, 1e-170], [float("inf"), float("nan")]])
def test_far_off_vectors_lose_no_neighbour(spark, odd):
    rng = np.random.default_rng(0)
    v = rng.normal(0, 1, (900, 16)) + rng.integers(0, 3, (900, 1))
    far = np.zeros((len(odd), 16))
    for i, x in enumerate(odd):
        far[i] = rng.normal(0, 1, 16)
        far[i, i % 16] = x
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(np.concatenate([v, far]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = [i for i in range(len(rows)) if i % 50 == 0 or i >= 900]
    queries = df.where(df.vec_id.isin(asked))
    got = {}
    for r in onebit_search.search(df, queries, k=10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    usable = np.array([r for _, r in rows])
    ok = np.isfinite(usable).all(axis=1)
    assert set(got) == {i for i in asked if ok[i]}
    for q, found in got.items():
        exact = onebit_search.distances(usable[ok], np.repeat(usable[q : q + 1], ok.sum(), axis=0))
        order = sorted((d, i) for d, i in zip(exact, np.flatnonzero(ok)) if i != q)[:10]
        assert [found[k + 1] for k in range(10)] == [(i, d) for d, i in order]


def test_distances_beyond_the_square_root_of_doubles():
    a, b = np.array([[3e200, 0.0], [1.0, 2.0], [3e-200, 0.0], [1e308, 0.0]]), np.array([[0.0, 4e200], [1.0, 2.0], [0.0, 4e-200], [-1e308, 0.0]])
    assert onebit_search.distances(a, b) == pytest.approx([5e200, 0.0, 5e-200, np.inf], rel=1e-12)


def test_every_span_of_a_template_is_found():
    template = " ".join(f"w{i}" for i in range(30))
    automaton = licenses.LicenceAutomaton((), [(template, "x")])
    edited = template.replace("w10 ", "zz ").replace("w20 ", "yy ")
    text = f"{edited} other words here {template} and more {edited} {template}"
    spans = automaton.spans(automaton.scan(letter_words(text.encode()))[1])
    assert sorted((s["first"], s["last"]) for s in spans) == [(0, 29), (33, 62), (65, 94), (95, 124)]
    assert sorted(round(s["cover"], 2) for s in spans) == [0.93, 0.93, 1.0, 1.0]


def test_chains_look_back_as_far_as_the_gap():
    """A template word that many short matches end at between two parts of one chain."""
    template = "a b c d e f g h " + "k l m " * 6 + "q r s t u v w"
    automaton = licenses.LicenceAutomaton((), [(template, "x")])
    words = letter_words(template.encode())
    spans = automaton.spans(automaton.scan(words[:20] + [b"zz"] + words[20:])[1])
    assert [(s["first"], s["last"], s["cover"]) for s in spans] == [(0, len(words), 1.0)]
