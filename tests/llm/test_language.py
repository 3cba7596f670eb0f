"""Languages: Viterbi against all labellings, spans of mixed texts, scripts, held-out accuracy."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.llm import language as L
from tracegrid.llm.common import table

SYLLABLES = {"aa": ["ka", "to", "mi", "ren", "sul"], "bb": ["sch", "ung", "eit", "der", "wö"], "cc": ["жи", "ста", "во", "рел"]}


def text(lang: str, n: int, rng) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, text(lang, 60, rng), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), [5, 3, 2], k=120))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(docs):
    return L.fit(docs)


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(3)
    counts = np.array([4, 0, 6, 1, 3])
    first = np.cumsum(counts) - counts
    scores = rng.normal(0, 2, (counts.sum(), 3)).astype(np.float32)
    got = L.viterbi(scores, first, counts, 1.5)
    for a, n in zip(first, counts, strict=True):
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 1.5 * sum(x != y for x, y in itertools.pairwise(p)))
        assert tuple(got[a : a + n]) == best


def test_word_scores_are_sums_over_sequences(model):
    """A word's score does not depend on the texts around it, nor on how they are cut."""
    alone = L.word_scores(L.words(["Katomi"]), model)
    w = L.words(["x", "wö katomi der", "", "KATOMI"])
    among = L.word_scores(w, model)
    assert np.allclose(among[w.stop - w.start == 6], alone, atol=1e-4) and len(w.start) == 5


def test_mixed_text_falls_into_spans(spark, model):
    rng = random.Random(2)
    a, b, c = text("aa", 30, rng), text("bb", 50, rng), text("cc", 10, rng)
    mixed = f"{a} -- {b}. {c}"
    r = L.label(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert [s.lang for s in r.spans] == ["aa", "bb", "cc"] and r.lang_pred == "bb"
    assert [mixed[s.start : s.stop] for s in r.spans] == [a, b, c]
    letters = [sum(x.isalpha() for x in t) for t in (a, b, c)]
    assert r.score == pytest.approx(letters[1] / sum(letters))


def test_script_decides(spark, model):
    r = L.label(spark.createDataFrame([(1, "ъъъ ьь"), (2, "日本語 kato"), (3, "日本語")], "doc_id long, text string"), model).collect()
    assert [x.lang_pred for x in r] == ["cc", "aa", model.languages[0]]


def test_marks_and_case_keep_places():
    w = L.words(["İéA  ́b"])
    assert (w.start.tolist(), w.stop.tolist()) == ([0, 7], [4, 8])


def test_nulls_empty_repeats_and_long_texts(spark, docs):
    rng = random.Random(4)
    long = text("bb", 40_000, rng)
    extra = spark.createDataFrame([(None, None, "aa"), (None, text("aa", 9, rng), None), (500, "", "aa"), (501, "12 ?! ́", "bb"), (502, long, None), (502, long, None)], docs.schema)
    every = docs.unionByName(extra).withColumns({"label": F.lit(1), "Held_Out": F.lit("x"), "n": F.lit(2)})
    out = L.identify(every)
    assert out.count() == 126
    got = out.filter("doc_id is null or doc_id >= 500").collect()
    assert sorted((r.doc_id or 0, r.lang_pred, r.score > 0) for r in got) == [(0, "aa", True), (0, "und", False), (500, "und", False), (501, "und", False), (502, "bb", True), (502, "bb", True)]


def test_without_training_all_is_und(spark, docs):
    assert {r.lang_pred for r in L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.identify(docs.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    j = L.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = j.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 150 and right >= 0.98 * n


def test_held_out_rows_change_nothing(spark, docs):
    """Neither labels nor texts of held-out rows reach a prediction of another row."""
    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "aa").otherwise(F.col("lang")))
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in L.identify(df).collect())
    assert key(docs) == key(other)
