"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

import random
import re

import corpus_pipeline as cp
from tests.llm.test_operators import WORDS, brute_classes


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    texts, toxic = [], []
    for i in range(240):
        words = [rng.choice(WORDS) for _ in range(50)]
        if i % 8 == 0:
            for k in (3, 20, 33, 41):
                words[k] = "grolk" + rng.choice(["a", "en"])
        if i % 10 == 3:
            words[7] = f"bo{i}@ex.org"
        texts.append(" ".join(words))
        toxic.append(int(i % 8 == 0))
    texts += [texts[1], texts[2].replace(texts[2].split()[49], "changed"), None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    kept = cp.drop_toxic(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == cp.COLUMNS and ids == {i for i in range(len(texts)) if i >= 240 or not toxic[i]}

    left = sorted(ids)
    classes = brute_classes([texts[i] for i in left], 5)
    one = cp.drop_near_duplicates(spark, kept, str(tmp_path))
    assert {r.doc_id for r in one.collect()} == {i for k, i in enumerate(left) if classes[k][2]}

    clean = {r.doc_id: r for r in cp.replace_personal_data(spark, one, str(tmp_path)).collect()}
    for i, r in clean.items():
        assert (r.text is None) == (texts[i] is None) and r.n_chars == (None if r.text is None else len(r.text))
        assert not re.search(r"bo\d+@ex", r.text or "") and (r.text == texts[i] or "@ex.org" in texts[i])

    pieces = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(clean)
    for i in clean:
        mine = [r for r in pieces if r.doc_id == i]
        assert sum(r.length for r in mine) == mine[0].doc_tokens


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
