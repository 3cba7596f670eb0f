"""Draws hashed many at once are those of one hash each, and the paired bootstrap's draws don't go through Spark rows."""

import hashlib
import random

import numpy as np
import pytest

from tracegrid.functions import hashing
from tracegrid.operators import evaluation as E


@pytest.mark.parametrize(("prefix", "start", "end"), [("7:0:", 0, 1205), ("7:199:", 99_990, 100_012), ("7:3:", 299_999, 300_001), ("seed of more than a word:12:", 4_123_456_780, 4_123_456_790), ("", 7, 7)])
def test_fractions(prefix, start, end):
    want = [int(hashlib.sha256(f"{prefix}{j}".encode()).hexdigest()[:13], 16) / 2**52 for j in range(start, end)]
    assert [x for part in hashing.fractions(prefix, start, end) for x in part] == want


def test_too_long():
    with pytest.raises(ValueError, match="one block"):
        list(hashing.fractions("x" * 55, 0, 1))


def test_paired_bootstrap(spark, monkeypatch):
    """Against draws one by one, over several rows and tasks a replicate; ranks may be missing."""
    monkeypatch.setattr(E, "BLOCK_DRAWS", 64)
    rnd = random.Random(3)
    ranks = [(rnd.choice([1, 1, 2, 3, None]), rnd.choice([1, 2, 4, None, 0])) for _ in range(205)]
    pairs = spark.createDataFrame([(f"i{k}", *r) for k, r in enumerate(ranks)], "incident_id string, rank_a long, rank_b long")
    got = {r["metric"]: r for r in E.paired_bootstrap(pairs, 20).collect()}
    last = lambda x: (x is None, x or 0)
    places = sorted(ranks, key=lambda r: (last(r[0]), last(r[1])))
    draw = lambda b, j: places[int(int(hashlib.sha256(f"7:{b}:{j}".encode()).hexdigest()[:13], 16) / 2**52 * len(places))]
    score = {"ac1": lambda r: float(r == 1), "mrr": lambda r: 1 / r if r else 0.0}
    for metric, of in score.items():
        means = sorted(np.mean([of(a) - of(b) for a, b in (draw(k, j) for j in range(205))]) for k in range(20))
        want = [np.mean([of(a) - of(b) for a, b in ranks]), means[round(19 * 0.025)], means[round(19 * 0.975)]]
        assert [got[metric][c] for c in ("difference", "low", "high")] == pytest.approx(want, abs=1e-12)
    assert E.paired_bootstrap(pairs.limit(0), 20).count() == 0
