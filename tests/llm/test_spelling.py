"""Spelling variants against plain comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.llm import spelling


def one_apart(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(rows) -> dict:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count: Counter = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def got(spark, rows, size=spelling.LIST, extra=()):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, size=size).collect()}


def made(seed: int, words: int, letters: str, sizes=(5, 9)) -> list[tuple]:
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(words)]
    out = []
    for i in range(120):
        text = []
        for _ in range(60):
            w = rng.choice(base[: max(1, int(len(base) * rng.random() ** 3))])
            if rng.random() < 0.5:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            text.append(w)
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize(("seed", "letters", "size"), [(1, "ab", 512), (2, "abcé", 512), (3, "aÀÿz", 4)])
def test_same_as_all_pairs(spark, seed, letters, size):
    """Also with lists split down to a few words."""
    rows = made(seed, 60, letters)
    want = plain(rows)
    assert len(want) > 50 and any(w[0] for w in want.values()) and got(spark, rows, size) == want


def test_one_beginning_shared_by_all(spark):
    rows = [(i, " ".join("x" * 20 + f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh")) for i in range(4)]
    assert got(spark, rows, size=3) == plain(rows)


def test_nulls_repeats_ties_and_long_words(spark):
    long = "ab" * 5000
    rows = [(None, "Straße STRASSE strasse"), (None, None), (1, ""), (2, "12 -- 日本"), (3, f"{long} {long}q {long}"), (3, f"{long} {long}q {long}q"), (4, "aaaaa aaaaa aaaaaa aaaaaa aaaaa aaaaaa baaaa baaaa baaaa Baaaa×÷")] * 2
    assert got(spark, rows, extra=("word", "KEY", "n", "near")) == plain(rows)


def test_chains_lead_to_the_root(spark):
    words = {"house": 40, "houst": 20, "houts": 3, "hoist": 10, "hoists": 4, "foists": 3}
    rows = [(7, " ".join(w for w, n in words.items() if n > i)) for i in range(40)]
    out = got(spark, rows)
    assert out == plain(rows) and len({v[1] for v in out.values()}) < len(out)


def test_no_words(spark):
    assert got(spark, []) == {} and got(spark, [(1, "a b c")]) == {}


def test_rows_of_the_matrix_over_one_list():
    """near() itself, against all pairs, over several lists at once."""
    rng = random.Random(5)
    for letters in ("ab", "abcdef"):
        parts = sorted({(g, "".join(rng.choice(letters) for _ in range(rng.randint(3, 4)))) for g in range(6) for _ in range(40)})
        data = [p.encode() for _, p in parts]
        size = np.array([len(p) for p in data])
        q, w = spelling.near(np.frombuffer(b"".join(data), np.uint8), np.cumsum(size) - size, size, np.array([g for g, _ in parts]), np.full(len(data), 4))
        want = {(i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if a[0] == b[0] and len(a[1]) == 4 and one_apart(a[1], b[1])}
        assert set(zip(q.tolist(), w.tolist(), strict=True)) == want and len(q) == len(want)
