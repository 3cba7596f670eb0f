"""The manifest against a plain tree in memory."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tracegrid.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text) -> str:
    doc_id, _, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def tree(leaves: list[str]) -> list[list[str]]:
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def plain(rows) -> list[tuple]:
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, order = [], []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        order.append(own)
        trees.append(tree([leaf(r, r[1]) for r in own]))
    top, out = tree([t[-1][0] for t in trees]), []
    for k, own in enumerate(order):
        for p, r in enumerate(own):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h, proof = leaf(r, r[1].translate(LOWER) if hit and r[1] is not None else r[1]), ""
            for levels, at in ((trees[k], p), (top, k)):
                for level in levels[:-1]:
                    i = at - at % 8
                    left, right = "".join(level[i:at]), "".join(level[at + 1 : i + 8])
                    h, proof, at = sha(left + h + right), proof + left + right, at // 8
            root = top[-1][0]
            out.append((r[0], leaf(r, r[1]), trees[k][-1][0], root, sha(proof), h, h == root))
    return sorted(out, key=str)


def check(spark, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    got = sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str)
    assert got == plain(rows)
    return got


def test_many_leaves_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 64)
    rows = [(i * 7, f"Text {i} É", "en" if i % 5 else "de", None if i % 11 == 0 else "s", i) for i in range(700)]
    got = check(spark, rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_nulls_ties_repeats_and_lone_leaves(spark):
    rows = [(None, None, None, None, None), (1, "", None, "s", 0), (1, "A", "x", "s", 1), (1, "A", "x", "s", 1), (1, "B", "x", "", 1), (5, "Q" * 100_000, "ü", "s", 3), (6, "q:-", "-", "s", None)]
    check(spark, rows, extra=("row", "leaf", "tree", "hash", "TAMPERED", "id"))


def test_many_languages_make_levels(spark):
    check(spark, [(i, "T", f"l{i % 70:02d}", "s", 1) for i in range(100)])


@pytest.mark.parametrize("rows", [[], [(3, "Only", "en", "s", 4)], [(3, "Only", "en", "s", 4), (4, "Two", "en", "s", 3)]])
def test_few(spark, rows):
    check(spark, rows)


def test_an_unchanged_text_verifies(spark):
    got = merkle.manifest(spark.createDataFrame([(i, "no capitals", "en", "s", 1) for i in range(30)], SCHEMA))
    assert got.filter("verified").count() == 30
