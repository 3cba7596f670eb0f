"""Toxicity by weak supervision: voters, a generative label model over their votes, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import stored, through_python


@dataclass(frozen=True)
class Settings:
    """`sample` bounds the labelled rows from which lexicons are mined, `lexicon` their entries: both may be broadcast.
    A document is rejected at `reject`. `folds`, `held`: rows whose crc32(doc_id) mod folds is held never lend a label."""

    sample: int = 30_000
    lexicon: int = 4_000
    lexicons: int = 6
    prefixes: tuple = (4, 5, 6)
    least_docs: int = 3
    folds: int = 3
    held: int = 1
    reject: float = 0.7
    steps: int = 60


DEFAULT = Settings()
_EDGE = re.compile(r"^\W+|\W+$")
_SHOUT = re.compile(r"[!?]{2,}")


def held_out(doc_id: Column, s: Settings = DEFAULT) -> Column:
    """Rows whose labels are never learnt from; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % s.folds == s.held, F.lit(False))


def _entries(word: str, s: Settings) -> list[str]:
    """The lexicon entries that a word may match: itself (=word) and its beginnings (word*)."""
    w = _EDGE.sub("", word)
    return [f"={w}", *(f"{w[:k]}*" for k in s.prefixes if len(w) >= k)] if len(w) > 2 else []


def mine(docs: DataFrame, labels: DataFrame, s: Settings) -> list[tuple[str, int]]:
    """(entry, lexicon) from a bounded sample of labelled rows: entries that mark toxic rows, dealt out over the lexicons.

    Beginnings of words are entries too, as languages inflect. An entry needs `least_docs` toxic rows and must be 10 times
    likelier in toxic than in other rows. Of the entries that match alike, none is singled out: the classifier weighs them.
    """
    train = labels.filter(~held_out(F.col("doc_id"), s)).filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(train), "doc_id")  # bounded by sample

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pos, neg = {}, {}
            for text, toxic in zip(f["text"], f["toxic"], strict=True):
                into = pos if toxic else neg
                for e in {e for w in set(text.lower().split()) for e in _entries(w, s)}:
                    into[e] = into.get(e, 0) + 1
            yield pd.DataFrame([(e, pos.get(e, 0), n) for e, n in neg.items() if e not in pos] + [(e, n, neg.get(e, 0)) for e, n in pos.items()], columns=["entry", "pos", "neg"])

    counts = rows.mapInPandas(run, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = train.agg(F.sum(F.col("toxic")).alias("p"), F.count("*").alias("n")).first()
    p, q = max(n["p"] or 0, 1), max((n["n"] or 0) - (n["p"] or 0), 1)
    rate = (F.col("pos") / p) / ((F.col("neg") + 0.5) / q)
    best = counts.filter(F.col("pos") >= s.least_docs).withColumn("rate", rate).filter("rate >= 10")
    best = best.orderBy(F.desc(F.log("rate") * F.sqrt("pos")), "entry").limit(s.lexicon).collect()  # bounded by lexicon
    return [(r["entry"], xxhash.xxh32_intdigest(r["entry"][:5]) % s.lexicons) for r in best]


def _pattern_votes(text: str, words: list[str]) -> list[int]:
    """Pattern voters: mostly capitals; runs of marks; one word again and again."""
    loud = sum(map(str.isupper, text.split()))
    return [int(len(words) >= 5 and loud > 0.6 * len(words)), int(len(_SHOUT.findall(text)) >= 2), int(len(words) >= 20 and len(set(words)) < 0.4 * len(words))]


def votes(docs: DataFrame, lexicon: list[tuple[str, int]], s: Settings, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, bits (vote k is bit k), found (the matching entries, one for each distinct word), for whole texts.

    `carry`: names and values of columns of longs to keep.

    Voters: each lexicon twice (a word of it; three words of it or more), all lexicons together (two words or more), and the
    pattern voters.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(dict(lexicon))  # bounded by lexicon
    names = list(carry or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        which, known = shared.value, {}
        for f in frames:
            bits, found = [], []
            for text in f["text"]:
                words = text.lower().split()
                if len(known) > 300_000:
                    known.clear()
                hit = []
                for w in set(words):
                    e = known.get(w)
                    if e is None:
                        e = known[w] = [x for x in _entries(w, s) if x in which]
                    if e:
                        hit.append(e)
                n = [0] * s.lexicons
                for e in hit:
                    for k in {which[x] for x in e}:
                        n[k] += 1
                v = [int(x >= 1) for x in n] + [int(x >= 3) for x in n] + [int(len(hit) >= 2), *_pattern_votes(text, words)]
                bits.append(sum(b << i for i, b in enumerate(v)))
                found.append(sorted(x for e in hit for x in e))
            yield pd.DataFrame({"doc_id": f["doc_id"], **{c: f[c] for c in names}, "bits": bits, "found": found})

    kept = "".join(f"{c} long, " for c in carry or {})
    return through_python(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(v.alias(c) for c, v in (carry or {}).items())), run, "doc_id", f"{kept}bits long, found array<string>")


def label_model(counts: list[tuple[int, int | None, int]], voters: int, steps: int) -> dict[int, float]:
    """Posterior of each pattern of votes, from (bits, label or None, rows) of all rows.

    Generative: the class is drawn, then each voter's vote with an accuracy of its own for each class. Expectation-
    maximisation over all rows estimates them; labelled rows are held to their label in place of an expectation. Voters
    that repeat one another would be counted twice: from the within-class correlations, estimated along with them, a vote's
    evidence is divided by one plus the sum of the squared correlations with the other voters.
    """
    bits = np.array([c[0] for c in counts], np.int64)
    label = np.array([-1 if c[1] is None else int(c[1] > 0) for c in counts])
    n = np.array([c[2] for c in counts], float)
    v = ((bits[:, None] >> np.arange(voters)) & 1).astype(float)
    known = label >= 0
    prior = (n[label == 1].sum() + 1) / (n[known].sum() + 20) if known.any() else 0.1
    post = np.where(known, label, np.where(v.any(axis=1), np.minimum(0.9, 0.3 * v.sum(axis=1)), 0.02))
    for _ in range(steps):
        theta, weight = [], np.zeros((voters, voters))
        for w in (n * (1 - post), n * post):
            t = (w @ v + 0.1) / (w.sum() + 1)
            theta.append(np.clip(t, 1e-5, 1 - 1e-3))
            d = v - t
            cov = (d * w[:, None]).T @ d / max(w.sum(), 1e-9)
            sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
            weight += (cov / sd / sd[:, None]) ** 2 * 0.5
        np.fill_diagonal(weight, 0)
        share = 1 / (1 + weight.sum(axis=1))
        ratio = v * np.log(theta[1] / theta[0]) + (1 - v) * np.log((1 - theta[1]) / (1 - theta[0]))
        logit = np.log(prior / (1 - prior)) + ratio @ share
        free = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        new = np.where(known, 0.02 + 0.96 * label, free)
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return {int(b): float(p) for b, p in zip(bits, free, strict=True)}


def score(docs: DataFrame, labels: DataFrame, s: Settings = DEFAULT, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, posterior, bits for every row of docs, repeated rows included.

    labels (doc_id, toxic) lends labels of rows that are not held out, and nothing else; a score depends on the text alone.
    Null or empty text gets the score of a text without any evidence. Without usable labels or with labels of one class the
    score is 0. An empty table gives no rows. A null id is kept. Other columns are ignored.
    """
    lexicon = mine(docs, labels, s)
    voters = 2 * s.lexicons + 4
    rows = stored(votes(docs, lexicon, s, carry))
    lent = labels.filter(~held_out(F.col("doc_id"), s)).filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    seen = rows.select("doc_id", "bits").join(lent, F.col("doc_id") == F.col("id"), "left").groupBy("bits", "toxic").agg(F.count("*").alias("n"))
    counts = [tuple(r) for r in seen.collect()]  # one row for each pattern of votes at most, however many documents
    out = rows.withColumn("held_out", held_out(F.col("doc_id"), s))
    if not lexicon or not any(t for _, t, _ in counts):
        out = out.withColumn("score", F.lit(0.0)).withColumn("posterior", F.lit(0.0))
    else:
        posterior = label_model(counts, voters, s.steps)
        of = docs.sparkSession.createDataFrame(sorted(posterior.items()), "b long, posterior double")
        out = out.join(F.broadcast(of), F.col("bits") == F.col("b")).drop("b")
        terms = F.concat("found", F.filter(F.array(*(F.when(F.shiftrightunsigned("bits", k).bitwiseAND(1) == 1, F.lit(f"#{k}")) for k in range(voters))), lambda x: x.isNotNull()))
        vocabulary = [e for e, _ in lexicon] + [f"#{k}" for k in range(voters)]
        count = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="features")
        out = out.withColumn("terms", terms)
        # texts with the same evidence are one row of the training set
        alike = out.groupBy("terms", "posterior").agg(F.count("*").cast("double").alias("n"))
        sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("p")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("p"))))
        fit = count.transform(alike).select("features", "n", sides.alias("x")).select("features", "x.label", (F.col("n") * F.col("x.p")).alias("weight")).filter("weight > 0")
        model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=40).fit(fit)
        out = model.transform(count.transform(out)).withColumn("score", vector_to_array("probability")[1])
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= s.reject, 1).otherwise(0).alias("predicted"), "posterior", "bits", *(carry or {}))


def clean(docs: DataFrame, labels: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns. The verdict is on the text, so copies share it."""
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    scored = score(docs.select("doc_id", "text"), labels, s, carry={"__h": h})
    bad = scored.filter("predicted = 1").select(F.col("doc_id").alias("__id"), "__h").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (h == F.col("__h"))
    return docs.join(bad, same, "left_anti")
