"""Languages of texts: scripts narrow the candidates, letter sequences score words, Viterbi with a penalty for switching labels spans."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import through_python

# Code point ranges of scripts. Letters elsewhere are of one more script, the last.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
NONE, MARK = -1, -2
ORDERS = 4


@dataclass(frozen=True)
class Settings:
    """buckets: numbers that each order of letter sequences has in each language (sequences share them by hash).
    prior: letters' worth of the pooled distribution in each language's. least: share of a language's letters from which on a
    script is one of its own. penalty: what a switch costs, in nats. modulus, held: ids whose checksum has that remainder are not
    learnt from. chars: code points times languages that a task labels in one go."""

    buckets: int = 1 << 15
    prior: float = 300.0
    least: float = 0.01
    penalty: float = 10.0
    modulus: int = 4
    held: int = 2
    chars: int = 24_000_000


DEFAULT = Settings()


def held_out(doc_id: Column, s: Settings = DEFAULT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % s.modulus == s.held, F.lit(False))


@functools.cache
def _points() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: the script of a letter (NONE: no letter, MARK: belongs to the letter before), and its lower case."""
    script, lower = np.full(0x110000, NONE, np.int8), np.arange(0x110000, dtype=np.int32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            script[c] = len(SCRIPTS)
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
        elif kind == "M":
            script[c] = MARK
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            part = script[a : b + 1]
            part[part >= 0] = k
    return script, lower


@dataclass
class Words:
    """The words of some texts: runs of letters of one script with their marks. code: lower-cased code points of all texts;
    at: places of the words' characters; word: whose they are; start, stop: places in all texts; text: whose word it is."""

    code: np.ndarray
    at: np.ndarray
    word: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    script: np.ndarray
    text: np.ndarray
    offset: np.ndarray


def words(texts: list[str]) -> Words:
    script, lower = _points()
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
    s = script[code]
    s = s[np.maximum.accumulate(np.where(s != MARK, np.arange(len(s)), 0))]
    s = np.where(s == MARK, NONE, s)  # marks without a letter before
    before = np.concatenate(([NONE], s[:-1])) if len(s) else s
    start = np.flatnonzero((s >= 0) & (s != before))
    at = np.flatnonzero(s >= 0)
    word = np.searchsorted(start, at, "right") - 1
    count = np.bincount(word, minlength=len(start))
    return Words(lower[code], at, word, start, start + count, s[start], np.searchsorted(offset, start, "right") - 1, offset)


def grams(w: Words, s: Settings, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders + 1, characters) numbers of the letter sequences that end at characters a to b of the words, and a mask of those
    that exist. A word's start counts as a letter, as does its end: the last row is that of the words' last two letters and end."""
    at, word = w.at[a:b], w.word[a:b]
    place = at - w.start[word]
    back = [w.code[at]]
    for k in range(1, ORDERS):
        back.append(np.where(place >= k, w.code[np.maximum(at - k, 0)], 0))
    out, there = np.empty((ORDERS + 1, len(at)), np.int64), np.ones((ORDERS + 1, len(at)), bool)
    h, shift = np.zeros(len(at), np.uint32), 32 - (s.buckets.bit_length() - 1)
    for k in range(ORDERS):
        h = (h ^ back[k].astype(np.uint32)) * np.uint32(0x9E3779B1) + np.uint32(k + 1)
        h ^= h >> np.uint32(15)
        out[k] = ((h * np.uint32(0x85EBCA77)) >> np.uint32(shift)) + k * s.buckets
        there[k] = place >= k - 1
    h = (back[0].astype(np.uint32) * np.uint32(0xC2B2AE3D) ^ back[1].astype(np.uint32)) * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(13)
    out[ORDERS] = ((h * np.uint32(0x85EBCA77)) >> np.uint32(shift)) + (ORDERS - 1) * s.buckets
    there[ORDERS] = at + 1 == w.stop[word]
    return out, there


@dataclass
class Model:
    """Languages, the most frequent first; for each sequence and language the logarithm of its share there over that in all; which
    languages each script leaves."""

    languages: list[str]
    ratio: np.ndarray
    candidate: np.ndarray
    settings: Settings


def _counts(frames: Iterator[pd.DataFrame], s: Settings) -> Iterator[pd.DataFrame]:
    """(lang, number, n): sequences, and behind them the letters of each script, counted over a task before anything is shuffled."""
    held: dict[str, np.ndarray] = {}
    size, scripts = ORDERS * s.buckets, len(SCRIPTS) + 1

    def put() -> Iterator[pd.DataFrame]:
        for lang, c in held.items():
            number = np.flatnonzero(c)
            yield pd.DataFrame({"lang": np.full(len(number), lang, object), "number": number, "n": c[number]})

    for f in frames:
        for lang, own in f.groupby("lang"):
            c = held.setdefault(lang, np.zeros(size + scripts, np.int64))
            for part in _batches(own["text"], 1 << 20):
                w = words(part)
                for a in range(0, len(w.at), 1 << 20):
                    g, there = grams(w, s, a, a + (1 << 20))
                    c[:size] += np.bincount(g[there], minlength=size)
                c[size:] += np.bincount(w.script, w.stop - w.start, scripts).astype(np.int64)
            if len(held) > 64:
                yield from put()
                held.clear()
    yield from put()


def _batches(texts: pd.Series, chars: int) -> Iterator[list[str]]:
    """Consecutive texts of about so many code points together; a longer text is one by itself."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > chars:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def fit(docs: DataFrame, s: Settings = DEFAULT) -> Model:
    """Counts over the whole texts of all rows of docs (text, lang) that have both. What reaches the driver has a bound: for each
    language, its sequence numbers (orders * buckets at most)."""
    counts = docs.filter("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang")).mapInPandas(lambda f: _counts(f, s), "lang string, number int, n long")
    got = counts.groupBy("lang", "number").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    size, scripts = ORDERS * s.buckets, len(SCRIPTS) + 1
    letters = got[got["number"] >= size].groupby("lang")["n"].sum()
    languages = sorted(letters.index, key=lambda x: (-letters[x], x))
    table = np.zeros((size + scripts, len(languages)))
    table[got["number"].to_numpy(int), got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = got["n"].to_numpy()
    by_order = table[:size].reshape(ORDERS, s.buckets, len(languages))
    pooled = by_order.sum(axis=2, keepdims=True) + 0.5
    pooled /= pooled.sum(axis=1, keepdims=True)
    ratio = np.log((by_order / pooled + s.prior) / (by_order.sum(axis=1, keepdims=True) + s.prior))
    share = table[size:] / np.maximum(table[size:].sum(axis=0), 1)
    candidate = share >= s.least
    return Model(languages, ratio.reshape(size, len(languages)).astype(np.float32), candidate, s)


def word_scores(w: Words, m: Model) -> np.ndarray:
    """(words, languages): the sum of a word's ratios over its sequences, the mean over the orders; languages that its script rules
    out are out of reach. A script that no language has says nothing."""
    out, s = np.zeros((len(w.start), len(m.languages)), np.float32), m.settings
    for a in range(0, len(w.at), 1 << 20):
        g, there = grams(w, s, a, a + (1 << 20))
        own = w.word[a : a + (1 << 20)]
        first, n = own[0], own[-1] - own[0] + 1
        for j in range(len(m.languages)):
            column = m.ratio[:, j]
            each = sum(np.where(there[k], column[g[k]], 0) for k in range(ORDERS + 1)) / ORDERS
            out[first : first + n, j] += np.bincount(own - first, each, n)
    known = m.candidate.any(axis=1)
    out[~known[w.script]] = 0
    barred = known[:, None] & ~m.candidate
    return np.where(barred[w.script], np.float32(-1e6), out)


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word, where a text's words are rows first, first + 1, ... of scores: the labels of largest sum less
    the penalty for each switch. Texts go forward and back side by side, a word at a time. Ties: no switch, the first label."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    label = np.zeros(len(scores), np.int32)
    if not len(scores):
        return label
    longest = int(count[0])
    alive = np.searchsorted(-count, -np.arange(1, longest + 1), "right")
    origin, switched = np.zeros(len(scores), np.int32), np.zeros(scores.shape, bool)
    best = np.zeros((len(count), scores.shape[1]))
    for t in range(longest):
        n = alive[t]
        row, b = first[:n] + t, best[:n]
        if t:
            top = b.argmax(axis=1)
            jump = (b[np.arange(n), top] - penalty)[:, None]
            move = jump > b
            switched[row], origin[row] = move, top
            np.copyto(b, jump, where=move)
        b += scores[row]
    now = best.argmax(axis=1).astype(np.int32)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        row = first[:n] + t
        label[row] = now[:n]
        now[:n] = np.where(switched[row, now[:n]], origin[row], now[:n])
    return label


def _labelled(texts: list[str], m: Model) -> tuple[list, list, list]:
    """Languages, scores and spans of texts."""
    k, s = len(m.languages), m.settings
    names, shares, spans = [], [], []
    for part in _batches(pd.Series(texts, dtype=object), max(1, s.chars // max(k, 4))):
        w = words(part)
        first, stop = np.searchsorted(w.text, np.arange(len(part))), np.searchsorted(w.text, np.arange(len(part)), "right")
        if not k:
            names += ["und"] * len(part)
            shares += [0.0] * len(part)
            spans += [[]] * len(part)
            continue
        label = viterbi(word_scores(w, m), first, stop - first, s.penalty)
        long = w.stop - w.start
        letters = np.bincount(w.text * k + label, long, len(part) * k).reshape(len(part), k)
        most, every = letters.argmax(axis=1), letters.sum(axis=1)
        names += [m.languages[j] if n else "und" for j, n in zip(most, every, strict=True)]
        shares += (letters.max(axis=1) / np.maximum(every, 1)).tolist()
        change = np.flatnonzero((np.diff(w.text, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
        last = np.append(change[1:], len(label)) - 1 if len(change) else change
        own: list[list] = [[] for _ in part]
        base = w.offset[w.text[change]]
        for t, a, b, j in zip(w.text[change].tolist(), (w.start[change] - base).tolist(), (w.stop[last] - base).tolist(), label[change].tolist(), strict=True):
            own[t].append({"start": a, "stop": b, "lang": m.languages[j]})
        spans += own
    return names, shares, spans


def label(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans of every row of docs (doc_id, text).

    spans: (start, stop, lang) in code points, from the first to the last word of consecutive words of one language. lang_pred is
    the language whose spans hold most letters, score their share of all the text's letters.

    Null text and text without a letter: `und`, score 0, no spans; so is every text if nothing was learnt. A letter of a script
    that no language has says nothing about it. Ties go to the language with more training text. Repeated rows are labelled each, a
    null id is kept, other columns are ignored. The labels of a text's words are in one task at a time, its characters in parts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 2000):
                g = f.iloc[a : a + 2000]
                names, shares, spans = _labelled(g["text"].tolist(), shared.value)
                yield pd.DataFrame({"doc_id": g["doc_id"].to_numpy(object), "held_out": g["held_out"].to_numpy(), "lang_pred": pd.Series(names, dtype=object), "score": shares, "spans": pd.Series(spans, dtype=object)})

    rows = docs.select("doc_id", held_out(F.col("doc_id"), m.settings).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return through_python(rows, run, "doc_id", "held_out boolean, lang_pred string, score double, spans array<struct<start: long, stop: long, lang: string>>")


def identify(docs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """label() by a model of the rows that are not held out."""
    return label(docs, fit(docs.filter(~held_out(F.col("doc_id"), s)), s))
