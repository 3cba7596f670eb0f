"""Subword lattice likelihood: piece scores weight all segmentations of a text, a forward recursion in logarithms sums them."""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import stored


@dataclass(frozen=True)
class Settings:
    """`model`: the public vocabulary. `classes`: mixture components at most, one for each common value of `by`.
    `rounds`: re-estimations of the piece scores. `common`: words whose scores are broadcast at most; all others are joined."""

    model: str = "piece_bpe_32k.model"
    by: str = "lang"
    classes: int = 8
    rounds: int = 3
    common: int = 500_000
    folds: int = 5
    held: int = 1
    #: Code points of a word up to which its arcs are held, for many words at once. Longer words are gone through one by one.
    longest: int = 256


DEFAULT = Settings()
_START = "▁"  # how the vocabulary marks the start of a word


def held_out(doc_id: Column, s: Settings = DEFAULT) -> Column:
    """Rows that are not learnt from; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % s.folds == s.held, F.lit(False))


@cache
def vocabulary(path: str) -> dict[str, tuple[int, float]]:
    """Piece -> (id, score) of the public vocabulary, without control pieces; byte pieces are kept as <0x..>."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return {m.id_to_piece(i): (i, m.get_score(i)) for i in range(m.get_piece_size()) if not m.is_control(i) and not m.is_unknown(i)}


def prior(path: str) -> np.ndarray:
    """Log-probabilities of the piece ids by the vocabulary's own scores, and of the stop at a word's end (last entry).

    The scores of this vocabulary fall by one from rank to rank; frequencies fall about as one over the rank. Pieces that
    start a word and pieces that go on are two distributions; the stop competes with the pieces that go on.
    """
    v = vocabulary(path)
    out = np.full(max(i for i, _ in v.values()) + 2, -np.inf)
    for p, (i, score) in v.items():
        out[i] = -math.log(50 + max(0.0, -score))
    return normal(out, path, np.log(0.35))


@cache
def _starts(path: str) -> np.ndarray:
    v = vocabulary(path)
    out = np.zeros(max(i for i, _ in v.values()) + 2, bool)
    for p, (i, _) in v.items():
        out[i] = p.startswith(_START)
    return out


def normal(logs: np.ndarray, path: str, stop: float) -> np.ndarray:
    """Pieces that start a word sum to one; pieces that go on, and the stop, sum to one."""
    out, s = logs.copy(), _starts(path)
    on = ~s
    on[-1] = False
    for m, room in ((s, 1.0), (on, 1 - math.exp(stop))):
        out[m] += math.log(room) - np.logaddexp.reduce(out[m])
    out[-1] = stop
    return out


class Lattice:
    """Forward recursion over the segmentations of a word into pieces: a start piece (or the bare mark), then others.

    `logs`: one or several lists of log-probabilities by piece id; the arcs of a word are found once for all of them.
    """

    def __init__(self, path: str, logs: list[np.ndarray], longest: int):
        v = vocabulary(path)
        byte = lambda p: len(p) == 6 and p.startswith("<0x")
        self.first = {p[1:]: i for p, (i, _) in v.items() if p.startswith(_START)}
        self.next = {p: i for p, (i, _) in v.items() if not p.startswith(_START) and not byte(p)}
        self.byte = {int(p[3:5], 16): i for p, (i, _) in v.items() if byte(p)}
        self.most, self.longest, self.logs = max(map(len, v)), longest, [x.tolist() for x in logs]
        self.table = np.vstack([np.array(logs).T, np.full((1, len(logs)), -np.inf)])  # the last row, -1: no piece
        index = lambda d: _Index(np.array([_hash(p) for p in d], np.uint64), np.array(list(d.values())))
        self.starts, self.others = index({p: i for p, i in self.first.items() if p}), index(self.next)

    def _into(self, word: str, b: int) -> list[tuple[int, tuple[int, ...]]]:
        """The arcs into place b > 0 as (place before, pieces). Place -1 is the word's start, without the bare mark. A code
        point that is no piece is spelt in bytes, which is one arc of several pieces."""
        into, after = [], self.next
        if b <= self.most and (i := self.first.get(word[:b])) is not None:
            into.append((-1, (i,)))
        for a in range(max(0, b - self.most), b):
            i = after.get(word[a:b])
            if i is not None:
                into.append((a, (i,)))
        if not into or into[-1][0] != b - 1:
            into.append((b - 1, tuple(self.byte[x] for x in word[b - 1].encode("utf-8", "surrogatepass"))))
        return into

    def _steps(self, word: str) -> Iterator[list[float]]:
        """For each place from 0, the logs of all ways to it, one for each list of logs; of places only the last are held."""
        exp, log, held, base = math.exp, math.log, [[x[self.first[""]]] for x in self.logs], 0
        yield [f[-1] for f in held]
        for b in range(1, len(word) + 1):
            into = self._into(word, b)
            for f, logs in zip(held, self.logs, strict=True):
                terms = [(f[a - base] if a >= 0 else 0.0) + sum([logs[x] for x in p]) for a, p in into]
                best = max(terms)
                f.append(best + log(sum([exp(t - best) for t in terms])))
            yield [f[-1] for f in held]
            if len(held[0]) > 64 * self.most:
                base += len(held[0]) - self.most
                for f in held:
                    del f[: -self.most]

    def forward(self, word: str) -> list[float]:
        """Log of the word's probability, all segmentations together, for each list of logs."""
        for last in self._steps(word):
            pass
        return [f + logs[-1] for f, logs in zip(last, self.logs, strict=True)]

    def expected(self, word: str) -> list[tuple[int, float]]:
        """(piece, expected count) over the word's segmentations by the first logs, by a forward and a backward recursion.
        The arcs are looked for again on the way back, so that a place of a long word takes two numbers."""
        out, exp, logs = Counter(), math.exp, self.logs[0]
        f = array("d", (x[0] for x in self._steps(word)))
        back = array("d", bytes(8 * len(f)))  # the share of all paths that pass a place
        back[-1] = 1.0
        for b in range(len(f) - 1, 0, -1):
            for a, p in self._into(word, b):
                share = back[b] * exp(min(0.0, (f[a] if a >= 0 else 0.0) + sum([logs[x] for x in p]) - f[b]))
                for i in p:
                    out[i] += share
                if a >= 0:
                    back[a] += share
        return list(out.items())

    def _batches(self, words: list[str]) -> Iterator[tuple]:
        """Words that are not longer than `longest`, many at once, as (places, words) arrays: their numbers and lengths, the
        code points, the pieces of word[:b] at b - 1, and for each length l from 1 the pieces of word[a : a + l] at a. -1: no piece."""
        order = sorted((j for j, w in enumerate(words) if 0 < len(w) <= self.longest), key=lambda j: len(words[j]))
        while order:
            most = len(words[order[min(len(order), 10_000) - 1]])
            many = min(10_000, max(1, 2_000_000 // (most * min(most, self.most))))
            batch, order = order[:many], order[many:]
            width = len(words[batch[-1]])
            points = np.frombuffer("".join(words[j].ljust(width, "\0") for j in batch).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(batch), width).T
            h, start, after = np.zeros(points.shape, np.uint64), np.full(points.shape, -1), []
            for n in range(1, min(width, self.most) + 1):
                h = h[: width - n + 1] * _STEP + points[n - 1 :] + np.uint64(1)
                start[n - 1] = self.starts.find(h[0])
                after.append(self.others.find(h))
            yield np.array(batch), np.array([len(words[j]) for j in batch]), points, start, after

    def _recursion(self, points: np.ndarray, start: np.ndarray, after: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Logs of all ways to each place (places from 0, words, lists of logs), and of the spelling in bytes of the code
        points that are no piece, else -inf."""
        table = self.table
        spelt = np.full((*points.shape, len(self.logs)), -np.inf)
        none = after[0] < 0
        if none.any():
            which, at = np.unique(points[none], return_inverse=True)
            spelt[none] = np.array([table[[self.byte[x] for x in chr(p).encode("utf-8", "surrogatepass")]].sum(axis=0) for p in which.tolist()])[at]
        f = np.empty((len(points) + 1, points.shape[1], len(self.logs)))
        f[0] = table[self.first[""]]
        for b in range(1, len(f)):
            terms = [table[start[b - 1]], f[b - 1] + spelt[b - 1]]
            terms += [f[b - n] + table[x[b - n]] for n, x in enumerate(after[:b], 1) if (x[b - n] >= 0).any()]
            best = np.maximum.reduce(terms)
            f[b] = best + np.log(sum(np.exp(t - best) for t in terms))
        return f, spelt

    def forwards(self, words: list[str]) -> np.ndarray:
        """forward() of each word."""
        stop = np.array([x[-1] for x in self.logs])
        out = np.full((len(words), len(self.logs)), self.table[self.first[""]] + stop)
        for batch, size, *arcs in self._batches(words):
            f, _ = self._recursion(*arcs)
            out[batch] = f[size, np.arange(len(batch))] + stop
        for j, w in enumerate(words):
            if len(w) > self.longest:
                out[j] = self.forward(w)
        return out

    def counts(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Sums of expected() of each word, times its weights (rows of weights, words), as (rows, pieces)."""
        logs = self.table[:, 0]
        out = np.zeros((len(weights), len(logs)))  # the last column gathers what is no piece
        for batch, size, points, start, after in self._batches(words):
            f, spelt = (x[..., 0] for x in self._recursion(points, start, after))
            mine, back = weights[:, batch], np.zeros(f.shape)  # back: the share of all paths that pass a place
            back[size, np.arange(len(batch))] = 1.0
            for b in range(len(points), 0, -1):
                share = lambda a, log, b=b: back[b] * np.exp(np.minimum(0.0, a + log - f[b]))
                firsts = share(0.0, logs[start[b - 1]])
                in_bytes = share(f[b - 1], spelt[b - 1])
                back[b - 1] += in_bytes
                taken = [(start[b - 1], firsts)]
                for n, x in enumerate(after[:b], 1):
                    if (x[b - n] >= 0).any():
                        s = share(f[b - n], logs[x[b - n]])
                        back[b - n] += s
                        taken.append((x[b - n], s))
                at, by = np.concatenate([x for x, _ in taken]), np.concatenate([s for _, s in taken])
                for c, m in enumerate(mine):
                    out[c] += np.bincount(np.where(at < 0, len(logs) - 1, at), by * np.tile(m, len(taken)), len(logs))
                for j in np.flatnonzero(in_bytes):
                    for x in chr(points[b - 1, j]).encode("utf-8", "surrogatepass"):
                        out[:, self.byte[x]] += in_bytes[j] * mine[:, j]
        for j, w in enumerate(words):
            for i, x in self.expected(w) if len(w) > self.longest else ():
                out[:, i] += x * weights[:, j]
        return out[:, :-1]


_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hash(piece: str) -> int:
    """The hash that Lattice._batches builds up code point by code point."""
    h = 0
    for c in piece:
        h = (h * int(_STEP) + ord(c) + 1) % (1 << 64)
    return h


class _Index:
    """Numbers of 64-bit keys, found for many keys at once: places by some bits of the key, taken ones passed over."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        bits = max(10, int(len(keys)).bit_length() + 3)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.numbers, self.turns = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), 0
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            self.turns += 1
            free = left[self.numbers[at[left]] < 0]
            self.keys[at[free]], self.numbers[at[free]] = keys[free], numbers[free]  # of several keys for a place the last stays
            left = left[self.numbers[at[left]] != numbers[left]]
            at[left] = (at[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 where there is none."""
        at = self._place(keys)
        out = np.where(self.keys[at] == keys, self.numbers[at], -1)
        left = np.nonzero((out < 0) & (self.numbers[at] >= 0))
        for _ in range(self.turns):
            if not len(left[0]):
                break
            at[left] = (at[left] + 1) & self.mask
            k, a = keys[left], at[left]
            out[left] = np.where(self.keys[a] == k, self.numbers[a], -1)
            go = (out[left] < 0) & (self.numbers[a] >= 0)
            left = tuple(x[go] for x in left)
        return out


def _key(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class _Keys(dict):
    """Word to the unsigned form of its key; forgets all once it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_counts(rows: DataFrame, k: int) -> DataFrame:
    """(word, t, n, c0, ...): how often each word of `rows` (text, held_out, k) occurs, how often in the texts that are learnt
    from, and how often in those of each class there. Counted batch by batch before anything is shuffled. A text's end is word ''."""
    cs = [f"c{i}" for i in range(k)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        put = lambda: pd.DataFrame([(w, j, c) for j, ws in held.items() for w, c in ws.items()], columns=["word", "k", "c"])
        for f in frames:
            for j, aside, text in zip(f["k"], f["held_out"], f["text"], strict=True):
                c = held.setdefault(-1 if aside else j, Counter())
                c.update(text.encode("utf-8", "surrogatepass").lower().split())
                c[b""] += 1
            if sum(map(len, held.values())) > 400_000:
                yield put()
                held.clear()
        yield put()

    found = rows.select("text", "held_out", "k").mapInPandas(run, "word binary, k int, c long")
    of = lambda x: F.coalesce(F.sum(F.when(x, F.col("c"))), F.lit(0))
    return found.groupBy("word").agg(F.sum("c").alias("t"), of(F.col("k") >= 0).alias("n"), *(of(F.col("k") == i).alias(c) for i, c in enumerate(cs)))


def _piece_counts(words: DataFrame, path: str, logs: np.ndarray, longest: int, k: int) -> np.ndarray:
    """Expected counts of the pieces over all training words, (classes, pieces); the last column counts the words.

    A word weighs the root of its count: the scores are for words that are not seen, which are like the rare ones.
    """
    cs = [f"c{i}" for i in range(k)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, held = Lattice(path, [logs], longest), np.zeros((k, len(logs)))
        for f in frames:
            weights = np.sqrt(f[cs].to_numpy(float)).T
            held += lattice.counts([w.decode("utf-8", "surrogatepass") for w in f["word"]], weights)
            held[:, -1] += weights.sum(axis=1)
        c, i = np.nonzero(held)
        yield pd.DataFrame({"c": c, "piece": i, "e": held[c, i]})

    got = words.filter("octet_length(word) > 0 and n > 0").select("word", *cs).mapInPandas(run, "c int, piece int, e double").groupBy("c", "piece").agg(F.sum("e").alias("e"))
    out = np.zeros((k, len(logs)))
    for r in got.collect():  # one row for each class and piece of the vocabulary at most
        out[r["c"], r["piece"]] = r["e"]
    return out


def estimated(e: np.ndarray, before: np.ndarray, path: str, weight: float = 0.02) -> np.ndarray:
    """Scores from expected counts (last entry: words), the scores before counting as that share of all counts more."""
    p = np.exp(before)
    total = max(e[:-1].sum(), 1e-9)
    p[:-1] /= p[:-1].sum()
    with np.errstate(divide="ignore"):
        new = np.log(e + weight * total * p)
    on = ~_starts(path)
    on[-1] = False
    # stops over stops and pieces that go on
    stop = math.log(min(0.95, max(0.02, (e[-1] + 1) / (e[-1] + e[on].sum() + 2))))
    return normal(np.where(np.isfinite(before), new, -np.inf), path, stop)


def pieces(f: pd.DataFrame, most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """The rows of a frame in turn, in pieces of about `most` characters of text: what is counted of a piece is held at once."""
    before = f["text"].str.len().cumsum().shift(fill_value=0) // most
    for i in before.unique():
        yield f[before == i]


def score(docs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Training: all whole texts that are not held out. Each class of the mixture (a value of `by`, the rarest together as one)
    has, for each word, an arc over the whole word with the share of the class's tokens that the word is, next to all
    segmentations of the word into pieces of the public vocabulary, whose scores are re-estimated on the training words.
    The weight of the segmentations is the share of the class's tokens that were seen once (the chance of a new word). A
    word's probability is the sum over all paths, a text's is the product over its words and its end, summed over the
    classes by their share of the texts: log10 of that is `score`. The class of a scored text is not looked at.

    The common words' scores are broadcast (at most `common` words); the other words of all texts are joined with the table
    of words, which is as large as the corpus makes it. Each distinct word is scored once.

    Null or empty text is one end token. Without training texts counts are 0 and base_score is log10(0.5 / 0.5) a token. A
    null class is a class. A null id is not held out. Repeated rows are scored each. Other columns are ignored.
    """
    path = public_tokenizers.path(s.model)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(s.by).cast("string"), F.lit("")).alias("cls"), held_out(F.col("doc_id"), s).alias("held_out"))
    most = [r["cls"] for r in rows.filter(~F.col("held_out")).groupBy("cls").count().orderBy(F.desc("count"), "cls").limit(s.classes - 1).collect()]
    where = F.array_position(F.array(*map(F.lit, most)), F.col("cls")) if most else F.lit(0)
    k = len(most) + 1
    words = stored(word_counts(rows.select("text", "held_out", F.when(where > 0, (where - 1).cast("int")).otherwise(len(most)).alias("k")), k))
    stats = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count_if(F.col("n") > 0).alias("V"), *(F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"N{i}") for i in range(k)),
        *(F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col(f"c{i}"))), F.lit(0)).alias(f"D{i}") for i in range(k)), *(F.count_if(F.col(f"c{i}") == 1).alias(f"U{i}") for i in range(k)),
    ).first()
    total, distinct = stats["N"], stats["V"]
    alive = [i for i in range(k) if stats[f"N{i}"]] or [0]
    logs = prior(path)
    own = [logs] * len(alive)
    for _ in range(s.rounds if total else 0):
        e = _piece_counts(words, path, logs, s.longest, k)
        logs = estimated(e.sum(axis=0), logs, path)
        own = [estimated(e[i], logs, path) for i in alive]

    fresh = [min(0.5, max(1e-6, (stats[f"U{i}"] + 1) / (stats[f"N{i}"] + 2))) for i in alive]
    size = [max(1, stats[f"N{i}"]) for i in alive]
    texts = max(1, sum(stats[f"D{i}"] for i in alive))
    share = [math.log(max(stats[f"D{i}"], 1e-9) / texts) for i in alive]
    end = [stats[f"D{i}"] / n if stats[f"D{i}"] else 0.5 for i, n in zip(alive, size, strict=True)]
    lp = [f"lp{j}" for j in range(len(alive))]
    octave = F.floor(F.log2("t") * 8)

    def table(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A word's log-probability in each class: from its counts there, and from its segmentations for the share of new words."""
        lattice, new, ends = Lattice(path, own, s.longest), np.array(fresh), np.array(end)
        for f in frames:
            seen = f[[f"c{i}" for i in alive]].to_numpy(float) / size * (1 - new)
            subs = np.log(new * (1 - ends)) + lattice.forwards([w.decode("utf-8", "surrogatepass") for w in f["word"]])
            with np.errstate(divide="ignore"):
                got = np.logaddexp(np.log(seen), subs)
            got[[not w for w in f["word"]]] = np.log(np.maximum(ends, 1e-12))
            yield pd.DataFrame({"key": [_key(w) for w in f["word"]], "n": f["n"], "octave": f["octave"], **{x: got[:, j] for j, x in enumerate(lp)}})

    scored = stored(words.withColumn("octave", octave).mapInPandas(table, "key long, n long, octave long, " + ", ".join(f"{x} double" for x in lp)))
    rarest, room = 0, s.common  # the octave from which on words are common
    for r in words.groupBy(octave.alias("octave")).count().orderBy(F.desc("octave")).collect():  # eight rows for each doubling of the largest count
        room -= r["count"]
        if room < 0:
            rarest = r["octave"] + 1
            break
    head = scored.filter(F.col("octave") >= rarest).drop("octave").toArrow()  # bounded by common
    base = lambda c: F.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    values = np.column_stack([head["n"].to_numpy() > 0, np.log10((head["n"].to_numpy() + 0.5) / (total + 0.5 * (distinct + 1))), *(head[x].to_numpy() for x in lp)])
    shared = docs.sparkSession.sparkContext.broadcast((head["key"].to_numpy().view(np.uint64), values))
    sums = ["base", *lp]

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each text: a row with its own columns and the sums over its common words, and a row for each other word."""
        keys, values = shared.value
        index, words = _Index(keys, np.arange(len(keys), dtype=np.int32)), _Keys()
        for f in (part for frame in frames for part in pieces(frame)):
            counted = [Counter(text.encode("utf-8", "surrogatepass").lower().split()) for text in f["text"]]
            for c in counted:
                c[b""] = 1
            held = np.array([len(c) for c in counted])
            key = np.fromiter((words[w] for c in counted for w in c), np.uint64, held.sum())
            tf = np.fromiter((n for c in counted for n in c.values()), np.int64, held.sum())
            doc = np.repeat(np.arange(len(f)), held)
            at = index.find(key)
            common = at >= 0
            added = [np.bincount(doc[common], tf[common] * values[at[common], j], len(f)) for j in range(values.shape[1])]
            nothing = np.zeros(len(f), np.int64)
            yield pd.DataFrame({"row_id": f["row_id"], "doc_id": f["doc_id"], "held_out": f["held_out"], "n_tokens": np.bincount(doc, tf, len(f)).astype(np.int64), "n_known": added[0].astype(np.int64), "key": nothing, "tf": nothing, **dict(zip(sums, added[1:], strict=True))})
            rare = ~common
            row, zero = f["row_id"].to_numpy()[doc[rare]], np.zeros(rare.sum())
            yield pd.DataFrame({"row_id": row, "doc_id": None, "held_out": None, "n_tokens": zero.astype(np.int64), "n_known": zero.astype(np.int64), "key": key[rare].view(np.int64), "tf": tf[rare], **dict.fromkeys(sums, zero)})

    fields = "row_id long, doc_id string, held_out boolean, n_tokens long, n_known long, key long, tf long, " + ", ".join(f"{x} double" for x in sums)
    both = stored(rows.select("row_id", F.col("doc_id").cast("string").alias("doc_id"), "held_out", "text").mapInPandas(parts, fields))
    heads = both.filter("held_out is not null")
    hit = both.filter("held_out is null").select("row_id", "key", "tf").join(scored, "key")
    rare = hit.select("row_id", F.when(F.col("n") > 0, F.col("tf")).otherwise(0).alias("n_known"), (F.col("tf") * base(F.col("n"))).alias("base"), *((F.col("tf") * F.col(x)).alias(x) for x in lp))
    every = heads.select("row_id", "doc_id", "held_out", "n_tokens", "n_known", *sums).unionByName(rare, allowMissingColumns=True)
    whole = every.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), *(F.sum(x).alias(x) for x in sums))
    paths = [F.col(x) + F.lit(p) for x, p in zip(lp, share, strict=True)]
    best = F.greatest(*paths) if len(paths) > 1 else paths[0]
    summed = best + F.log(sum((F.exp(p - best) for p in paths[1:]), F.exp(paths[0] - best)))
    doc_id = F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return whole.select(doc_id, "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (summed / math.log(10)).alias("score"))
