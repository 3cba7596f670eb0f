"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists, and the forms that they vary."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import discard, stored

#: Words of a list, beyond which its window of edits is split; lists of one place have one word for each letter at most.
LIST = 512
#: One time in so many a letter is left out.
MODULUS = 97
_SEPARATE = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 192 else 32 for i in range(256))


def runs(text: str) -> list[bytes]:
    """Runs of the letters A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case, a byte each."""
    return text.encode("latin-1", "replace").translate(_SEPARATE).split()


def _noisy(counted: Counter, doc_id: str) -> Iterator[tuple[bytes, int]]:
    """The words of a document: of some, chosen by a checksum of id and word, a letter is left out."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for w, n in counted.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % MODULUS == 0:
            k = h % len(w)
            w = w[:k] + w[k + 1 :]
        yield w, n


def vocabulary(docs: DataFrame, letters: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words of at least so many letters that occur at least so often in the texts of docs (doc_id, text), counted
    over each task before anything is shuffled. A null id counts as an empty one."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        put = lambda: pd.DataFrame({"word": pd.Series([w.decode("latin-1") for w in held], dtype=object), "n": pd.Series(held.values(), dtype="int64")})
        for f in frames:
            for doc_id, text in zip(f["doc_id"], f["text"], strict=True):
                for w, n in _noisy(Counter(runs(text)), doc_id):
                    if len(w) >= letters:
                        held[w] += n
                if len(held) > 300_000:
                    yield put()
                    held.clear()
        yield put()

    rows = docs.filter("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds to rows (word, n, long, a, b) the key of their list: words that can be pairs of which the longer has `long` letters and
    in which the edit is at its places a to b share what stands before and behind these."""
    behind = F.col("long") - F.col("b")
    tail = F.col("word").substr(F.length("word") - behind + 1, behind)
    return rows.withColumn("key", F.xxhash64("long", "a", "b", F.col("word").substr(F.lit(1), F.col("a")), tail))


def lists(words: DataFrame, size: int = LIST) -> DataFrame:
    """(key, word, n, long, a, b): each word in the lists in which it can have near words.

    Two words one edit apart agree before or behind the middle of the longer: each word is in a list of those with the same
    beginning, and one of those with the same end, for itself as the longer and as the shorter. Lists of more than `size` words
    are split into two by halving the window of places of the edit, until they are small or the window is one place.
    """
    n, middle = F.length("word"), F.floor(F.col("long") / 2).cast("int")
    longs = words.select("word", "n", F.explode(F.array(n, n + 1)).alias("long"))
    window = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    rows = longs.select("word", "n", "long", F.explode(F.array(window(F.lit(0), middle), window(middle, F.col("long")))).alias("w"))
    rows, done = stored(_keyed(rows.select("word", "n", "long", "w.a", "w.b"))), []
    while True:
        large = rows.filter("b - a > 1").groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > size).select("key")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows])
        large = stored(large)
        split = rows.join(large, "key", "left_semi").filter("b - a > 1")
        done.append(rows.join(large, "key", "left_anti").unionByName(rows.join(large, "key", "left_semi").filter("b - a <= 1")))
        middle = F.floor((F.col("a") + F.col("b")) / 2)
        half = F.explode(F.array(window(F.col("a"), middle), window(middle, F.col("b")))).alias("w")
        rows = stored(_keyed(split.select("word", "n", "long", half).select("word", "n", "long", "w.a", "w.b")))


def _common(chars: np.ndarray, at: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Length of the common beginning of two strings for each of many pairs (places and sizes in chars)."""
    out, least = np.zeros(len(at), np.int64), np.minimum(size, other_size)
    live = np.flatnonzero(least > 0)
    while len(live):
        live = live[chars[at[live] + out[live]] == chars[other[live] + out[live]]]
        out[live] += 1
        live = live[out[live] < least[live]]
    return out


def near(chars: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, found): rows of sorted lists that are exactly one edit apart, where the query has the list's width.

    chars[at:at + size] is the part of a word inside its list's window, width what the longer of a pair has there; rows stand
    in the order of (group, part). lcp is the length that a part shares with the one before in its list. For each query one row
    of three cells of the edit matrix belongs to a range of parts that share a beginning (whose inner lcps reach its length),
    so that it is worked out once for all of them; a letter further on the range falls apart where the lcp ends. A range whose
    row has no cell of at most one edit is skipped with all its words.
    """
    n = len(at)
    before = np.maximum(np.arange(n) - 1, 0)
    first = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
    lcp = np.where(first, -1, _common(chars, at, size, at[before], size[before]))
    begin = np.flatnonzero(first)
    end = np.r_[begin[1:], n] if n else begin
    mine = np.searchsorted(begin, np.arange(n), "right") - 1
    # queries of lists of several words
    q = np.flatnonzero((end[mine] - begin[mine] > 1) & (size == width))
    low, high = begin[mine[q]], end[mine[q]]
    cells = np.tile(np.array([[2, 0, 1]], np.int8), (len(q), 1))
    cells[width[q] < 1, 2] = 2
    found, depth = [], 0
    while len(q):
        over = size[low] == depth  # the first word of the range ends here
        last = np.where(width[q] == depth, cells[:, 1], np.where(width[q] == depth + 1, cells[:, 2], 2))
        hit = over & (last == 1)
        found.append((q[hit], low[hit]))
        low = low + over
        # ranges one letter longer: they start where the lcp ends
        starts = np.flatnonzero((lcp <= depth) & (size > depth))
        edges = np.flatnonzero(lcp <= depth)
        a, b = np.searchsorted(starts, low), np.searchsorted(starts, high)
        k = b - a
        pair = np.repeat(np.arange(len(q)), k)
        node = starts[np.arange(len(pair)) - np.repeat(np.cumsum(k) - k, k) + a[pair]]
        stop = np.r_[edges, n][np.searchsorted(edges, node, "right")]
        own, c = q[pair], chars[at[node] + depth]
        letter = lambda j: np.where((j >= 0) & (j < width[own]), chars[np.minimum(at[own] + np.maximum(j, 0), len(chars) - 1)], 0)
        old = cells[pair]
        x = old[:, 0] + (letter(np.full(len(own), depth - 1)) != c)
        x = np.minimum(x, old[:, 1] + 1)
        y = np.minimum(np.minimum(old[:, 1] + (letter(np.full(len(own), depth)) != c), old[:, 2] + 1), x + 1)
        z = np.minimum(old[:, 2] + (letter(np.full(len(own), depth + 1)) != c), y + 1)
        y, z = np.where(depth + 1 > width[own], 2, y), np.where(depth + 2 > width[own], 2, z)
        new = np.minimum(np.column_stack([x, y, z]), 2).astype(np.int8)
        alone = (stop - node == 1) & (node == own)  # the query by itself
        keep = (new.min(axis=1) <= 1) & ~alone
        q, low, high, cells, depth = own[keep], node[keep], stop[keep], new[keep], depth + 1
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _near_rows(f: pd.DataFrame) -> pd.DataFrame:
    """(word, near, near_n), each pair once in each direction, of whole sorted lists."""
    words = f["word"].tolist()
    size = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer(b"".join(words), np.uint8)
    at = np.cumsum(size) - size
    long, a, b, n = (f[c].to_numpy(np.int64) for c in ("long", "a", "b", "n"))
    other = np.any([np.diff(x, prepend=x[:1]) != 0 for x in (f["key"].to_numpy(), long, a, b)], axis=0)
    q, w = near(chars, at + a, size - a - (long - b), np.cumsum(other), b - a)
    # a pair counts in the one list whose window holds the end of its common beginning; keys of different words may be equal
    same = _common(chars, at[q], size[q], at[w], size[w])
    fine = (same >= a[q]) & (same < b[q])
    q, w, same = q[fine], w[fine], same[fine]
    fine = np.array([words[i][k + 1 :] == words[j][k + (len(words[i]) == len(words[j])) :] for i, j, k in zip(q.tolist(), w.tolist(), same.tolist(), strict=True)], bool)
    q, w = q[fine], w[fine]
    back = size[w] < size[q]
    one, two = np.r_[q, w[back]], np.r_[w, q[back]]
    text = [x.decode("latin-1") for x in words]
    return pd.DataFrame({"word": np.array([*text, None], object)[one], "near": np.array([*text, None], object)[two], "near_n": n[two]})


def _scan(frames: Iterator[pd.DataFrame], rows: int = 4000) -> Iterator[pd.DataFrame]:
    """Gathers sorted rows until so many whole lists are there; the last list of a frame waits for the next one."""
    held: list[pd.DataFrame] = []
    for f in frames:
        for a in range(0, len(f), rows):
            g = f.iloc[a : a + rows]
            ends = np.flatnonzero(np.diff(g["key"].to_numpy()))
            if held and held[-1]["key"].iloc[-1] != g["key"].iloc[0]:
                yield _near_rows(pd.concat(held, ignore_index=True))
                held = []
            elif not len(ends):
                held.append(g)
                continue
            if len(ends):
                yield _near_rows(pd.concat([*held, g.iloc[: ends[-1] + 1]], ignore_index=True))
                held = [g.iloc[ends[-1] + 1 :]]
            else:
                held = [g]
    if held:
        yield _near_rows(pd.concat(held, ignore_index=True))


def near_words(words: DataFrame, size: int = LIST) -> DataFrame:
    """(word, near, near_n) for all pairs of words (word, n) that differ by exactly one inserted, deleted or replaced letter."""
    part = F.col("word").substr(F.col("a") + 1, F.length("word") - F.col("a") - (F.col("long") - F.col("b")))
    rows = lists(words, size).select("key", F.encode("word", "ISO-8859-1").alias("word"), F.encode(part, "ISO-8859-1").alias("part"), "n", "long", "a", "b")
    ordered = rows.repartition("key").sortWithinPartitions("key", "long", "a", "b", "part")
    return ordered.mapInPandas(_scan, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of forms (word, form): from the words without a form down to those that vary them, level by level.
    A form has at least twice the count of its word, so there are no more levels than doublings in the largest count. Each word
    is joined once, with its form, and a form has no more words than it has near ones."""
    level = stored(forms.filter("form is null").select("word", F.col("word").alias("root")))
    rest, done = stored(forms.filter("form is not null")), [level]
    while not rest.isEmpty():
        up = level.select(F.col("word").alias("form"), "root")
        level = stored(rest.join(up, "form").select("word", "root"))
        left = stored(rest.join(level.select("word"), "word", "left_anti"))
        discard(rest)
        rest, done = left, [*done, level]
    return reduce(DataFrame.unionByName, done)


def variants(docs: DataFrame, letters: int = 5, least: int = 3, size: int = LIST) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of docs (doc_id, text).

    Near words are found in sorted lists, each of which fits a task (lists()), by scanning them with rows of the edit matrix that
    words share by their common beginnings (near()). A word's form is its near word of largest n (ties: the smallest), if that
    is at least twice the word's; its root is what following the forms leads to, the word itself where it has none.

    Null and empty texts have no words; words are of any length. Repeated rows count each. No words: an empty result. Other
    columns are ignored.
    """
    words = stored(vocabulary(docs, letters, least))
    pairs = near_words(words, size)
    every = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")).unionByName(pairs.select("word", F.lit(None).cast("long").alias("n"), "near", "near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))))
    g = every.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    held = -F.col("best.m") >= 2 * F.col("n")
    forms = stored(g.select("word", F.when(held, F.col("best.w")).alias("form"), "n", "n_near", F.when(held, -F.col("best.m")).alias("form_n")))
    return forms.join(_roots(forms.select("word", "form")), "word").select("word", "form", "root", "n", "n_near", "form_n")
