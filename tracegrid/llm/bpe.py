"""Byte-level BPE: overlapping chunks are pre-tokenised apart, stitched where boundaries agree, and encoded piece by piece."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.llm.common import through_python

RANKS = "byte_bpe_50k.tiktoken"
#: Code points of a chunk, and of what two neighbouring chunks share.
CHUNK, OVERLAP = 16_384, 512
#: Words whose ids a task remembers; beyond that it forgets all and starts anew.
REMEMBER = 200_000


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def vocabulary(path: str) -> list[bytes]:
    e = encoding(path)
    table = [b""] * (e.max_token_value + 1)
    for b in e.token_byte_values():
        table[e.encode_single_token(b)] = b
    return table


@functools.cache
def _splitter():
    import regex

    return regex.compile(public_tokenizers.PATTERN)


@functools.cache
def _adjacent_space():
    import re

    return re.compile(r"\s[\s\x1c-\x1f\x85]|[\x1c-\x1f\x85]\s")


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    A single space between two other characters always begins a pre-token, so a text in which no two white spaces are
    adjacent falls apart at its spaces into words that can be encoded alone, and words recur: their ids are remembered.
    Any other text is encoded as it is.
    """

    def __init__(self, path: str):
        self.e, self.known = encoding(path), {}
        self.starts = np.array([b[:1] == b" " for b in vocabulary(path)])

    def __call__(self, text: str) -> bytes:
        if _adjacent_space().search(text):
            return np.array(self.e.encode_ordinary(text), "<u4").tobytes()
        words = text.split(" ")
        head, known = words[0], self.known
        rest = words[1:]
        new = [w for w in set(rest) if w and w not in known]
        if new:
            if len(known) > REMEMBER:
                known.clear()
                new = [w for w in set(rest) if w]
            ids = np.array(self.e.encode_ordinary(" " + " ".join(new)), "<u4")
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(new):
                data, cuts = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                known.update(zip(new, (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
            else:
                known.update((w, np.array(self.e.encode_ordinary(" " + w), "<u4").tobytes()) for w in new)
        if "" in rest and "" not in known:  # a space at the end of the text
            known[""] = np.array(self.e.encode_ordinary(" "), "<u4").tobytes()
        return np.array(self.e.encode_ordinary(head), "<u4").tobytes() + b"".join(map(known.__getitem__, rest))


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each process, so that a worker's next task finds its words known."""
    return Encoder(path)


def decode(ids: bytes, path: str) -> bytes:
    """The bytes of the tokens, one after the other."""
    return b"".join(map(vocabulary(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def boundaries(text: str) -> list[int]:
    """Where pre-tokens end."""
    return [m.end() for m in _splitter().finditer(text)]


def _chunks(frames: Iterator[pd.DataFrame], chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    """A row for each chunk: its code points and, beyond its end, those that it shares with the next."""
    for frame in frames:
        rows = []
        for row, text in zip(frame["row_id"], frame["text"], strict=True):
            n = max(1, -(-len(text) // chunk))
            rows += [(row, k, n, text[k * chunk : (k + 1) * chunk + overlap]) for k in range(n)]
            if len(rows) >= 200:
                yield pd.DataFrame(rows, columns=["row_id", "k", "of", "text"])
                rows = []
        yield pd.DataFrame(rows, columns=["row_id", "k", "of", "text"])


def _marks(frames: Iterator[pd.DataFrame], chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    """Pre-tokenise each chunk by itself. head: boundaries in what it shares with the chunk before; tail: with the next.

    The last matches of a chunk depend on what follows it, unless it is the text's end: a boundary counts only if a match
    and one more code point follow it.
    """
    for frame in frames:
        head, tail = [], []
        for k, of, text in zip(frame["k"], frame["of"], frame["text"], strict=True):
            ends = boundaries(text)
            sure = ends if k == of - 1 else ends[:-2]
            head.append([e for e in ends[:-1] if e <= overlap] if k else [])
            tail.append([e - chunk for e in sure if e > chunk] if k < of - 1 else [])
        yield frame.assign(head=head, tail=tail)


def _pieces(frames: Iterator[pd.DataFrame], chunk: int, path: str) -> Iterator[pd.DataFrame]:
    """Encode what lies between two stitches; a piece starts and ends at boundaries of the whole text.

    The text of a piece ends in other than white space or is encoded pre-token by pre-token, as the last white space of a
    piece would otherwise be matched differently from how it is in the whole text.
    """
    encode = encoder(path)
    for frame in frames:
        ids = []
        for text, k, of, at, to in zip(frame["text"], frame["k"], frame["of"], frame["start"], frame["stop"], strict=True):
            if at is None or at != at:
                ids.append(None)
                continue
            piece = text[int(at) : int(to)] if k < of - 1 else text[int(at) :]
            if k < of - 1 and piece[-1:].isspace():
                cuts = [b for b in boundaries(text[int(at) :]) if b <= len(piece)]
                ids.append(b"".join(encode(piece[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)))
            else:
                ids.append(encode(piece))
        yield pd.DataFrame({"row_id": frame["row_id"], "k": frame["k"], "of": frame["of"], "text": frame["text"], "ids": ids})


def _whole(frames: Iterator[pd.DataFrame], chunk: int, path: str) -> Iterator[pd.DataFrame]:
    """Texts with a stretch in which two chunks agree on no boundary (one pre-token longer than what they share): as one piece."""
    encode = encoder(path)
    for frame in frames:
        yield pd.DataFrame({"row_id": frame["row_id"], "ids": [encode("".join(t[:chunk] for t in list(x)[:-1]) + x[-1]) for x in frame["texts"]]})


def encode_documents(docs: DataFrame, ranks: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row_id, doc_id, ids): the ids of every whole text as tiktoken gives them without special tokens, packed as bytes.

    Texts of one chunk are encoded where they are read. Longer ones are cut into chunks that overlap; the chunks are dealt
    out over the cluster and pre-tokenised apart; neighbours are stitched at the first boundary on which they agree within
    what they share (from a common boundary on all later ones are common, as the pattern never looks back); the pieces
    between stitches are encoded and joined. Where no boundary agrees the text is encoded as one piece.

    Null or empty text has no ids. A null id is kept. Repeated rows stay separate. Other columns are ignored.
    """
    path = public_tokenizers.path(ranks)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def direct(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for f in frames:
            for a in range(0, len(f), 1000):  # ids take more room than their text
                g = f.iloc[a : a + 1000]
                yield pd.DataFrame({"row_id": g["row_id"], "doc_id": g["doc_id"], "ids": [encode(t) for t in g["text"]]})

    short = through_python(rows.filter(F.length("text") <= chunk), direct, "doc_id", "row_id long, ids binary")
    long = rows.filter(F.length("text") > chunk)
    cut = long.select("row_id", "text").mapInPandas(lambda f: _chunks(f, chunk, overlap), "row_id long, k int, of int, text string")
    marks = cut.repartition("row_id", "k").mapInPandas(lambda f: _marks(f, chunk, overlap), "row_id long, k int, of int, text string, head array<int>, tail array<int>")
    by = Window.partitionBy("row_id").orderBy("k")
    meet = F.array_min(F.array_intersect("head", F.lag("tail").over(by)))
    stitched = marks.withColumn("start", F.when(F.col("k") == 0, 0).otherwise(meet)).withColumn("stop", F.lead("start").over(by) + chunk)
    broken = F.max((F.col("start").isNull()).cast("int")).over(Window.partitionBy("row_id")) == 1
    stitched = stitched.withColumn("start", F.when(~broken, F.col("start"))).drop("head", "tail")
    pieces = stitched.mapInPandas(lambda f: _pieces(f, chunk, path), "row_id long, k int, of int, text string, ids binary")
    parts = pieces.groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("p"),
        F.max(F.col("ids").isNull()).alias("broken"),
        F.sort_array(F.collect_list(F.when(F.col("ids").isNull(), F.struct("k", "text")))).alias("t"),
    )
    good = parts.filter("not broken").select("row_id", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
    whole = parts.filter("broken").select("row_id", F.col("t.text").alias("texts")).mapInPandas(lambda f: _whole(f, chunk, path), "row_id long, ids binary")
    named = good.unionByName(whole).join(long.select("row_id", "doc_id"), "row_id")
    return short.select("row_id", "doc_id", "ids").unionByName(named.select("row_id", "doc_id", "ids"))


def decode_documents(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Adds `data`: the raw bytes that the ids stand for."""
    path = public_tokenizers.path(ranks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(data=[decode(x, path) for x in f["ids"]])

    return through_python(encoded, run, "doc_id", "row_id long, ids binary, data binary")


def digests(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens and the checksums of the ids and of the bytes decoded from them."""
    path = public_tokenizers.path(ranks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hexed = lambda b: hashlib.sha256(b).hexdigest()
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_tokens": [len(x) // 4 for x in f["ids"]], "ids_sha256": [hexed(x) for x in f["ids"]], "decoded_sha256": [hexed(decode(x, path)) for x in f["ids"]]})

    return through_python(encoded, run, "doc_id", "n_tokens long, ids_sha256 string, decoded_sha256 string")
