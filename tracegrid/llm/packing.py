"""Power-of-two packing: documents fall apart into pieces of binary lengths, equal lengths share a bucket, nothing is padded."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.bpe import encoder
from tracegrid.llm.common import stored, through_python, unit, with_position

#: The tokenizer, and its merges as ranks.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
LENGTH = 1024


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


class Ids:
    """Ids of a text by the tokenizer, as little-endian unsigned 32-bit bytes.

    Texts that hold a special string go through the tokenizer itself; for all others its merges are applied by the encoder of
    the same vocabulary's ranks, which remembers the ids of recurring words and gives the same ids.
    """

    def __init__(self, path: str, ranks: str):
        self.path, self.specials, self.plain = path, _specials(path), encoder(ranks)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return np.array(_tokenizer(self.path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.plain(text)


def cuts(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: as many of the longest as fit, then the binary digits of the rest."""
    full = n // longest
    out = [(i * longest, longest) for i in range(full)]
    at = full * longest
    while at < n:
        size = 1 << ((n - at).bit_length() - 1)
        out.append((at, size))
        at += size
    return out


def decompose(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, longest: int = LENGTH, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (packed), doc_tokens. `longest` is a power of two.

    A document is its tokens and the end id, so a null or empty text is one piece of one token. Repeated rows are packed
    each for itself; a null id is kept; other columns are ignored.
    """
    path, table = public_tokenizers.path(tokenizer), public_tokenizers.path(ranks)
    end = np.array([end_id], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Ids(path, table)
        for f in frames:
            rows = []
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                rows += [(doc, a, k, ids[4 * a : 4 * (a + k)], n) for a, k in cuts(n, longest)]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens"])
                    rows = []
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens"])

    return through_python(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id", "start long, length long, ids binary, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, longest: int = LENGTH, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Each piece becomes a sequence of its own, of a power-of-two length, so no sequence crosses documents or is padded.

    Sequences are numbered bucket by bucket (equal lengths together, longest first; within a bucket in a shuffle by hash).
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves if asked for.
    """
    pieces = decompose(docs, tokenizer, ranks, longest, end_id)
    pieces = stored(pieces.withColumn("ids_crc32", F.crc32("ids")).drop(*([] if keep_ids else ["ids"])))
    pieces = pieces.withColumn("__h", F.xxhash64("doc_id", "start", "ids_crc32"))
    n, of = pieces.count(), pieces.groupBy("length").agg(F.count("*").alias("__n"))
    placed = with_position(pieces, ["length"], [unit(F.col("__h")), "__h", "doc_id", "start", "ids_crc32"], unit(F.col("__h")), n, name="__at")
    longer = of.alias("a").join(of.alias("b"), F.col("b.length") > F.col("a.length"), "left")  # at most 11 lengths
    base = longer.groupBy(F.col("a.length").alias("__len")).agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__base"))
    placed = placed.join(F.broadcast(base), F.col("length") == F.col("__len"))
    out = placed.withColumn("sequence_id", F.col("__base") + F.col("__at")).withColumn("offset", F.lit(0).cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
