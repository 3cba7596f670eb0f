"""SimHash fingerprints: weighted term hashes vote on signed bits; permuted block tables find all within a Hamming radius."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.llm.common import stored

BITS = 64
#: Longest piece of a word that counts as a term.
TERM = 12
#: Hamming radius of the search, and blocks that the bits are cut into: a table for each choice of BLOCKS - RADIUS blocks.
RADIUS, BLOCKS = 3, 6
_LOW = 0x0000000100000001


def _terms(text: Column) -> tuple[Column, Column]:
    """The pieces of a text's words, and from a column `pieces` of them the terms: hashes of pairs of neighbouring pieces of words; of the piece, if there is but one. Each with its length as weight.

    A word is cut into pieces of TERM code points, so a text of one long word has terms as well.
    """
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"([^\x20\x09-\x0D]{1,%d})" % TERM), 1)
    pair = lambda i: F.struct(F.xxhash64(F.get("pieces", i), F.get("pieces", i + 1)).alias("h"), (F.length(F.get("pieces", i)) + F.coalesce(F.length(F.get("pieces", i + 1)), F.lit(0))).alias("w"))
    return pieces, F.when(F.size("pieces") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size("pieces") - 2, F.lit(0))), pair))


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and `fingerprint` (64 bits) of the texts; `keys` identify a row. Null or empty text, or white space: 0.

    Each term adds its weight, its length in code points, to the bits that its hash sets; a bit of the fingerprint is set
    if it got more than half of all weight. Two of the 64 sums of a row share a long (31 bits each; a text, of 2^31 bytes at
    most, weighs less), and a row's terms are summed up where the row is read: only 33 longs a row are shuffled.
    """
    pieces, terms = _terms(F.col(text))
    t = rows.select(*keys, pieces.alias("pieces")).select(*keys, F.explode_outer(terms).alias("t")).select(*keys, F.col("t.h").alias("h"), F.col("t.w").cast("long").alias("w"))
    half = lambda i: F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LOW)) * F.col("w")
    sums = t.groupBy(*keys).agg(*(F.sum(half(i)).alias(f"v{i}") for i in range(32)), F.sum("w").alias("all"))
    bit = lambda v, i: F.when(2 * v > F.col("all"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0))
    value = F.lit(0).cast("long")
    for i in range(32):
        value = value.bitwiseOR(bit(F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), i)).bitwiseOR(bit(F.shiftrightunsigned(f"v{i}", 32), i + 32))
    return sums.select(*keys, value.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def _blocks() -> list[int]:
    cut = [i * BITS // BLOCKS for i in range(BLOCKS + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:], strict=False)]
    out = [sum(c) for c in combinations(masks, BLOCKS - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def tables(prints: DataFrame, *carry: str) -> DataFrame:
    """A row for each table: its number, the chosen blocks (the others zero), the fingerprint."""
    keys = F.array(*(F.struct(F.lit(i).alias("no"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(_blocks())))
    return prints.select("fingerprint", *carry, F.explode(keys).alias("k")).select("k.no", "k.block", "fingerprint", *carry)


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, match, n, distance): for each fingerprint of `queries`, all of `prints` within the radius, and how
    many rows have it. Two prints at most RADIUS bits apart agree in BLOCKS - RADIUS blocks at least, so no match is lost.

    Both sides are reduced to distinct fingerprints first; a copy costs nothing more.
    """
    assert radius <= RADIUS
    q = tables(queries.select("fingerprint").distinct()).alias("q")
    p = tables(prints.groupBy("fingerprint").agg(F.count("*").alias("n")), "n").alias("p")
    far = F.bit_count(F.col("q.fingerprint").bitwiseXOR(F.col("p.fingerprint")))
    found = q.join(p, (F.col("q.no") == F.col("p.no")) & (F.col("q.block") == F.col("p.block")) & (far <= radius))
    return found.select(F.col("q.fingerprint").alias("fingerprint"), F.col("p.fingerprint").alias("match"), "n", far.alias("distance")).distinct()


def _next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) over distinct ids in ascending order, the last followed by the first.

    The ids are dealt out by range, and numbered by range; only the ends of the ranges meet in one place.
    """
    r = stored(ids.select("doc_id").distinct().repartitionByRange(F.col("doc_id").asc_nulls_first()).withColumn("range", F.spark_partition_id()))
    w = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first())
    inside = r.select("doc_id", "range", F.lead("doc_id").over(w).alias("inner"), F.lead(F.lit(1)).over(w).alias("has"))
    ends = r.groupBy("range").agg(F.min_by(F.struct("doc_id"), F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("least"))
    every = Window.orderBy("range")
    ends = ends.select(F.col("range").alias("r"), F.coalesce(F.lead("least").over(every), F.first("least").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then"))
    joined = inside.join(F.broadcast(ends), F.col("range") == F.col("r"))  # a row for each range
    return joined.select("doc_id", F.when(F.col("has") == 1, F.col("inner")).otherwise(F.col("then.doc_id")).alias("next_id"))


def edited(docs: DataFrame) -> DataFrame:
    """k, z (the id, 0 for null; whether it is null), row_id, doc_id, next_id, n_chars, text, edited: the last quarter of the code points replaced by the first of the next
    document. Rows that share a doc_id have the same next document, of which the least text counts."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("z"), F.coalesce("text", F.lit("")).alias("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    n = rows.groupBy("doc_id").agg(F.max(quarter).alias("need"))
    need = _next_ids(docs).join(n.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")))
    need = stored(need.select(F.coalesce("doc_id", F.lit(0)).alias("of_k"), F.col("doc_id").isNull().alias("of_z"), "next_id", F.coalesce("next_id", F.lit(0)).alias("nk"), F.col("next_id").isNull().alias("nz"), "need"))
    # The texts are dealt by their ids once for both joins: the first asks for the same columns as the second (row_id and doc_id
    # settle ties between equal heads), so that Spark uses one exchange for both. Only the heads are dealt out besides.
    head = F.struct(F.expr("substring(text, 1, need)").alias("head"), "row_id", "doc_id")
    heads = rows.join(need, (F.col("k") == F.col("nk")) & (F.col("z") == F.col("nz"))).select("of_k", "of_z", "next_id", head.alias("h"))
    heads = heads.groupBy("of_k", "of_z").agg(F.min("h").alias("h"), F.first("next_id").alias("next_id"))
    out = rows.join(heads, (F.col("k") == F.col("of_k")) & (F.col("z") == F.col("of_z"))).withColumn("n_chars", F.length("text").cast("long"))
    keep = (F.col("n_chars") - quarter).cast("int")
    text = F.concat(F.substring("text", F.lit(1), keep), F.substring("h.head", F.lit(1), quarter))
    return out.select("k", "z", "row_id", "doc_id", "next_id", "n_chars", "text", text.alias("edited"))


def compared(docs: DataFrame, every: int = 100) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and n_near: for rows whose
    id is divisible by `every`, how many rows (itself included) have a fingerprint within RADIUS bits, else null.

    Null text counts as empty, whose fingerprint is 0; a null id is the least. A document that is the only one is its own
    next. Repeated rows are returned each. Other columns are ignored; an empty table gives none.
    """
    both = edited(docs)
    # k and z, the id without null, stay among the keys: rows lie together by them after the join, so nothing is dealt anew
    keys = ["k", "z", "row_id", "doc_id", "next_id", "n_chars", "edited_sha256"]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"))))
    flat = both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(*keys, sides.alias("x")).select(*keys, "x.kind", "x.text")
    voted = fingerprints(flat, [*keys, "kind"], "text")
    own = voted.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("efp"))
    own = stored(own)
    following = own.groupBy(F.col("doc_id").alias("id")).agg(F.min("fp").alias("nfp"))
    asked = own.filter(F.col("doc_id") % every == 0).select(F.col("fp").alias("fingerprint"))
    near = within_radius(asked, own.select(F.col("fp").alias("fingerprint"))).groupBy(F.col("fingerprint").alias("q")).agg(F.sum("n").alias("n_near"))
    out = own.join(following, F.col("next_id").eqNullSafe(F.col("id"))).join(near, F.col("fp") == F.col("q"), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.lpad(F.lower(F.hex("efp")), 16, "0").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"), F.when(F.col("doc_id") % every == 0, F.col("n_near")).alias("n_near"),
    )
