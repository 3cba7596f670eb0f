"""A manifest of a table: hashes of its rows, a tree over them for each stratum, a tree over the strata, and proofs by climbing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrid.llm.common import ascii_lower, discard, stored

#: Children of a node.
FANOUT = 8
#: Leaves of a block. A node is kept once for each block below it, so that no more leaves than these climb through one row.
BLOCK = FANOUT**3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of a hash. Hashes are kept as bytes and are text only where they are hashed or returned.
_SIZE = 32


def field(c: Column) -> Column:
    """A value in a form from which it can be told apart: `-`, or its length in bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def text(hashes: Column) -> Column:
    """Hashes, one after the other, as lower-case hex digits."""
    return F.lower(F.hex(hashes))


def parent(hashes: Column) -> Column:
    return F.unhex(F.sha2(text(hashes), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, and `tampered`: the leaf of the row with its text's A-Z lower-cased, for the third of the ids that is
    tampered with (null elsewhere; a null id is left alone)."""
    own = [F.col(c) for c in COLUMNS]
    changed = [ascii_lower(c) if n == "text" else c for n, c in zip(COLUMNS, own, strict=True)]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf(own).alias("leaf"), F.when(hit, leaf(changed)).alias("tampered"))


def placed(leaves: DataFrame) -> DataFrame:
    """Adds to stored leaves: tree (rank of the lang, null first), trees, pos (in the tree, by doc_id), n (leaves of
    the tree), block.

    Leaves are dealt out in ranges of (lang, doc_id, leaf) and sorted there; a leaf's position is that in its range on top of
    the counts of the ranges before. One row for each range and lang, and one for each lang, is all that meets in one place.
    """
    order = ["lang", "doc_id", "leaf"]
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranged.select(*leaves.columns, F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part")))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("lang", "part").agg(F.count("*").alias("k"), F.min("row").alias("first")).withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
    langs = rows.groupBy("lang").agg(F.count("*").alias("n"))
    ranked = Window.orderBy(F.col("lang").asc_nulls_first())
    blocks = F.ceil(F.col("n") / BLOCK)
    langs = langs.select(F.col("lang").alias("l"), "n", (F.row_number().over(ranked) - 1).cast("long").alias("tree"), (F.sum(blocks).over(ranked) - blocks).alias("base"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("trees"))
    known = parts.join(langs, F.col("lang").eqNullSafe(F.col("l"))).select("l", F.col("part").alias("p"), "first", "before", "n", "tree", "base", "trees")
    pos = F.col("before") + F.col("row") - F.col("first")
    j = rows.join(known, F.col("lang").eqNullSafe(F.col("l")) & (F.col("part") == F.col("p")))
    out = stored(j.select(*leaves.columns, "tree", "trees", pos.alias("pos"), "n", (F.col("base") + F.floor(pos / BLOCK)).alias("block")))
    discard(rows)
    return out


def _linked(nodes: DataFrame, level: int, top: bool) -> DataFrame:
    """Adds to nodes (tree, trees, pos, n, hash) of one level: id, up (the parent's id, null for the root), place among its
    children, and its hash as subroot or root where it is one."""
    at = lambda tree, k, pos: F.concat_ws("/", tree, F.lit(str(k)), pos.cast("string"))
    tree = F.lit("top") if top else F.col("tree").cast("string")
    step = lambda c: F.floor(c / FANOUT)
    up = F.when(F.col("n") > 1, at(tree, level + 1, step(F.col("pos"))))
    place = F.when(F.col("n") > 1, F.col("pos") % FANOUT)
    if not top:
        joined = (F.col("n") == 1) & (F.col("trees") > 1)
        up, place = up.when(joined, at(F.lit("top"), 1, step(F.col("tree")))), place.when(joined, F.col("tree") % FANOUT)
    subroot = F.lit(None).cast("binary") if top else F.when(F.col("n") == 1, F.col("hash"))
    return nodes.withColumns({"id": at(tree, level, F.col("pos")), "up": up, "place": place.cast("int"), "subroot": subroot, "root": F.when(up.isNull(), F.col("hash"))})


def _level(kids: DataFrame, *more: str) -> DataFrame:
    """The parents of nodes (tree, trees, pos, hash, n, low, high) of which there are several in their tree; kids: the children's
    pos, hash and more columns, in order; run: their hashes, one after the other; low and high: the blocks below."""
    g = kids.filter("n > 1").groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("at")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "hash", *more))).alias("kids"), F.first("n").alias("m"), F.first("trees").alias("trees"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    g = g.withColumn("run", F.aggregate("kids", F.lit(b""), lambda a, k: F.concat(a, k["hash"])))
    return g.select("tree", "trees", F.col("at").alias("pos"), parent(F.col("run")).alias("hash"), F.ceil(F.col("m") / FANOUT).alias("n"), "low", "high", "run", "kids")


_NODE = ["id", "up", "place", "run", "subroot", "root", "low", "high"]
_LINK = ["tree", "trees", "pos", "hash", "n", "low", "high"]


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The levels as stored rows linked to their parents (id, up, place, run, subroot, root, low, high): runs of leaves (and the
    lone leaf of a stratum) with their `kids`, the further levels of the strata's trees, and those of the tree over their roots.
    As many as the logarithm of the leaves."""
    own = leaves.select("tree", "trees", "pos", F.col("leaf").alias("hash"), "n", F.col("block").alias("low"), F.col("block").alias("high"), "doc_id", "tampered")
    alone = own.filter("n = 1").select(*_LINK, F.col("hash").alias("run"), F.array(F.struct("pos", "hash", "doc_id", "tampered")).alias("kids"))
    first = stored(_linked(_level(own, "doc_id", "tampered"), 1, False).unionByName(_linked(alone, 0, False)))
    roots, built = [first.filter("n = 1").select(*_LINK)], [first]
    kids = first.filter("n > 1").select(*_LINK)
    size = leaves.agg(F.max("n").alias("n"), F.max("trees").alias("trees")).first()
    for top, level, most in ((False, 1, -(-(size["n"] or 0) // FANOUT)), (True, 0, size["trees"] or 0)):
        if top:
            every = reduce(DataFrame.unionByName, roots)
            kids = every.select(F.lit(-1).cast("long").alias("tree"), "trees", F.col("tree").alias("pos"), "hash", F.col("trees").alias("n"), "low", "high")
        while most > 1:
            level, most = level + 1, -(-most // FANOUT)
            kids = stored(_linked(_level(kids).drop("kids"), level, top))
            built.append(kids.select(*_NODE))
            kids = kids.select(*_LINK)
            roots.append(kids.filter("n = 1"))
    return built


@contextmanager
def _whole(spark: SparkSession) -> Iterator[None]:
    """Recursive queries stop at a million rows unless told otherwise."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Siblings to the left and to the right of a run's child, in SQL.
_LEFT, _RIGHT = f"substr(n.run, 1, {_SIZE} * c.place)", f"substr(n.run, {_SIZE} * c.place + {_SIZE + 1})"
CLIMB = f"""
WITH RECURSIVE climb(id, block, up, place, folded, level, siblings, subroot, root) AS (
  SELECT id, block, up, place, folded, 0, X'', subroot, root FROM {{start}}
  UNION ALL
  SELECT c.id, c.block, n.up, n.place, transform(c.folded, h -> unhex(sha2(lower(hex(concat({_LEFT}, h, {_RIGHT}))), 256))),
    c.level + 1, concat({_LEFT}, {_RIGHT}), n.subroot, n.root
  FROM climb c JOIN {{nodes}} n ON n.block = c.block AND n.id = c.up)
SELECT id, level, siblings, subroot, root, CASE WHEN root IS NOT NULL THEN folded END AS folded FROM climb
"""


def _around(run: Column, i: Column) -> tuple[Column, Column]:
    return F.substring(run, 1, i * _SIZE), F.substring(run, i * _SIZE + _SIZE + 1, F.octet_length(run))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs (doc_id, source, lang, n_chars, text).

    Leaves ascend by doc_id in the tree of their lang; eight nodes make one of the next level, and the trees' roots, by lang,
    make the root. The levels are stored, each node with its parent's id. A recursive query takes every leaf up: in each step
    it meets its parent's row, appends the siblings found there and folds its own hash (the tampered one, if any) with them.
    The leaves of a run go up side by side, each with its own hash, as they share all siblings but each other. A node above
    many leaves has a row for each block of them, so that no key is hot in this join.

    A null id comes first, a null lang has a tree of its own that comes first. Rows of one id are ordered by their leaf; equal
    rows have equal values but for their places. Null and empty texts differ. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    hashed = stored(digests(docs))
    leaves = placed(hashed)
    discard(hashed)
    first, *built = levels(leaves)
    own = lambda k: F.coalesce(k["tampered"], k["hash"])

    def fold(k: Column, i: Column) -> Column:
        left, right = _around(F.col("run"), i)
        return parent(F.concat(left, own(k), right))

    alone = F.col("id").contains("/0/")  # the lone leaf of a tree
    folded = F.when(alone, F.transform("kids", own)).otherwise(F.transform("kids", fold))
    start = first.select("id", F.col("low").alias("block"), "up", "place", folded.alias("folded"), "subroot", "root")
    nodes = reduce(DataFrame.unionByName, built) if built else first.select(*_NODE).limit(0)
    nodes = nodes.withColumn("block", F.explode(F.sequence("low", "high"))).drop("low", "high")
    with _whole(spark):
        climbed = spark.sql(CLIMB, start=start, nodes=nodes)
        every = climbed.unionByName(first.select("id", "run", "kids"), allowMissingColumns=True)
        steps = F.sort_array(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "siblings"))))
        some = lambda c: F.first(c, ignorenulls=True).alias(c)
        g = every.groupBy("id").agg(steps.alias("steps"), *(some(c) for c in ("subroot", "root", "folded", "run", "kids")))
        g = g.withColumn("above", F.aggregate("steps", F.lit(b""), lambda a, s: F.concat(a, s["siblings"])))
        leaf = g.select("subroot", "root", "run", "above", "folded", F.posexplode("kids").alias("i", "k"))
        proof = F.concat(*_around(F.col("run"), F.col("i")), F.col("above"))
        out = leaf.select("k.doc_id", F.col("k.hash").alias("leaf"), "subroot", "root", F.unhex(F.sha2(text(proof), 256)).alias("proof_sha256"), F.get("folded", F.col("i")).alias("folded_root"))
        out = stored(out)
    for t in [leaves, first, *built]:
        discard(t)
    return out.select("doc_id", *(text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), (F.col("folded_root") == F.col("root")).alias("verified"))
