"""MinHash near-duplicates with tensored banding: table keys pair up entries of two small hash collections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.llm.common import connected_components, discard, stored, through_python

#: Entries of either collection, and minimum hashes in an entry: SIDE * SIDE tables of 2 * ROWS hashes from 2 * SIDE * ROWS.
#: A pair of similarity s shares no table with probability 1 - (1 - (1 - s^ROWS)^SIDE)^2: 7e-5 at 0.8, 1e-7 at 0.9.
SIDE, ROWS = 10, 2
#: Leaders of a bucket, and leaders that a node is compared with at once: those with which it shares most buckets. A bucket's
#: nodes are dealt into LEADERS parts by a hash; a part's leader is the node with most company, counted over all its buckets: in
#: a group of edited copies that is the least edited one, from which the others are least far.
LEADERS, FIRST = 3, 3
#: Turns of leaders before the nodes of buckets that are still mixed are searched by prefixes.
TURNS = 2
#: Entries (of 2 * SIDE) that a node must share with a leader to be compared with it: 12.8 on average at 0.8, 5 at 0.5. Pairs
#: with fewer wait for the search by prefixes, so this loses nothing.
AGREE = 8
#: Bits of the parities that are compared before two whole sets are: see _by_prefixes.
PARITY = 1024
REMEMBER = 300_000


class _Words(dict):
    """Word to 64-bit hash; forgets all once it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBER:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def shingles(text: str, k: int, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; fewer words are one run, none give none. A-Z is lower-cased."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z only and splits at \x20 and \x09-\x0D
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(k, len(h))
    n = len(h) - k + 1
    run = np.full(n, k, np.uint64)
    for i in range(k):
        run = _mix(run * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(run)


def _minima(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least value of each seeded hash over the set, taken block by block."""
    least = np.full(len(seeds), 2**64 - 1, np.uint64)
    for a in range(0, len(s), 4096):
        v = s[a : a + 4096, None] ^ seeds[None, :]
        v *= np.uint64(0xC4CEB9FE1A85EC53)
        v ^= v >> np.uint64(31)
        v *= np.uint64(0x9FB21C651E98DF25)
        np.minimum(least, v.min(axis=0), out=least)
    return least


def _seeds(n: int, salt: int) -> np.ndarray:
    return np.random.default_rng(salt).integers(0, 2**64, n, np.uint64)


def _signed(a: np.ndarray) -> list[int]:
    return a.view(np.int64).tolist()


def summaries(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits of the whole set, null if empty), a and b: the two collections of entries."""
    seeds = _seeds(2 * SIDE * ROWS, 11)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for f in frames:
            rows = []
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                s = shingles(text, k, words)
                if not len(s):
                    rows.append((doc, 0, None, None, None))
                    continue
                m = _minima(s, seeds).reshape(2 * SIDE, ROWS)
                entry = _mix(m[:, 0] * np.uint64(0x9E3779B97F4A7C15) + np.arange(2 * SIDE, dtype=np.uint64))
                for i in range(1, ROWS):
                    entry = _mix(entry * np.uint64(0x9E3779B97F4A7C15) + m[:, i])
                rows.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), _signed(entry[:SIDE]), _signed(entry[SIDE:])))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "a", "b"])

    return through_python(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id", "n_shingles long, digest binary, a array<long>, b array<long>")


def _sets(reps: DataFrame, k: int) -> DataFrame:
    """node, set and parity of the texts whose set has the node's digest; a doc_id may stand on several texts.

    A set's parity: bit i tells whether an odd number of its hashes is i modulo PARITY.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for f in frames:
            nodes, sets, parities = [], [], []
            for node, digest, text in zip(f["node"], f["digest"], f["text"], strict=True):
                s = shingles(text, k, words)
                if xxhash.xxh3_128_digest(s.tobytes()) == digest:
                    nodes.append(node)
                    sets.append(s.view(np.int64))
                    odd = np.bincount((s % np.uint64(PARITY)).view(np.int64), minlength=PARITY) & 1
                    parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pd.DataFrame({"node": nodes, "set": sets, "parity": parities})

    return reps.mapInPandas(run, "node long, set array<long>, parity array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets are similar enough."""
    one = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"set{x}"))
    both = pairs.join(one("b"), "b").join(one("a"), "a")
    both = both.withColumn("c", F.size(F.array_intersect("seta", "setb")))
    return both.filter(F.col("c") * 100 >= (F.size("seta") + F.size("setb") - F.col("c")) * percent).select("a", "b")


def _mixed(buckets: DataFrame, found: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The buckets' nodes with their components so far; and of the buckets that hold several components the largest one."""
    if found is None:
        held = buckets.withColumn("component", F.col("node"))
    else:
        held = buckets.join(found, "node", "left").select(*buckets.columns, F.coalesce("component", "node").alias("component"))
    sizes = held.groupBy("key", "component").agg(F.count("*").alias("c"))
    return held, sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("of")).filter("of > 1").select("key", "main")


def _stars(held: DataFrame, mixed: DataFrame, nodes: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of nodes with leaders of their buckets. In the first turn any node may lead, later the largest component does."""
    open_ = held.join(mixed, "key")
    lead = open_ if turn == 0 else open_.filter("component = main")
    part = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(LEADERS))
    first = [F.max_by("node", F.when(part == r, F.struct("company", "node"))) for r in range(LEADERS)]
    leaders = lead.groupBy("key").agg(F.array_compact(F.array(*first)).alias("leaders"))
    rest = open_ if turn == 0 else open_.filter("component != main")
    star = rest.join(leaders, "key").select("node", F.explode("leaders").alias("leader")).filter("node != leader").groupBy("node", "leader").agg(F.count("*").alias("c"))
    star = star.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("c"), "leader"))).filter(F.col("r") <= FIRST)
    pairs = star.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    one = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.concat("a", "b").alias(f"e{x}"))
    same = sum((F.col("ea")[i] == F.col("eb")[i]).cast("int") for i in range(2 * SIDE))
    fit = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return pairs.join(one("b"), "b").join(one("a"), "a").filter(fit & (same >= AGREE)).select("a", "b")


def _spine(found: DataFrame) -> DataFrame:
    """Links that stand for the components found so far."""
    return found.filter("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def _prefixes(open_: DataFrame, percent: int) -> DataFrame:
    """key, node, n, parity, pos: the shingles of each set that a linked set of another node could share first, rarest first.

    Two linked sets of n and m <= n shingles share `need` = percent * (n + m) / (100 + percent) at least. In one order of
    all shingles, the first that they share has less than n - need + 1 before it; m is percent of n at least. The order is by
    the number of nodes that hold a shingle; those that one node holds alone come first and are only counted.
    """
    held = open_.select("node", F.size("set").alias("n"), F.explode("set").alias("key"))
    often = held.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    shared = held.join(often, "key")
    mine = Window.partitionBy("node")
    alone = F.col("n") - F.count("*").over(mine)
    placed = shared.withColumn("pos", (alone + F.row_number().over(mine.orderBy("df", "key")) - 1).cast("int"))
    placed = placed.filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100))
    return placed.join(open_.select("node", "parity"), "node").select("key", "node", "n", "parity", "pos")


def _by_prefixes(prefixes: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may be linked: all that are linked are among them.

    A set meets the sets that are not larger than itself at the shingles of both prefixes, if what follows there is enough
    for both. The smaller set's prefix is shorter, as its partner is at least as large. Where a component holds most of the
    nodes of a shingle, its nodes meet those of the others only. Each bit in which the parities of two sets differ stands for
    a shingle that only one of them has, so a pair with too many such bits can't be linked.
    """
    held, mixed = _mixed(prefixes, found)
    held = stored(held.join(mixed, "key"))
    need = lambda n, m: F.ceil((n + m) * percent / (100 + percent))
    small = held.filter(F.col("pos") <= F.col("n") - need(F.col("n"), F.col("n")))
    main = F.col("component") == F.col("main")
    c = lambda x: F.col(x)
    other = (c("x.component") != c("y.component")) & ((c("y.n") < c("x.n")) | ((c("y.n") == c("x.n")) & (c("y.node") < c("x.node")))) & (c("y.n") * 100 >= c("x.n") * percent)
    enough = F.least(c("x.n") - c("x.pos"), c("y.n") - c("y.pos")) >= need(c("x.n"), c("y.n"))
    differ = sum(F.bit_count(c("x.parity")[i].bitwiseXOR(c("y.parity")[i])) for i in range(PARITY // 64))
    enough = enough & (differ <= c("x.n") + c("y.n") - 2 * need(c("x.n"), c("y.n")))
    meet = lambda x, y: x.alias("x").join(y.alias("y"), (c("x.key") == c("y.key")) & other & enough).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return meet(held.filter(~main), small).union(meet(held.filter(main), small.filter(~main))).distinct()


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where 100 * intersection >= percent * union of their sets
    of k-word shingles; component_id is the least doc_id reachable.

    1. Rows with equal sets become one node. Each node's keys, SIDE * SIDE pairs of entries, put it into buckets; only
       buckets of two nodes or more go on.
    2. Each bucket has LEADERS leaders. Each node is paired with the FIRST leaders with
       which it shares most buckets; so a large group costs a few pairs a node. Pairs are confirmed on whole sets, and
       components are formed. In further turns the nodes outside a bucket's largest component meet new leaders from it.
    3. The nodes of buckets that still hold several components are compared wherever the rarest shingles of two of them
       agree (see _prefixes); this finds every link between two of these nodes and leaves out pairs that are close but not
       close enough. What remains is confirmed on whole sets, and the final components are formed. So every linked pair that
       shares a bucket is found or already in one component, whatever step 2 found.

    Null or empty text, or text of white space, has no shingle and is linked with nothing. A null doc_id never names a
    component: such rows take the class of an equal set that has an id, else component_id is null and kept false. Repeated
    rows are in one class; each row is returned. A doc_id on several texts is as many nodes. Other columns are ignored. An
    empty table gives none.
    """
    rows = stored(summaries(docs, k))
    nodes = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    nodes = stored(nodes.filter("doc is not null").withColumn("node", F.monotonically_increasing_id()))
    tables = [F.xxhash64(F.lit(i * SIDE + j), F.col("a")[i], F.col("b")[j]) for i in range(SIDE) for j in range(SIDE)]
    keys = nodes.select("node", F.explode(F.array(*tables)).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    sized = stored(keys.join(shared, "key"))
    company = sized.groupBy("node").agg(F.sum("size").alias("company"))
    buckets = stored(sized.join(company, "node").select("key", "node", "company"))
    there = nodes.join(buckets.select("node").distinct(), "node").select("node", "doc", "digest")
    reps = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(there, F.col("doc_id") == F.col("doc")).select("node", "digest", "text")
    sets = stored(_sets(reps, k).dropDuplicates(["node"]))

    found = None
    for turn in range(TURNS):
        held, mixed = _mixed(buckets, found)
        links = _confirmed(_stars(held, mixed, nodes, turn, percent), sets, percent)
        found = connected_components(links if found is None else _spine(found).union(links))

    held, mixed = _mixed(buckets, found)
    open_ = sets.join(held.join(mixed, "key").select("node").distinct(), "node", "left_semi")
    prefixes = stored(_prefixes(open_, percent))
    more = stored(_confirmed(_by_prefixes(prefixes, found, percent), sets, percent))
    if more.limit(1).count():
        found = connected_components(_spine(found).union(more))
    for t in (sized, buckets, sets, prefixes):
        discard(t)
    named = nodes.select("digest", "node", "doc").join(found, "node", "left").select("digest", "doc", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "component").select(F.col("digest").alias("__digest"), "component_id")
    out = rows.join(named, F.col("digest") == F.col("__digest"), "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
