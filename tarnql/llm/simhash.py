"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, connected components.

A fingerprint has 64 bits.  Split into m blocks, two fingerprints that differ in three
bits or fewer agree on m - 3 whole blocks at least, so each is listed under all choices of
m - 3 blocks and only those that share a listing are compared.  m is the least number,
from five, with as many possible listings of a choice as there are fingerprints: ten
listings of 25 bits or more up to 33 million of them, twenty of 32 bits up to four
billion, and so on.  No link depends on m.  Equal fingerprints are one node throughout,
so copies are never paired.

A listing that holds more than ``HOT`` distinct fingerprints isn't paired at all.
Its members go to the centres of small balls instead: within three bits, one of the
two lies within one bit and the other within two bits of some common centre, so
linking all members of a ball to its smallest inner member loses no connection and
costs a fixed number of rows a member.

Components are found by large-star / small-star rounds over the links, each round a
table in the shared folder; nothing is gathered on the driver but counts.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text

MAX_DISTANCE = 3
SHINGLE = 3
LEAST_BLOCKS, MOST_BLOCKS = 5, 9
#: Distinct fingerprints under one listing that are compared pair by pair.
HOT = 256
#: Rows of one fingerprint beyond which they don't meet their component in a shuffle.
MANY = 1_000_000
SEED = 42


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """Of lower-cased words: a bit is 1 if it is set in over half the shingles' hashes."""
    import xxhash

    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[k : k + (1 << 14)].astype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    import pyarrow as pa

    for batch in batches:
        fps = [fingerprint(t.lower().split()) for t in text.utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row; a null text is an empty one."""
    kind = dict(docs.dtypes)["doc_id"]
    return common.map_arrow(docs.select("doc_id", "text"), _fingerprints, f"doc_id {kind}, fp long")


def blocks_for(n: int) -> int:
    """The number of blocks for ``n`` distinct fingerprints."""
    for m in range(LEAST_BLOCKS, MOST_BLOCKS):
        if n <= 1 << 64 * (m - MAX_DISTANCE) // m:
            return m
    return MOST_BLOCKS


def masks(m: int) -> list[int]:
    """For each choice of m - 3 of m blocks, their bits."""
    cuts = [64 * k // m for k in range(m + 1)]
    block = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(m)]
    return [sum(chosen) for chosen in combinations(block, m - MAX_DISTANCE)]


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _listings(nodes: DataFrame, m: int) -> DataFrame:
    keys = [F.struct(F.lit(k).alias("pair"), F.col("fp").bitwiseAND(F.lit(_long(mask)).cast("long")).alias("bits")) for k, mask in enumerate(masks(m))]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.pair", "key.bits")


def _near(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_DISTANCE


def _pair_links(listed: DataFrame) -> DataFrame:
    a = listed.select(F.col("fp").alias("a"), "pair", "bits")
    b = listed.select(F.col("fp").alias("b"), "pair", "bits")
    return a.join(b, ["pair", "bits"]).where((F.col("a") < F.col("b")) & _near("a", "b")).select("a", "b")


def _ball_links(nodes: DataFrame) -> DataFrame:
    """Links of all nodes within three bits of each other, without pairing them.

    The planner takes exploded rows for as small as the nodes that they come from (2,081 of
    them a node), so the join of a small crowd would be a broadcast of millions: it is told to merge.
    """

    def ball(flips):
        flipped = F.array(*[F.lit(_long(sum(1 << b for b in bits))).cast("long") for bits in flips])
        return nodes.select("fp", F.explode(flipped).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("centre"))

    inner = ball([()] + [(b,) for b in range(64)])
    outer = ball(list(combinations(range(64), 2)))
    hubs = inner.groupBy("centre").agg(F.min("fp").alias("a"))
    return (
        inner.unionByName(outer)
        .join(hubs.hint("merge"), "centre")
        .where((F.col("a") != F.col("fp")) & _near("a", "fp"))
        .select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
        .distinct()
    )


def links(nodes: DataFrame, hot: int = HOT, m: int | None = None) -> DataFrame:
    """Links (a < b) between distinct fingerprints that connect all that lie within three bits."""
    listed = _listings(nodes, m or blocks_for(nodes.count()))
    sizes = listed.groupBy("pair", "bits").count().where(F.col("count") > 1)
    # as in _ball_links: ten rows of a node or more, which the planner doesn't count
    shared = common.stored(listed.join(sizes.hint("merge"), ["pair", "bits"]))
    found = _pair_links(shared.where(F.col("count") <= hot))
    crowd = shared.where(F.col("count") > hot).select("fp").distinct()
    if not crowd.isEmpty():
        found = found.unionByName(_ball_links(crowd))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) is connected with."""
    edges = common.stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        # large star: a node's larger neighbours move to its smallest neighbour, or to itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = common.stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.forget(edges)
        if now == seen:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges, seen = after, now


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    Texts without words have fingerprint zero and link like any others.  A null id
    never is a component's smallest one, unless it has no other.  Repeated rows are
    told once each; ids are of any type that has an order.  An empty table
    gives an empty result; columns other than doc_id and text are ignored.
    """
    rows = common.stored(fingerprints(docs))
    classes = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = components(links(classes.select("fp"), hot))
    classes = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    labels = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = common.stored(classes.join(labels, "root").select("fp", "n", "component_id"))
    # one for each MANY rows at most: small beside any table
    crowded = F.broadcast(named.where(F.col("n") > MANY).select("fp", "component_id"))
    alone = rows.join(crowded, "fp", "left_anti").join(named.where(F.col("n") <= MANY).select("fp", "component_id"), "fp")
    both = alone.unionByName(rows.join(crowded, "fp"))
    return both.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
