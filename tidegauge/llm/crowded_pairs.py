"""Pairs to test within groups of nodes, without all pairs of a large group.

In a small group all pairs are taken. The nodes of a crowded group are told apart by their own tokens: with the tokens of all these
nodes in one order, rarest first, two sets of sizes n and m that have A tokens or more in common share one of the first
n - A + 1 tokens of the one and one of the first m - A + 1 of the other. Partners are taken class by class of their size,
so that A is close to what a pair of these sizes needs. Nodes around one common passage then meet only if they also share a rare
token, or if they have little else than the passage: and then they are so similar that they link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm.textbytes import mix64
from tidegauge.shared import materialise

#: Nodes up to which a group's pairs are all taken: half as many pairs as this for each row at most.
CROWDED = 16
#: Sizes of a class of partners differ by this factor at most.
CLASS_FACTOR = 1.03


def class_bounds(limit: int = 1 << 31) -> np.ndarray:
    """The least size of each class."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS_FACTOR)))
    return np.array(out)


def prefix_keys(size: np.ndarray, rank: np.ndarray, token: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, key, class, partners' class) for tokens of the given rank (from 1, rarest first) in sets of the given size.

    Two sets that can link share a key, whose classes are theirs.
    """
    bounds = class_bounds()
    class_of = lambda n: np.searchsorted(bounds, n, "right") - 1
    least, most = -(-percent * size // 100), 100 * size // percent
    own, low, high = class_of(size), class_of(least), class_of(most)
    for step in range(int((high - low).max(initial=-1)) + 1):
        partner = low + step
        smallest = np.maximum(bounds[np.minimum(partner, high)], least)
        common = -(-percent * (size + smallest) // (100 + percent))
        rows = np.flatnonzero((partner <= high) & (rank <= size - common + 1))
        a, b = np.minimum(own, partner)[rows], np.maximum(own, partner)[rows]
        yield rows, mix64(token[rows] ^ mix64(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))), own[rows], partner[rows]


Near = Callable[[list[str], list[str]], Column]


def open_pairs(groups: DataFrame, tokens: DataFrame, percent: int, crowded: int = CROWDED, marks: DataFrame | None = None, near: Near | None = None) -> DataFrame:
    """x, y: pairs of nodes of different components to test, among them all that link. A pair may stand there more than once.

    ``groups`` has signature, node, component, n (tokens of the set); ``tokens`` has node, token: the set of each of its nodes.
    ``near`` may leave out pairs that can't link by the columns of ``marks`` (node and others) of the one and of the other.
    """
    mine = [c for c in marks.columns if c != "node"] if marks is not None else []
    theirs = [f"__r_{c}" for c in mine]
    marked = lambda df: df.join(marks, "node") if mine else df
    renamed = [F.col(c).alias(d) for c, d in zip(mine, theirs, strict=True)]
    like = near(mine, theirs) if near else F.lit(True)
    held = groups.groupBy("signature").agg(F.count(F.lit(1)).alias("__nodes"))
    few = marked(groups.join(held.where(F.col("__nodes") <= crowded), "signature"))
    other = few.select("signature", F.col("node").alias("y"), F.col("component").alias("its"), F.col("n").alias("__m"), *renamed)
    alike = F.expr(f"component < its and 100 * least(n, __m) >= {percent} * greatest(n, __m)") & like
    small = few.withColumnRenamed("node", "x").join(other, "signature").where(alike).select("x", "y")
    many = materialise(groups.join(held.where(F.col("__nodes") > crowded), "signature").groupBy("node").agg(F.first("component").alias("component"), F.first("n").alias("n")), "crowded")
    if not many.limit(1).count():
        return small
    own = materialise(tokens.join(many, "node", "left_semi"), "crowded-tokens")
    shared = own.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    by_node = Window.partitionBy("node")
    common = own.join(shared, "token").withColumns({"rank": F.row_number().over(by_node.orderBy("held", "token")), "common": F.count(F.lit(1)).over(by_node)})
    # Tokens that no other node has come first in the order and meet nothing.
    ranked = common.join(many, "node").select("node", "component", "n", "token", (F.col("rank") + F.col("n") - F.col("common")).alias("rank"))
    ranked = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, token, rank = (batch.column(k).to_numpy() for k in (2, 3, 4))
            for rows, key, mine, theirs in prefix_keys(size, rank, token.view(np.uint64), percent):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(mine), pa.array(theirs)], names=["key", "node", "component", "own", "partner"])

    keys = materialise(ranked.mapInArrow(keyed, "key long, node long, component long, own long, partner long"), "prefix-keys")
    # A key of one component or of one side only makes no pair.
    met = keys.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    keys = marked(keys.join(met, "key"))
    left = keys.where("own <= partner").select("key", F.col("node").alias("x"), F.col("component").alias("__c"), F.col("own").alias("__own"), F.col("partner").alias("__partner"), *mine)
    right = keys.where("own >= partner").select(F.col("key").alias("__key"), F.col("node").alias("y"), F.col("component").alias("__d"), F.col("own").alias("__theirs"), *renamed)
    apart = (F.col("__c") != F.col("__d")) & (F.col("__partner") == F.col("__theirs")) & ((F.col("__own") != F.col("__partner")) | (F.col("x") < F.col("y"))) & like
    return small.unionByName(left.join(right, (F.col("key") == F.col("__key")) & apart).select("x", "y"))
