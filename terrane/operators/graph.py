"""Graph operators: connected components by star contraction, and bounded breadth-first search."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.runtime import Scratch

HOT = 100_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars: each node with the smallest it is tied to there."""
    up: dict[str, str] = {}

    def top(x: str) -> str:
        way = []
        while (y := up.setdefault(x, x)) != x:
            way.append(x)
            x = y
        for w in way:
            up[w] = x
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in list(up) if (r := top(x)) != x]
    for at in range(0, len(pairs), 10_000) if pairs else [0]:
        part = pairs[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in part], pa.string()) for k in (0, 1)], ["a", "b"])


def _with_least(pairs: DataFrame, rows: int) -> DataFrame:
    """(a, b, m): m is the least b of each a. The minimum is combined before the shuffle; the edges of an ``a`` with more
    than ``limit`` of them, of which there are 1000 at most, stay where they are."""
    limit = max(HOT, rows // 1000)
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if rows <= limit:
        return pairs.join(least.drop("n"), "a")
    hot = least.where(F.col("n") > limit).drop("n")
    cold = pairs.join(least.where(F.col("n") <= limit).drop("n"), "a")
    return cold.unionByName(pairs.join(F.broadcast(hot), "a"))


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Each partition first makes stars of its own edges. Then, in turn, every node ties its greater neighbours to its least
    neighbour (large star), and its smaller neighbours and itself to the least of them (small star), until nothing changes;
    the rounds grow with the logarithm of the longest chain. Null ends are no edges; a node tied only to itself is its own
    component; an empty table gives an empty table.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    e = edges.toDF("a", "b").where("a is not null and b is not null")
    alone = e.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = scratch.save(e.where("a <> b").mapInArrow(_stars, "a string, b string").distinct())
    seen = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == sign:
            break
        seen, rows = sign, sign[0]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * rows).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        small = _with_least(large, rows)
        tied = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small.select("a", F.col("m").alias("b")))
        after = scratch.save(tied.distinct())
        scratch.drop(now)
        now = after
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = found.select("component").distinct().select(F.col("component").alias("node"), "component")
    every = found.unionByName(roots)
    return every.unionByName(alone.distinct().join(every.select("node"), "node", "left_anti"))


def bfs(seeds: DataFrame, links: DataFrame, allowed: DataFrame, hops: int = 3, cap: int = 600, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Citation expansion. ``links`` (document, target), ``allowed`` (target): targets inside the scope.

    Returns (reached: node, hop) and the accounting (hop, reason, n). Per hop the targets of the frontier are,
    in this order, already requested, out of scope, chosen by most linking documents then number, or over the
    cap. The cap is the operator's own limit; all that it leaves out is counted.
    """
    scratch = scratch or Scratch(seeds.sparkSession, "bfs")
    seen = scratch.save(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    counts = None
    for hop in range(1, hops + 1):
        frontier = seen.where(F.col("hop") == hop - 1).select(F.col("node").alias("document"))
        cand = links.join(frontier, "document", "left_semi").groupBy("target").agg(F.countDistinct("document").alias("n_links"))
        known = seen.select(F.col("node").alias("target"), F.lit(True).alias("known"))
        inside = allowed.select("target").distinct().withColumn("inside", F.lit(True))
        cand = cand.join(known, "target", "left").join(inside, "target", "left")
        reason = F.when(F.col("known"), "already_requested").when(F.col("inside").isNull(), "out_of_scope").otherwise("eligible")
        cand = scratch.save(cand.select("target", "n_links", reason.alias("reason")))
        chosen = cand.where("reason = 'eligible'").orderBy(F.desc("n_links"), "target").limit(cap).select(F.col("target").alias("node"), F.lit(hop).alias("hop"))
        chosen = scratch.save(chosen)
        rest = cand.join(chosen.select(F.col("node").alias("target"), F.lit("requested").alias("got")), "target", "left")
        what = F.coalesce("got", F.when(F.col("reason") == "eligible", "over_cap").otherwise(F.col("reason")))
        tally = rest.groupBy(F.lit(hop).alias("hop"), what.alias("reason")).agg(F.count("*").alias("n"))
        counts = tally if counts is None else counts.unionByName(tally)
        seen = scratch.save(seen.unionByName(chosen))
    return seen, counts
