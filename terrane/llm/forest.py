"""Connected groups from pairwise links: union-find within edge partitions, forests merged in rounds.

Every round sends edges to bounded partitions, runs union-find inside each and keeps only a spanning
forest as (node, root) stars. Forests meet by their nodes rather than by a fixed order of partitions, so the
hierarchy of merges is as deep as the links need: rounds alternate between keying by the larger end of an edge (roots of
one node meet) and by either end (chains through a node meet) until the stars no longer change.
An end with very many edges is dealt out over chunks, each of which keeps the end itself as a member,
so no task holds more than a bounded number of edges whatever the skew.

Defined results: null ends and self-links link nothing; repeated links count once; an empty table gives
an empty table. Labels are the smallest node of a group in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.ident import pub_key, pub_text, pub_parts
from terrane.runtime import Scratch

EDGES_PER_PART = 400_000
CHUNK = 100_000


class UnionFind:
    """Disjoint sets over hashable nodes; the representative is the smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = up.setdefault(x, x)
        while root != up[root]:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def link(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if b < a:
                a, b = b, a
            self.up[b] = a


def _forest_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forest of a partition's edges, as one (node, root) row for every node but the roots."""
    sets = UnionFind()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sets.link(x, y)
    yield from _rows((n, sets.find(n)) for n in list(sets.up))


def _forest_owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As above, but only nodes of owned edges come out; the other edges lend their shorter way to a root."""
    sets, owned = UnionFind(), set()
    for b in batches:
        for x, y, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            sets.link(x, y)
            if own:
                owned.add(x)
                owned.add(y)
    yield from _rows((n, sets.find(n)) for n in owned)


def _rows(pairs) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for n, r in pairs:
        if n != r:
            a.append(n)
            b.append(r)
            if len(a) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["node", "root"])
                a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["node", "root"])


def _dealt(edges: DataFrame, key: str, rows: int, parts: int) -> DataFrame:
    """Edges in bounded partitions by ``key``; keys with more than a chunk of edges are dealt over chunks."""
    limit = max(CHUNK, rows // 1000)
    if rows <= limit:  # no key can be hot
        return edges.withColumn("_s", F.lit(0)).repartition(parts, key, "_s").drop("_s")
    hot = edges.groupBy(key).count().where(F.col("count") > limit)  # at most rows / limit <= 1000 keys
    hot = hot.select(F.col(key).alias("_k"), F.ceil(F.col("count") / limit).cast("int").alias("_c"))
    dealt = edges.join(F.broadcast(hot), F.col(key) == F.col("_k"), "left")
    salt = F.when(F.col("_c").isNotNull(), F.pmod(F.xxhash64("node", "root"), F.col("_c"))).otherwise(F.lit(0))
    return dealt.withColumn("_s", salt).repartition(parts, key, "_s").drop("_k", "_c", "_s")


def connected_groups(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that isn't its group's smallest, from two STRING columns of links."""
    a, b = links.columns[:2]
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("root")).where("node is not null and root is not null and node <> root")
    ends = ends.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root"))
    # Round 0 shuffles nothing: each input partition keeps its own forest.
    now = scratch.save(ends.mapInArrow(_forest_all, "node string, root string"))
    seen: list[tuple] = []
    for k in range(max_rounds):
        sign = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")), F.lit(0))).first()
        rows = sign[0]
        if len(seen) > 2 and seen[-1] == seen[-2] == tuple(sign):
            return now
        seen.append(tuple(sign))
        parts = max(1, -(-rows * (1 + k % 2) // EDGES_PER_PART))
        if k % 2 == 0:
            moved = _dealt(now.distinct(), "node", rows, parts).mapInArrow(_forest_all, "node string, root string")
        else:
            both = now.withColumn("key", F.col("root")).withColumn("own", F.lit(True)).unionByName(
                now.withColumn("key", F.col("node")).withColumn("own", F.lit(False))
            )
            moved = _dealt(both, "key", rows * 2, parts).select("node", "root", "own").mapInArrow(_forest_owned, "node string, root string")
        after = scratch.save(moved.distinct())
        scratch.drop(now)
        now = after
    raise RuntimeError("connected_groups did not settle")


# Written in place of a family id that is not known.
FILLERS = ("UNKNOWN", "N/A", "NA", "NONE", "NULL", "TBD", "-")


def family_links(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links between publications and the retrieved publications themselves.

    Nodes are text whose first sign sorts retrieved publications before all others, so that the smallest
    node of a group is its smallest retrieved publication: "0" + number, "1" + number of one only stated,
    "2" + source + id for a stated family id. A family id links only within one source; ids without a
    digit other than 0, all-nine ids and the words of FILLERS link nothing.
    """
    docs = documents.select(
        pub_key(F.col("publication"), F.col("publication_number_raw")).alias("pub"), "source_id",
        F.trim(F.col("family_id_simple")).alias("fid"), "family_members",
    ).where("pub is not null")
    docs = scratch.save(docs)  # the number of a publication is read from its spelling once, not for every use
    retrieved = docs.select("pub").distinct()
    fam = docs.where(
        F.col("fid").rlike("[1-9]") & ~F.col("fid").rlike("^9{3,}$") & ~F.upper("fid").isin(*FILLERS) & F.col("source_id").isNotNull()
    ).select(F.concat(F.lit("0"), "pub").alias("a"), F.concat(F.lit("2"), "source_id", F.lit("|"), "fid").alias("b")).distinct()
    member = F.coalesce(pub_text(pub_parts(F.col("m"), strict=False)), F.nullif(F.regexp_replace(F.upper("m"), r"[^0-9A-Z]", ""), F.lit("")))
    stated = docs.select("pub", F.explode("family_members").alias("m")).select("pub", member.alias("m")).where("m is not null and m <> pub").distinct()
    known = retrieved.select(F.col("pub").alias("m"), F.lit(1).alias("there"))
    stated = stated.join(known, "m", "left").select(
        F.concat(F.lit("0"), "pub").alias("a"), F.concat(F.when(F.col("there") == 1, "0").otherwise("1"), "m").alias("b")
    )
    return fam.unionByName(stated), retrieved


def family_groups(documents: DataFrame) -> DataFrame:
    """(family_key, publication_number) of every retrieved publication that isn't itself the key of its family."""
    scratch = Scratch(documents.sparkSession, "families")
    links, _ = family_links(documents, scratch)
    stars = connected_groups(links, scratch)
    return stars.where(F.substring("node", 1, 1) == "0").select(
        F.expr("substring(root, 2)").alias("family_key"), F.expr("substring(node, 2)").alias("publication_number")
    )


def family_keys(documents: DataFrame) -> DataFrame:
    """Every retrieved publication with its family_key; one without links is its own family."""
    grouped = family_groups(documents)
    alone = documents.select(pub_key(F.col("publication"), F.col("publication_number_raw")).alias("publication_number"))
    alone = alone.where("publication_number is not null").distinct()
    return alone.join(grouped, "publication_number", "left").select(
        F.coalesce("family_key", "publication_number").alias("family_key"), "publication_number"
    )
