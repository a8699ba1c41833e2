"""Parent-child rows to full hierarchies: paths, depth, root, descendants, and entries that never reach a root.

Components are found by pointer doubling along the parent column, brought together, and walked depth first
in one task each, on an explicit stack with three colours: white is new, grey is on the walk, black is done.
A tree is walked from its head, a component without one from the smallest entry of its loop; a step to a grey
entry is the back edge of the loop, and the entries grey at that moment lie on it. Components of more than
``bound`` entries aren't brought together: their paths are put together by doubling too, each entry taking
the piece of path of the entry it points to, so a chain of any depth takes a logarithm of rounds; the loop of
such a component are the entries still pointed to after enough doublings.

Defined results: a null or blank parent makes a root; a parent that isn't in the edition makes an orphan, the
head of its own tree with status ``orphan``, and so for all beneath it; a loop and all that leads into it have
status ``cycle`` with null path, depth and root; null symbol or edition: no entry; repeated rows count once,
of unlike parents of one symbol the smallest holds. Unbounded lists aren't built: descendants come as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.ident import norm_symbol
from terrane.runtime import Scratch

BOUND = 50_000
SHAPE = "scheme_version string, symbol string, status string, path array<string>, depth int, root string, on_loop boolean, back_to string"


def entries(cpc: DataFrame) -> DataFrame:
    """scheme_version, symbol, parent (normal form, null at a root), orphan, one row per entry."""
    e = cpc.select("scheme_version", "symbol", norm_symbol(F.col("parent")).alias("parent")).where("scheme_version is not null and symbol is not null")
    e = e.groupBy("scheme_version", "symbol").agg(F.min("parent").alias("parent"))
    there = e.select("scheme_version", F.col("symbol").alias("parent"), F.lit(True).alias("there"))
    return e.join(there, ["scheme_version", "parent"], "left").select(
        "scheme_version", "symbol", "parent", (F.col("parent").isNotNull() & F.col("there").isNull()).alias("orphan")
    )


def components(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` (scheme_version, symbol, up; null at a head) with ``comp`` and ``looped`` (its component has no head)."""
    key = ["scheme_version", "symbol"]
    now = scratch.save(nodes.select(*key, F.coalesce("up", "symbol").alias("at"), F.col("symbol").alias("low"), F.col("up").isNull().alias("done")))
    left, k = now.where("not done").count(), 0
    while left:
        step = now.select("scheme_version", F.col("symbol").alias("at"), F.col("at").alias("at2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        moved = now.where("not done").join(step, ["scheme_version", "at"]).select(
            *key, F.col("at2").alias("at"), F.least("low", "low2").alias("low"), F.col("done2").alias("done")
        )
        after = scratch.save(now.where("done").unionByName(moved))
        scratch.drop(now)
        now, k, before = after, k + 1, left
        left = now.where("not done").count()
        if left == before and 2**k > left:
            break
    heads = now.where("done").select(*key, F.col("at").alias("comp"), F.lit(False).alias("looped"), F.lit(False).alias("held"))
    if not left:
        return heads
    u = now.where("not done")
    lows = u.select("scheme_version", F.col("symbol").alias("at"), F.col("low").alias("comp"))
    held = u.select("scheme_version", F.col("at").alias("symbol"), F.lit(True).alias("held")).distinct()
    loops = u.join(lows, ["scheme_version", "at"]).join(held, key, "left").select(*key, "comp", F.lit(True).alias("looped"), F.coalesce("held", F.lit(False)).alias("held"))
    return heads.unionByName(loops)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (scheme_version, comp, symbol, up, looped, orphan) sorted by component."""
    out: list[tuple] = []
    now, rows = None, []

    def close() -> None:
        if now is None:
            return
        scheme, looped = now[0], now[2]
        up = {r[0]: r[1] for r in rows}
        below: dict[str, list[str]] = {}
        for s, parent in up.items():
            if parent is not None:
                below.setdefault(parent, []).append(s)
        head = _on_loop(up) if looped else next(s for s, parent in up.items() if parent is None)
        status = "cycle" if looped else "orphan" if next(r[2] for r in rows if r[0] == head) else "tree"
        grey, done, path = {head}, set(), []
        back: dict[str, str] = {}
        on: set[str] = set()
        stack = [(head, False)]
        while stack:
            s, left = stack.pop()
            if left:
                path.pop()
                grey.discard(s)
                done.add(s)
                if looped:
                    out.append((scheme, s, status, None, None, None, s in on, back.get(s)))
                continue
            grey.add(s)
            path.append(s)
            if not looped:
                out.append((scheme, s, status, list(path), len(path) - 1, path[0], False, None))
            stack.append((s, True))
            for child in sorted(below.get(s, ()), reverse=True):
                if child in grey:
                    back[s] = child
                    on.update(path[path.index(child) :])
                elif child not in done:
                    stack.append((child, False))

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * 8
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in SHAPE.split(", ")])

    for b in batches:
        for scheme, comp, s, parent, looped, orphan in zip(*(b.column(i).to_pylist() for i in range(6))):
            if (scheme, comp, looped) != now:
                close()
                now, rows = (scheme, comp, looped), []
                if len(out) > 5000:
                    yield batch()
                    out.clear()
            rows.append((s, parent, orphan))
    close()
    yield batch()


def _on_loop(up: dict[str, str]) -> str:
    """The smallest entry of the loop that following ``up`` ends in."""
    seen, s = set(), next(iter(up))
    while s not in seen:
        seen.add(s)
        s = up[s]
    loop, t = [s], up[s]
    while t != s:
        loop.append(t)
        t = up[t]
    return min(loop)


def _doubled(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Paths of (scheme_version, symbol, up, orphan) that all reach a head: each round a piece of path is put before one's own."""
    now = scratch.save(nodes.select("scheme_version", "symbol", F.col("up").alias("at"), F.array("symbol").alias("path"), "orphan"))
    while not now.where("at is not null").isEmpty():
        ahead = now.select("scheme_version", F.col("symbol").alias("at"), F.col("at").alias("at2"), F.col("path").alias("before"), F.col("orphan").alias("lost"))
        moved = now.where("at is not null").join(ahead, ["scheme_version", "at"])
        moved = moved.select("scheme_version", "symbol", F.col("at2").alias("at"), F.concat("before", "path").alias("path"), F.col("lost").alias("orphan"))
        after = scratch.save(now.where("at is null").unionByName(moved))
        scratch.drop(now)
        now = after
    return now


def hierarchy(cpc: DataFrame, bound: int = BOUND) -> DataFrame:
    """One row per entry: scheme_version, symbol, status, path from the root, depth, root, on_loop, and, at the entry whose
    child closes a loop, that child as back_to."""
    scratch = Scratch(cpc.sparkSession, "hierarchy")
    key = ["scheme_version", "symbol"]
    nodes = entries(cpc).withColumn("up", F.when(~F.col("orphan"), F.col("parent")))
    nodes = scratch.save(nodes.select(*key, "up", "orphan"))
    comp = scratch.save(nodes.join(components(nodes, scratch), key))
    big = comp.groupBy("scheme_version", "comp", "looped").count().where(F.col("count") > bound).drop("count")  # fewer than rows / bound rows
    if big.isEmpty():
        return _walked(comp)
    large = scratch.save(comp.join(big, ["scheme_version", "comp", "looped"], "left_semi"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("path", "array<string>"), ("depth", "int"), ("root", "string"))]
    loops = large.where("looped")
    # The least entry of a loop names its component; the edge to it from its parent closes the loop.
    last = loops.where("symbol = comp").select("scheme_version", F.col("up").alias("symbol"), F.col("comp").alias("back_to"))
    loops = loops.join(last, key, "left").select(*key, F.lit("cycle").alias("status"), *none, F.col("held").alias("on_loop"), "back_to")
    trees = _doubled(large.where("not looped").select(*key, "up", "orphan"), scratch)
    trees = trees.select(
        *key, F.when(F.col("orphan"), "orphan").otherwise("tree").alias("status"), "path", (F.size("path") - 1).alias("depth"), F.col("path")[0].alias("root"), F.lit(False).alias("on_loop"), F.lit(None).cast("string").alias("back_to")
    )
    return _walked(comp.join(big, ["scheme_version", "comp", "looped"], "left_anti")).unionByName(loops).unionByName(trees)


def _walked(comp: DataFrame) -> DataFrame:
    placed = comp.select("scheme_version", "comp", "symbol", "up", "looped", "orphan").repartition("scheme_version", "comp")
    return placed.sortWithinPartitions("scheme_version", "comp", "looped").mapInArrow(_walk, SHAPE)


def back_edges(cpc: DataFrame, bound: int = BOUND) -> DataFrame:
    """One row per loop: the edge from ``symbol`` down to its child ``back_to``, the least entry of the loop, that closes it."""
    return hierarchy(cpc, bound).where("back_to is not null").select("scheme_version", "symbol", "back_to")


def descendants(cpc: DataFrame, bound: int = BOUND) -> DataFrame:
    """A row for every entry and each entry beneath it: scheme_version, symbol, descendant, distance."""
    paths = hierarchy(cpc, bound).where("depth > 0")
    return paths.select("scheme_version", F.posexplode("path").alias("k", "symbol"), F.col("symbol").alias("descendant"), "depth").where("k < depth").select(
        "scheme_version", "symbol", "descendant", (F.col("depth") - F.col("k")).alias("distance")
    )


def endless(cpc: DataFrame, bound: int = BOUND) -> DataFrame:
    """Entries from which following parent never ends."""
    return hierarchy(cpc, bound).where("status = 'cycle'").select("scheme_version", "symbol")
