"""Mixing sources to target weights by balanced sampling with the cube method.

Sizes are tokens of a public tokenizer. With total budget T every source s present in the corpus needs
share_s * T tokens, which is f_s times its size: each of its documents comes floor(f_s) times, and once
more with inclusion probability f_s - floor(f_s). The extra copies are drawn by the cube method: inside a
block of one source, probabilities move along vectors of the null space of the constraints (tokens and
documents) until all but as many as there are constraints are 0 or 1. The documents left over from all
blocks of a source meet for a second flight, and the last two or fewer are landed by a draw that keeps
the expected token count.

Documents that alone outweigh LARGE of their source's goal would be left over by the flight, as they hardly move
beside small ones, and then decide the total by a coin. They are a stratum with a flight and landing of its own,
and the others' probability becomes what is still due over their size; as the stratum's expected tokens are its
share, every document's probability over all draws stays what it was, unless the rest is too small to make up.

Without a given total, T is the largest at which every present source reaches its share within its cap
(shares of sources absent from the corpus are spread in proportion over the present ones). With a given
total a source stops at max_repeats copies, and the report shows what it falls short.

Defined results: null source or share, a share of 0 or less, max_repeats below 1: the source contributes
nothing; documents whose text has no tokens are never drawn; equal shares, ties and repeats are decided by a
seeded hash of doc_id, so results are the same on every run; a repeated doc_id counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.bpe import encoder
from terrane.runtime import Scratch

BLOCK = 2000
LARGE = 0.005
EPS = 1e-9


def sizes(documents: DataFrame, folder: str | None = None, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, source and token count of every document, by the encoder of ``bpe``."""
    made = encoder(documents.sparkSession, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = made()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n = [enc.count(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def flight(prob: np.ndarray, cons: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Flight phase: probabilities after moving until at most as many as constraints are not yet 0 or 1.

    ``cons`` has a row per unit, already divided by its probability where that is wanted; sums of
    ``cons[i] * prob[i]`` stay as they are. ``draws`` are numbers in [0, 1), one per step.
    """
    p = prob.astype(float).copy()
    k = cons.shape[1]
    live = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    window, nxt, step = live[: k + 1], min(k + 1, len(live)), 0
    while len(window) == k + 1:
        a = cons[window].T
        u = np.linalg.svd(a)[2][-1] if k > 2 else _null(a)
        q = p[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > EPS, (1 - q) / u, np.where(u < -EPS, -q / u, np.inf)).min()
            down = np.where(u > EPS, q / u, np.where(u < -EPS, (q - 1) / u, np.inf)).min()
        q = q + up * u if draws[step % len(draws)] * (up + down) < down else q - down * u
        step += 1
        q = np.clip(q, 0, 1)
        q[q < EPS] = 0
        q[q > 1 - EPS] = 1
        p[window] = q
        window = [i for i in window if 0 < p[i] < 1]
        while len(window) < k + 1 and nxt < len(live):
            window.append(live[nxt])
            nxt += 1
    return p


def _null(a: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to the two rows of a 2 x 3 matrix."""
    u = np.cross(a[0], a[1])
    size = np.abs(u).max()
    if size < EPS:  # the rows are in proportion: any move that keeps the first will do
        r = a[0] if np.abs(a[0]).max() > EPS else np.array([1.0, 1.0, 1.0])
        u = np.array([r[1], -r[0], 0.0]) if abs(r[0]) + abs(r[1]) > EPS else np.array([1.0, 0.0, 0.0])
        size = np.abs(u).max()
    return u / size


def _hash(ids: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from ids: two rounds of a multiply and shift mix."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) + np.uint64(seed * 2 + 1) * np.uint64(0x9E3779B97F4A7C15)
        for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(m)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(float) / 2.0**53


def _fly(seed: int, land: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].to_numpy()
        order = np.argsort(_hash(ids, seed), kind="stable")
        pdf = pdf.iloc[order].reset_index(drop=True)
        ids = pdf["doc_id"].to_numpy()
        cons = np.column_stack([pdf["n_tokens"].to_numpy(float) / max(1.0, float(pdf["n_tokens"].mean())), np.ones(len(pdf))])
        draws = _hash(ids, seed + 1)
        p = flight(pdf["p"].to_numpy(), cons, draws)
        if land:  # at most two are left; each in turn takes 1 or 0 by its own probability
            for i in np.flatnonzero((p > 0) & (p < 1)):
                p[i] = float(draws[i] < p[i])
        return pdf.assign(p=p)

    return run


def plan(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, sources): copies per document, and the factors and sizes per source."""
    scratch = Scratch(documents.sparkSession, "mixture")
    docs = scratch.save(sizes(documents.where("doc_id is not null and source is not null"), folder).dropDuplicates(["doc_id"]))
    have = docs.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n_docs"))
    want = targets.where("source is not null and target_share > 0").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats")
    )
    # One row per source of the target list. The list is given by hand; sources not in it never come out.
    rows = want.join(have, "source", "left").na.fill(0, ["size", "n_docs"])
    usable = F.col("size") * F.col("max_repeats") > 0
    rows = rows.withColumn("goal", F.when(usable, F.col("target_share")))
    whole = rows.agg(F.sum("goal").alias("whole"), F.min(F.col("max_repeats") * F.col("size") / F.col("goal")).alias("least"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row of sums
    total = F.lit(float(total_tokens)) if total_tokens else F.col("least") * F.col("whole")
    factor = F.least(F.col("goal") / F.col("whole") * total / F.col("size"), F.col("max_repeats").cast("double"))
    rows = rows.withColumn("total", total).withColumn("factor", F.when(usable, F.round(factor, 12)).otherwise(0.0))
    rows = scratch.save(rows.select("source", "target_share", "max_repeats", "size", "n_docs", "total", "factor"))
    kept = docs.where("n_tokens > 0").join(rows.where("factor > 0").select("source", "factor", "size", F.col("n_docs").alias("of")), "source")
    kept = kept.withColumn("base", F.floor("factor").cast("int")).withColumn("p", F.col("factor") - F.floor("factor"))
    kept = kept.withColumn("large", F.col("n_tokens") > LARGE * F.col("factor") * F.col("size"))
    shape = "source string, block int, doc_id bigint, n_tokens bigint, p double"
    parts = max(1, -(-(rows.agg(F.sum("n_docs")).first()[0] or 0) // (4 * BLOCK)))  # a set number of tasks: flights cost time, not bytes
    # Documents that alone outweigh LARGE of their source's goal, fewer than 1 / (LARGE * factor) a source, are a stratum
    # of their own that is drawn first; what came of it is made up by the probability of the others.
    first = kept.where("large and p > 0").select("source", F.lit(-1).alias("block"), "doc_id", "n_tokens", "p")
    first = scratch.save(first.groupBy("source", "block").applyInPandas(_fly(seed, True), shape))
    drawn = first.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("p")).alias("drawn"))
    small = kept.where("not large and p > 0").groupBy("source").agg(F.sum("n_tokens").alias("small"), F.max(F.col("p") * F.col("size")).alias("due"))
    p_small = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("due") - F.coalesce("drawn", F.lit(0.0))) / F.col("small")))
    anew = small.join(drawn, "source", "left").select("source", p_small.alias("p"))
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.ceil(F.col("of") / BLOCK)).cast("int")
    moving = kept.where("not large and p > 0").drop("p").join(anew, "source").select("source", block.alias("block"), "doc_id", "n_tokens", "p")
    flown = scratch.save(moving.repartition(parts, "source", "block").groupBy("source", "block").applyInPandas(_fly(seed, False), shape))
    # Two documents at most are left of a block; blocks of a source meet in groups until one is left.
    blocks = flown.where("p > 0 and p < 1").agg(F.max("block")).first()[0] or 0
    done = flown.unionByName(first).where("p = 1").select("doc_id")
    rest = flown.where("p > 0 and p < 1")
    level = 1
    while blocks >= BLOCK // 2:
        met = rest.withColumn("block", F.floor(F.col("block") / (BLOCK // 2)).cast("int"))
        met = scratch.save(met.groupBy("source", "block").applyInPandas(_fly(seed + 2 * level, False), shape))
        done = done.unionByName(met.where("p = 1").select("doc_id"))
        rest, blocks, level = met.where("p > 0 and p < 1"), blocks // (BLOCK // 2), level + 1
    last = rest.withColumn("block", F.lit(0)).groupBy("source", "block").applyInPandas(_fly(seed + 2 * level, True), shape)
    done = scratch.save(done.unionByName(last.where("p = 1").select("doc_id"))).withColumn("extra", F.lit(1))
    mix = kept.join(done, "doc_id", "left").select(
        "doc_id", "source", "n_tokens", (F.col("base") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies")
    )
    return mix.where("copies > 0"), rows


def mixture(documents: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """doc_id, source, n_tokens, copies of every document drawn."""
    return plan(documents, targets, **how)[0]


def shares(documents: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """Target and actual share of every source of the list, with repeats and shortfall."""
    mix, rows = plan(documents, targets, **how)
    got = mix.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").cast("bigint").alias("documents"), F.max("copies").alias("most_copies")
    )
    out = rows.join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_copies"])
    whole = out.agg(F.sum("tokens").alias("whole"))
    return out.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.try_divide(F.col("tokens").cast("double"), F.col("whole")).alias("actual_share"), F.col("size").alias("source_tokens"),
        "tokens", "documents", "max_repeats", "most_copies", F.greatest(F.lit(0.0), F.col("target_share") * F.col("total") - F.col("tokens")).alias("short_tokens"),
    )
