"""Pairs of names that look alike: one begins with the words of the other, or their similarity ratio is high.

All pairs of keys are looked at. The keys, ordered by length, are dealt to blocks, and two blocks meet unless
the lengths alone keep every pair below the bound. Where two blocks meet, two bounds that lose no pair leave
few for difflib: its ratio is 2 M / (n + m) with M letters matched in order, so letters in common (with their
numbers) are at least M, and, as a letter left over spoils at most two pairs of neighbours on its own side and
one on the other, neighbours in common are at least (n + m) / 2 - 1 - 1.5 (n + m - 2 M).
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.runtime import Scratch

BLOCK = 4096
STRIPE = 1024
CLASSES = 64
BIGRAMS = 509
LEVELS = 1024


def _counts(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, numbers of letters and of pairs of neighbours; unlike signs may share a class, which only raises a bound."""
    n = np.array([len(k) for k in keys], dtype=np.int64)
    cp = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    kind = np.where((cp >= 97) & (cp <= 122), cp - 97, np.where(cp == 32, 26, np.where((cp >= 48) & (cp <= 57), cp - 21, 37 + cp % 27)))
    row = np.repeat(np.arange(len(keys)), n)
    one = np.bincount(row * CLASSES + kind, minlength=len(keys) * CLASSES).reshape(len(keys), CLASSES)
    inside = row[1:] == row[:-1]
    two = (kind[:-1] * CLASSES + kind[1:]) % BIGRAMS
    two = np.bincount(row[1:][inside] * BIGRAMS + two[inside], minlength=len(keys) * BIGRAMS).reshape(len(keys), BIGRAMS)
    return n, one, two.astype(np.int32)


def _steps(one: np.ndarray, top: np.ndarray, wide: int) -> np.ndarray:
    """A column per class and step, 1 where the number reaches into the step: products of rows are sums of minima."""
    reach = -(-one // wide)
    cols = [(reach[:, c] > k) for c in range(CLASSES) for k in range(-(-int(top[c]) // wide))]
    return np.column_stack(cols).astype(np.float32) if cols else np.zeros((len(one), 0), dtype=np.float32)


def candidates(left: list[str], right: list[str], least: float):
    """Arrays of positions (i, j) of all pairs whose ratio can reach the bound, stripe by stripe."""
    (na, one_a, two_a), (nb, one_b, two_b) = _counts(left), _counts(right)
    top = np.minimum(one_a.max(axis=0), one_b.max(axis=0))
    wide = 1
    while (-(-top // wide)).sum() > LEVELS and wide < top.max():
        wide *= 2
    a, b = _steps(one_a, top, wide) * wide, _steps(one_b, top, wide)
    a = np.column_stack([a, -least / 2 * na, np.ones(len(na))]).astype(np.float32)
    b = np.ascontiguousarray(np.column_stack([b, np.ones(len(nb)), -least / 2 * nb]).astype(np.float32).T)
    slack = 0.01 + 1e-5 * float(na.max() + nb.max())
    for at in range(0, len(na), STRIPE):
        i, j = np.nonzero(a[at : at + STRIPE] @ b >= -slack)
        i += at
        for k in range(0, len(i), 100_000):
            x, y = i[k : k + 100_000], j[k : k + 100_000]
            both = np.minimum(two_a[x], two_b[y]).sum(axis=1)
            ok = both >= (0.5 - 1.5 * (1 - least)) * (na[x] + nb[y]) - 1 - 1e-6
            yield x[ok], y[ok]


def alike(left: list[str], right: list[str], least: float, own: bool) -> list[tuple[str, str, float]]:
    """(a, b, ratio) with a < b; ``own``: both lists are the same one."""
    out, match = [], difflib.SequenceMatcher(None)
    for i, j in candidates(left, right, least):
        pairs = [(min(left[x], right[y]), max(left[x], right[y])) for x, y in zip(i.tolist(), j.tolist()) if not own or left[x] < right[y]]
        last = None
        for a, b in sorted(pairs, key=lambda p: p[1]):
            if b != last:
                match.set_seq2(b)
                last = b
            match.set_seq1(a)
            if (r := match.ratio()) >= least:
                out.append((a, b, round(r, 3)))
    return out


def word_prefixes(keys: DataFrame) -> DataFrame:
    """(a, b) of distinct keys where the words of a are the first words of b."""
    words = F.split("key", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    longer = keys.where(F.size(words) > 1).select(F.explode(starts).alias("a"), F.col("key").alias("b"))
    return longer.join(keys.select(F.col("key").alias("a")), "a").select("a", "b")


def similar(keys: DataFrame, least: float = 0.88) -> DataFrame:
    """(a, b, ratio), a < b, of all pairs of distinct keys (STRING column key, not empty) that look alike."""
    keys = Scratch(keys.sparkSession, "similar").save(keys.where("key <> ''").distinct())
    n = keys.groupBy(F.length("key").alias("n")).agg(F.count("*").alias("many"))  # a row per length
    n = n.withColumn("before", F.sum("many").over(W.orderBy("n").rowsBetween(W.unboundedPreceding, -1)))
    at = F.coalesce("before", F.lit(0)) + F.pmod(F.xxhash64("key"), F.col("many"))
    dealt = keys.withColumn("n", F.length("key")).join(n, "n").select("key", "n", F.floor(at / BLOCK).alias("block"))
    spans = dealt.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))  # a row per block
    i, j = spans.select(F.col("block").alias("i"), F.col("high").alias("x")), spans.select(F.col("block").alias("j"), F.col("low").alias("y"))
    meet = i.join(j, (F.col("i") <= F.col("j")) & ((F.col("y") <= F.col("x")) | (2 * F.col("x") >= (least - 1e-9) * (F.col("x") + F.col("y"))))).select("i", "j")
    first = meet.join(dealt, F.col("i") == F.col("block")).select("i", "j", F.lit(0).alias("side"), "key")
    second = meet.where("i < j").join(dealt, F.col("j") == F.col("block")).select("i", "j", F.lit(1).alias("side"), "key")
    placed = first.unionByName(second).repartition(4 * keys.sparkSession.sparkContext.defaultParallelism, "i", "j")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.loc[pdf["side"] == 0, "key"].tolist()
        own = pdf["i"].iat[0] == pdf["j"].iat[0]
        right = left if own else pdf.loc[pdf["side"] == 1, "key"].tolist()
        found = alike(left, right, least, own) if left and right else []
        return pd.DataFrame(found, columns=["a", "b", "ratio"]).astype({"ratio": "float64"})

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(difflib.SequenceMatcher(None, x, y).ratio(), 3) for x, y in zip(a, b)], dtype="float64")

    near = placed.groupBy("i", "j").applyInPandas(run, "a string, b string, ratio double")
    starts = word_prefixes(keys).select("a", "b", F.pandas_udf(ratio, "double")("a", "b").alias("ratio"))
    return near.unionByName(starts).distinct()
