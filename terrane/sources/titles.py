"""Classification title lists: one line per entry, tab separated, parents from dot levels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.search import INDEXING


def as_lines(entries: DataFrame) -> DataFrame:
    """Entries as the lines of a title list."""
    level = F.when(F.col("kind").isin("main_group", "subgroup"), F.coalesce(F.col("dot_level").cast("string"), F.lit(""))).otherwise("")
    return entries.select("scheme_version", "pos", F.concat_ws("\t", "symbol", level, F.coalesce("title", F.lit(""))).alias("line"))


def parse(lines: DataFrame) -> DataFrame:
    """scheme_version, pos, symbol, level, title, problem of every line; nothing is guessed from a bad line."""
    part = F.split("line", "\t")
    rows = lines.select("scheme_version", "pos", part[0].alias("symbol"), F.try_element_at(part, F.lit(2)).try_cast("int").alias("level"), F.nullif(F.try_element_at(part, F.lit(3)), F.lit("")).alias("title"), F.size(part).alias("n"))
    problem = F.when(F.col("n") != 3, "fields").when(F.col("level") < 0, "level").when(~F.col("symbol").rlike(r"^[A-Z]([0-9]{2}([A-Z]([0-9]+/[0-9]+)?)?)?$"), "symbol")
    return rows.select("scheme_version", "pos", "symbol", "level", "title", problem.alias("problem"))


def parents(entries: DataFrame) -> DataFrame:
    """Parent of every group by position: the nearest entry before it of a lower level, if that is one level up and of the
    same main group, or the main group that an indexing group belongs to.

    One pass over each subclass of an edition in order of position, keeping the open entry of each level only.
    """

    def main_group(symbol: str) -> int | None:
        m = re.match(r".{4}([0-9]+)/", symbol)
        return int(m[1]) if m else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []
        for b in batches:
            out = []
            for scheme, sub, symbol, level in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if (scheme, sub) != now:
                    now, stack = (scheme, sub), []
                while stack and stack[-1][0] >= level:
                    stack.pop()
                near = stack[-1] if stack and stack[-1][0] == level - 1 else None
                fits = near is not None and (a := main_group(symbol)) is not None and (b := main_group(near[1])) is not None and a - b in (0, INDEXING)
                out.append((scheme, symbol, near[1] if fits else None))
                stack.append((level, symbol))
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["scheme_version", "symbol", "parent"])

    g = entries.where("kind in ('main_group', 'subgroup') and dot_level >= 0").select("scheme_version", F.substring("symbol", 1, 4).alias("sub"), "pos", "symbol", "dot_level")
    placed = g.repartition("scheme_version", "sub").sortWithinPartitions("scheme_version", "sub", "pos", "symbol")
    return placed.mapInArrow(run, "scheme_version string, symbol string, parent string")
