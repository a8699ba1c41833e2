"""Duplicates hidden by formatting: byte-identical rows first, then canonical text of the survivors.

Two spellings are the same if they agree in everything but white space, letter case, punctuation and the
order of labelled parts (``cc: EP; num: 1; kind: A``; at least two labels make a text labelled). A label is a word
that begins with a letter; labels count as text, so a labelled spelling isn't the same as one without labels. What
stands before the first label is a part of its own: records that differ in it are different.

Defined results: null and texts without any letter or digit have no canonical form and join no group; a row
delivered twice counts once; ties for the first id go to code-point order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.runtime import Scratch

HOT = 50_000


def canonical(raw: Column) -> Column:
    """Canonical text of one spelling."""
    marked = F.regexp_replace(F.upper(raw), r"(^|[^\p{L}\p{N}])(\p{L}[\p{L}\p{N}]*+)\s*+[=:]", "\u0001$2\u0002")
    parts = F.split(marked, "\u0001")
    neat = F.array_remove(F.transform(parts, lambda p: F.regexp_replace(p, r"[^\p{L}\p{N}\x{2}]", "")), "")
    labels = F.size(F.filter(parts, lambda p: p.contains("\u0002")))
    plain = F.regexp_replace(F.upper(raw), r"[^\p{L}\p{N}]", "")
    return F.nullif(F.when(labels >= 2, F.array_join(F.sort_array(neat), "\u0001")).otherwise(plain), F.lit(""))


def delivered(rows: DataFrame) -> DataFrame:
    """Byte-identical rows once; rows without an id or text are none."""
    return rows.where("raw is not null and id is not null").distinct()


def collapse(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """From ``delivered`` (id, raw): the records (canonical, n_copies, n_spellings, first_key) and (raw, canonical, n, first_key)."""
    exact = rows.groupBy("raw").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    exact = scratch.save(exact.withColumn("canonical", canonical(F.col("raw"))).where("canonical is not null"))
    records = scratch.save(
        exact.groupBy("canonical").agg(F.sum("n").alias("n_copies"), F.count("*").alias("n_spellings"), F.min("least").alias("first_key"))
    )
    spelled = exact.join(records.where("n_copies > 1"), "canonical").select("raw", "canonical", "n", "first_key")
    return records, spelled


def copies(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(first_key, copy_key) for every id of a group but its smallest."""
    ids = scratch.save(delivered(rows))
    records, spelled = collapse(ids, scratch)
    total = records.agg(F.coalesce(F.sum("n_copies"), F.lit(0))).first()[0]
    limit = max(HOT, total // 1000)
    joined = ids.join(spelled.where(F.col("n") <= limit).select("raw", "first_key"), "raw").select("first_key", "id")
    if total > limit:  # spellings with more than total / 1000 copies: at most 1000 rows, read beside every task
        hot = spelled.where(F.col("n") > limit).select("raw", "first_key")
        joined = joined.unionByName(ids.join(F.broadcast(hot), "raw").select("first_key", "id"))
    return joined.where("id <> first_key").select("first_key", F.col("id").alias("copy_key"))


def sources(items: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    return {
        "ingest_item": items.select("id", F.col("requested_key").alias("raw")),
        "patent_document": documents.select(F.col("document_id").alias("id"), F.col("publication_number_raw").alias("raw")),
    }


def found(items: DataFrame, documents: DataFrame) -> DataFrame:
    """p4_found: table_name, first_key, copy_key."""
    out = None
    for name, rows in sources(items, documents).items():
        part = copies(rows, Scratch(rows.sparkSession, "collapse")).select(F.lit(name).alias("table_name"), "first_key", "copy_key")
        out = part if out is None else out.unionByName(part)
    return out


def records(items: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per record: table_name, canonical, n_copies, n_spellings, first_key."""
    out = None
    for name, rows in sources(items, documents).items():
        part = collapse(delivered(rows), Scratch(rows.sparkSession, "collapse"))[0].select(
            F.lit(name).alias("table_name"), F.translate("canonical", "\u0001\u0002", "; ").alias("canonical"), "n_copies", "n_spellings", "first_key"
        )
        out = part if out is None else out.unionByName(part)
    return out
