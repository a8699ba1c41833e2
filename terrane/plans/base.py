"""Frames and SQL shared by the plan modules: the latest copy of each publication, and its children."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.ident import pub_key
from terrane.runtime import table


def copies(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Every copy with its publication in normal form; rows delivered twice come once."""
    t = table(spark, d, "patent_document")
    pub = pub_key(F.col("publication"), F.col("publication_number_raw"))
    rows = t.select(pub.alias("pub"), "document_id", "retrieved_at", *columns).where("pub is not null")
    return rows.dropDuplicates(["document_id"])


def latest(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest copy of each publication, by aggregation: a publication of very many copies is combined map-side."""
    t = table(spark, d, "patent_document")
    pub = pub_key(F.col("publication"), F.col("publication_number_raw"))
    rank = F.struct(F.col("retrieved_at").isNotNull(), F.col("retrieved_at"), F.col("document_id"))
    row = F.struct("document_id", "retrieved_at", *columns)
    picked = t.withColumn("pub", pub).where("pub is not null").groupBy("pub").agg(F.max_by(row, rank).alias("r"))
    return picked.select("pub", F.substring("pub", 1, 2).alias("office"), "r.*")


# The same in DuckDB.
PUB = """coalesce(publication.country || publication.number || coalesce(publication.kind, ''),
      upper(regexp_replace(publication_number_raw, '[^0-9A-Za-z]', '', 'g')))"""
COPIES = f"""copies AS (SELECT * FROM (SELECT *, {PUB} AS pub FROM patent_document) WHERE pub IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY pub) = 1)"""
LATEST = f"""{COPIES},
doc AS (SELECT *, substr(pub, 1, 2) AS office FROM copies
      QUALIFY row_number() OVER (PARTITION BY pub ORDER BY retrieved_at DESC NULLS LAST, document_id DESC) = 1)"""

ITEMS = "item AS (SELECT DISTINCT * FROM ingest_item)"


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingest_item").dropDuplicates(["id"])


def entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cpc_entry").dropDuplicates(["scheme_version", "symbol"])


ENTRIES = "entry AS (SELECT DISTINCT * FROM cpc_entry)"
