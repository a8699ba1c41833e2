"""Content-addressed payloads: stored once under their hash, verified whenever they are read, parsed again on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.sources.pages import parse_pages

SHAPE = "object_key string, sha256 string, content string, shard string"


def objects(payloads: DataFrame) -> DataFrame:
    """(source_id, content) as objects, equal content of one source once."""
    h = F.sha2("content", 256)
    key = F.concat_ws("/", F.lit("raw"), "source_id", F.substring(h, 1, 2), h)
    rows = payloads.where("content is not null and source_id is not null").select(key.alias("object_key"), h.alias("sha256"), "content")
    return rows.groupBy("object_key", "sha256").agg(F.first("content").alias("content")).withColumn("shard", F.substring("sha256", 1, 2))


def read(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(SHAPE).parquet(root)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SHAPE)


def put(payloads: DataFrame, root: str) -> DataFrame:
    """Append what isn't stored yet; returns the objects of the payloads. Nothing stored is ever written over."""
    spark = payloads.sparkSession
    mine = objects(payloads)
    new = mine.join(read(spark, root).select("object_key"), "object_key", "left_anti")
    new.write.mode("append").partitionBy("shard").parquet(root)
    return mine.drop("content")


def verified(stored: DataFrame) -> DataFrame:
    """Objects with ``intact``: whether the bytes still have the hash they are filed under."""
    return stored.withColumn("intact", (F.sha2("content", 256) == F.col("sha256")) & F.col("object_key").endswith(F.col("sha256")))


def replay(items: DataFrame, stored: DataFrame, status: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A batch parsed again from its stored pages, without fetching: (documents, counts of what was left out by outcome).

    ``items`` (requested_key, outcome, object_key, created_at, id) of the batch, of which the latest per key holds;
    ``stored`` objects with retrieved_at. Keys that were never fetched aren't replayed but counted; a page that fails its
    hash comes out in quarantine.
    """
    last = F.max_by(F.struct("outcome", "object_key"), F.struct(F.col("created_at").isNotNull(), "created_at", "id"))
    latest = items.groupBy("requested_key").agg(last.alias("r")).select("requested_key", "r.*")
    fetched = F.col("outcome").isin("stored", "quarantined", "duplicate") & F.col("object_key").isNotNull()
    left = latest.where(~fetched).groupBy("outcome").agg(F.count("*").alias("n"))
    good = verified(stored)
    pages = latest.where(fetched).join(good, "object_key")
    docs = parse_pages(pages.select(F.col("requested_key").alias("id"), F.when(F.col("intact"), F.col("content")).alias("page"), "retrieved_at"), status)
    bad = pages.where(~F.col("intact")).select(F.col("requested_key").alias("id"), F.lit(True).alias("broken"))
    docs = docs.join(bad, "id", "left").withColumn("quarantine", F.when(F.col("broken"), "stored page is corrupt").otherwise(F.col("quarantine"))).drop("broken")
    return docs, left
