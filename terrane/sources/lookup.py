"""Lookup of publications by number: one request at a time with retries, and the same as a Spark data source over stored pages."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrane.functions.ident import pub_key, pub_parts, pub_text, read_number
from terrane.runtime import table

LONGEST_WAIT = 30.0


@dataclass(frozen=True)
class Response:
    """What came back: a status and page, or the name of what broke the connection; ``path`` after redirects."""

    status: int
    path: str = "/patent/"
    page: str | None = None
    broken: str | None = None


def judge(r: Response) -> tuple[str, str | None]:
    """(outcome, detail): ok, not_found and failed are final, retry isn't."""
    if r.broken is not None:
        return "retry", r.broken
    if not r.path.startswith("/patent/"):
        return "failed", f"led away to {r.path}"
    if r.status == 200:
        return ("ok", None) if 'itemprop="publicationNumber"' in (r.page or "") else ("failed", "no microdata")
    if r.status == 404:
        return "not_found", r.path
    return "retry" if r.status == 429 or r.status >= 500 else "failed", f"HTTP {r.status}"


def request(path: str, get: Callable[[str], Response], wait: Callable[[float], None], retries: int = 3) -> tuple[str, str | None, str | None]:
    """(outcome, page, detail) after at most ``retries`` more attempts, 2, 4, 8 ... seconds apart, never more than 30."""
    detail = None
    for attempt in range(retries + 1):
        if attempt:
            wait(min(LONGEST_WAIT, 2.0**attempt))
        answer = get(path)
        outcome, detail = judge(answer)
        if outcome != "retry":
            return outcome, answer.page if outcome == "ok" else None, detail
    return "failed", None, f"gave up after {retries + 1} attempts: {detail}"


def fetch(key: str, get: Callable[[str], Response], wait: Callable[[float], None] = lambda s: None, retries: int = 3) -> dict:
    """One key: a number not found with its kind is asked for once without it."""
    out = {"requested_key": key, "outcome": "invalid_request", "page": None, "kind_fallback": False, "detail": None}
    parts = read_number(key)
    if parts is None:
        return {**out, "detail": "not a publication number"}
    country, number, kind = parts
    outcome, page, detail = request(f"/patent/{country}{number}{kind or ''}/", get, wait, retries)
    if outcome == "not_found" and kind is not None:
        outcome, page, why = request(f"/patent/{country}{number}/", get, wait, retries)
        note = f"kind {kind} not found; looked up {country}{number}"
        detail = note if outcome == "ok" else f"{note}: {why}"
        return {**out, "outcome": outcome, "page": page, "kind_fallback": outcome == "ok", "detail": detail}
    return {**out, "outcome": outcome, "page": page, "detail": detail}


class StoredPages(DataSource):
    """``spark.read.format("stored_pages").option("keys", JSON list).option("store", folder of Parquet (id, page)).load()``

    Keys are dealt to partitions of ``chunk`` keys; each partition reads the pages it needs with a pushed-down filter.
    """

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return "requested_key string, outcome string, page string, kind_fallback boolean, detail string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Chunk(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.store, self.keys, self.chunk = options["store"], json.loads(options["keys"]), int(options.get("chunk", "1000"))

    def partitions(self) -> list[InputPartition]:
        return [_Chunk(self.keys[i : i + self.chunk]) for i in range(0, len(self.keys), self.chunk)]

    def read(self, partition: _Chunk):
        import pyarrow.dataset as ds

        wanted = set()
        for key in partition.keys:
            if parts := read_number(key):
                wanted |= {"".join(p or "" for p in parts), parts[0] + parts[1]}
        rows = ds.dataset(self.store.removeprefix("file://"), format="parquet").to_table(["id", "page"], filter=ds.field("id").isin(sorted(wanted))).to_pylist()
        pages = {r["id"]: r["page"] for r in rows}

        def get(path: str) -> Response:
            page = pages.get(path.split("/")[2])
            return Response(404, path) if page is None else Response(200, path, page)

        for key in partition.keys:
            r = fetch(key, get)
            yield r["requested_key"], r["outcome"], r["page"], r["kind_fallback"], r["detail"]


def lookup(spark: SparkSession, d: str) -> DataFrame:
    """Per requested item of a table, as a join: ok, not_found or invalid_request; a number not found is tried once without its kind."""
    asked = table(spark, d, "ingest_item").select("id", "requested_key").distinct().withColumn("parts", pub_parts(F.col("requested_key"), strict=False))
    asked = asked.select("id", pub_text(F.col("parts")).alias("key"), F.concat("parts.country", "parts.number").alias("bare"), "parts.kind")
    stored = table(spark, d, "patent_document").select(pub_key(F.col("publication"), F.col("publication_number_raw")).alias("pub"), "raw_record_id")
    full = stored.where("pub is not null").groupBy("pub").agg(F.min("raw_record_id").alias("raw_record_id"))
    bare = full.select(F.col("pub").alias("bare"), F.col("raw_record_id").alias("fallback"))
    got = asked.join(full.withColumnRenamed("pub", "key"), "key", "left").join(bare, "bare", "left")
    own, other = F.col("raw_record_id").isNotNull(), F.col("kind").isNotNull() & F.col("fallback").isNotNull()
    outcome = F.when(F.col("key").isNull(), "invalid_request").when(own, "ok").when(other, "ok_without_kind").otherwise("not_found")
    return got.select("id", "key", F.when(own, F.col("raw_record_id")).when(other, F.col("fallback")).alias("raw_record_id"), outcome.alias("outcome"))
