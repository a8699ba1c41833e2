"""Datasets: the tables of one run written together under a name of their own, never changed afterwards."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.audit import canonical_json


class DatasetError(ValueError):
    """A dataset that can't be built, found or trusted."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """(rows, order-free fingerprint): the sum of the rows' hashes, combined on the executors."""
    cols = [F.coalesce(F.to_json(F.col(f.name)) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name).cast("string"), F.lit("\u0000")) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    row = F.sha2(F.concat_ws("\u0001", *cols), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    n, *sums = df.agg(F.count("*"), *parts).first()
    return n, "-".join(str(s or 0) for s in sums)


def write(tables: dict[str, DataFrame], root: str, dataset_id: str, config: dict) -> dict:
    """Write all tables under ``root/dataset_id`` and then the manifest; without a manifest there is no dataset.

    The tables go to a staging folder that becomes the dataset by one rename, so a run that fails leaves nothing behind
    under the dataset's name. A dataset that exists is an error.
    """
    if not tables:
        raise DatasetError("a dataset has at least one table")
    spark = next(iter(tables.values())).sparkSession
    fs, final = _fs(spark, f"{root}/{dataset_id}")
    if fs.exists(final):
        raise DatasetError(f"{dataset_id} exists")
    _, staging = _fs(spark, f"{root}/.staging-{dataset_id}")
    fs.delete(staging, True)
    manifest: dict = {"dataset_id": dataset_id, "config": config, "tables": {}}
    try:
        for name, df in tables.items():
            df.write.parquet(f"{staging}/{name}")
            rows, mark = fingerprint(spark.read.parquet(f"{staging}/{name}"))
            manifest["tables"][name] = {"rows": rows, "fingerprint": mark}
        _, note = _fs(spark, f"{staging}/manifest.json")
        out = fs.create(note, False)
        out.write(bytearray(canonical_json(manifest), "utf-8"))
        out.close()
        if not fs.rename(staging, final):
            raise DatasetError(f"{dataset_id} exists")
    except BaseException:
        fs.delete(staging, True)
        raise
    return manifest


def manifest(spark: SparkSession, root: str, dataset_id: str) -> dict:
    fs, note = _fs(spark, f"{root}/{dataset_id}/manifest.json")
    if not fs.exists(note):
        raise DatasetError(f"no dataset {dataset_id}")
    return json.loads(spark.sparkContext.wholeTextFiles(str(note)).values().first())


def read(spark: SparkSession, root: str, dataset_id: str, name: str, verify: bool = True) -> DataFrame:
    """A table of a dataset, checked against the manifest."""
    said = manifest(spark, root, dataset_id)["tables"].get(name)
    if said is None:
        raise DatasetError(f"{dataset_id} has no table {name}")
    df = spark.read.parquet(f"{root}/{dataset_id}/{name}")
    if verify and fingerprint(df) != (said["rows"], said["fingerprint"]):
        raise DatasetError(f"{dataset_id}/{name} was changed after it was written")
    return df


def inputs(documents: DataFrame, items: DataFrame, batches: list[str]) -> DataFrame:
    """The documents of the given batches, each once. Unknown and unfinished batches are errors, and so is no document."""
    if not batches:
        raise DatasetError("a dataset needs a batch")
    mine = items.where(F.col("batch_id").isin(*batches))
    state = {r.batch_id: r.open for r in mine.groupBy("batch_id").agg(F.count_if(F.col("outcome").isNull()).alias("open")).collect()}  # one row a batch asked for
    if gone := sorted(set(batches) - set(state)):
        raise DatasetError(f"unknown batches {gone}")
    if unfinished := sorted(b for b, n in state.items() if n):
        raise DatasetError(f"unfinished batches {unfinished}")
    got = documents.dropDuplicates(["document_id"]).join(mine.where("raw_record_id is not null").select("raw_record_id"), "raw_record_id", "left_semi")
    if got.isEmpty():
        raise DatasetError("the batches hold no document")
    return got


def start_batch(keys: list[str], source: str, provenance: dict, now: str, new_id: Callable[[], str], normal: Callable[[str], str | None] = lambda k: k) -> dict:
    """A batch of requests with where they come from; a key asked for twice in any spelling is one request."""
    asked: dict[str, str] = {}
    for k in keys:
        asked.setdefault(normal(k) or k, k)
    if not asked:
        raise DatasetError("a batch needs a key")
    return {"batch_id": new_id(), "source_id": source, "created_at": now, "status": "running", "provenance": canonical_json(provenance), "requested": list(asked.values()), "repeated": len(keys) - len(asked)}


def report(title: str, counts: dict[str, dict[str, int]]) -> str:
    """Counts as a Markdown document: a table per heading, in the order given."""
    out = [f"# {title}"]
    for heading, rows in counts.items():
        out += ["", f"## {heading}", "", "| | n |", "|-|-|", *(f"| {k} | {v:,} |" for k, v in rows.items())]
    return "\n".join(out) + "\n"
