"""Versioned rows: contents kept for good under a name, each version naming the one it was made from, with decisions on them.

A store is an append-only table (name, version, parent, content, sha256, author) and one of decisions (name, version, decision,
who). There is one writer at a time: an append claims its version by creating a file that mustn't exist yet.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.audit import canonical_json
from terrane.sinks.datasets import DatasetError, _fs

VERSIONS = "name string, version int, parent int, content string, sha256 string, author string"
DECISIONS = "name string, version int, decision string, who string"


def digest(content: str) -> str:
    return hashlib.sha256(content.encode()).hexdigest()


def newest(versions: DataFrame) -> DataFrame:
    """The newest version of each name."""
    return versions.groupBy("name").agg(F.max_by(F.struct("version", "parent", "content", "sha256", "author"), "version").alias("v")).select("name", "v.*")


def approved(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """The newest version of each name whose last decision is an approval; a decision on a version that isn't there counts for nothing."""
    last = decisions.groupBy("name", "version").agg(F.max_by("decision", F.struct("at", "decision")).alias("decision")).where("decision = 'approved'")
    return newest(versions.join(last, ["name", "version"], "left_semi"))


def broken(versions: DataFrame) -> DataFrame:
    """Versions whose content doesn't have its hash, or whose number doesn't follow its parent's."""
    return versions.where((F.sha2("content", 256) != F.col("sha256")) | (F.coalesce("parent", F.lit(0)) >= F.col("version")))


@dataclass
class Store:
    """One folder of versions, read and written through Spark."""

    spark: SparkSession
    root: str

    def _read(self, part: str, shape: str) -> DataFrame:
        fs, path = _fs(self.spark, f"{self.root}/{part}")
        return self.spark.read.schema(shape).parquet(str(path)) if fs.exists(path) else self.spark.createDataFrame([], shape)

    def versions(self) -> DataFrame:
        return self._read("versions", VERSIONS)

    def decisions(self) -> DataFrame:
        return self._read("decisions", DECISIONS + ", at int")

    def get(self, name: str, version: int | None = None):
        """A version, the newest by default, with its hash verified."""
        rows = self.versions().where(F.col("name") == name)
        rows = newest(rows) if version is None else rows.where(F.col("version") == version)
        row = rows.first()
        if row is None:
            raise DatasetError(f"no {name} {version or ''}".strip())
        if digest(row.content) != row.sha256:
            raise DatasetError(f"{name} {row.version} was changed after it was written")
        return row

    def add(self, name: str, value: object, author: str, parent: int | None = None) -> int:
        """Append the next version. ``parent`` must be the newest version, so that nobody's work is passed over unseen."""
        last = self.versions().where(F.col("name") == name).agg(F.max("version")).first()[0]
        if parent != last:
            raise DatasetError(f"{name} is at version {last}, not {parent}")
        version, content = (last or 0) + 1, canonical_json(value)
        fs, claim = _fs(self.spark, f"{self.root}/claims/{digest(name)}-{version}")
        try:
            fs.create(claim, False).close()
        except Exception as e:
            raise DatasetError(f"{name} {version} is being written") from e
        self.spark.createDataFrame([(name, version, parent, content, digest(content), author)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        return version

    def load_once(self, name: str, value: object, author: str) -> int:
        """Add a content under a name of its own; the same content again is no new version, another is an error."""
        row = self.versions().where(F.col("name") == name).first()
        if row is None:
            return self.add(name, value, author)
        if row.sha256 != digest(canonical_json(value)):
            raise DatasetError(f"{name} is stored with other content")
        return row.version

    def decide(self, name: str, version: int, decision: str, who: str) -> None:
        if not who.strip():
            raise DatasetError("a decision names who made it")
        self.get(name, version)
        at = self.decisions().where((F.col("name") == name) & (F.col("version") == version)).count() + 1
        self.spark.createDataFrame([(name, version, decision, who, at)], DECISIONS + ", at int").coalesce(1).write.mode("append").parquet(f"{self.root}/decisions")


def scope_problems(scope: dict) -> list[str]:
    """What keeps a landscape's scope from being used."""
    out = []
    if scope["date_from"] > scope["date_to"]:
        out.append("dates are in the wrong order")
    out += [f"not an office: {c}" for c in scope.get("countries", ()) if not (len(c) == 2 and c.isascii() and c.isalpha() and c.isupper())]
    bare = [k.rstrip("0123456789").rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ") or k for k in scope.get("known_relevant", ())]
    out += [f"named twice: {k}" for k in sorted({k for k in bare if bare.count(k) > 1})]
    if scope.get("known_relevant") and not (scope.get("confirmed_by") or "").strip():
        out.append("known publications need somebody who confirmed them")
    return out


def facts(versions: DataFrame, run: str, metric: str) -> DataFrame:
    """Facts of one run and metric in the order of their dimensions."""
    return versions.where((F.col("run_id") == run) & (F.col("metric_id") == metric)).orderBy("dimensions_key")


def parsed(row) -> object:
    return json.loads(row.content)
