"""Files as sources: folders of documents, JSON, CSV and XML records, YAML settings, zipped title lists."""

from __future__ import annotations

import datetime
import hashlib
import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.ident import pub_parts, pub_text
from terrane.operators.search import INDEXING
from terrane.runtime import ship

BAD = "_corrupt_record"


class SourceError(ValueError):
    """A file that isn't what it should be."""


def records(spark: SparkSession, path: str, kind: str, schema: str, row_tag: str = "record") -> DataFrame:
    """Records of JSON lines, CSV with a header, or XML; a record that can't be read is kept as text in ``_corrupt_record``."""
    shaped = spark.read.schema(f"{schema}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    if kind == "json":
        return shaped.json(path)
    if kind == "csv":
        return shaped.option("header", "true").csv(path)
    if kind == "xml":
        return shaped.option("rowTag", row_tag).xml(path)
    raise SourceError(f"no reader for {kind}")


PIECE = 1 << 20
# Letters and numbers of Latin-1.
TEXT = re.compile(b"[" + re.escape(bytes(b for b in range(256) if unicodedata.category(chr(b))[0] in "LN")) + b"]")


def _opened(path: str):
    """A file by the path Spark gives: of this file system as it is, of others through Arrow."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb", buffering=0)
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", path), safe=":/@"))
    return system.open_input_stream(at)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and hash of each file, and whether it has text; pieces of it are in memory, never the whole."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            h, length, text = hashlib.sha256(), 0, False
            with _opened(path) as f:
                while piece := f.read(PIECE):
                    h.update(piece)
                    length += len(piece)
                    text = text or TEXT.search(piece) is not None
            yield pa.RecordBatch.from_pydict({"path": [path], "length": [length], "sha256": [h.hexdigest()], "text": [text]})


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder, also below it: name, stem, publication read from the stem, length and hash; ``problem`` says why
    a file can't be used (no text in it, or a name that is no number). Spark lists no files of length 0. Files are read
    piece by piece, so they may be of any length."""
    ship(spark)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    files = listed.select("path").mapInArrow(_read, "path string, length bigint, sha256 string, text boolean")
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    pub = pub_text(pub_parts(stem))
    problem = F.when(~F.col("text"), "no text").when(pub.isNull(), "no number in the name")
    return files.select(name.alias("file"), stem.alias("stem"), pub.alias("publication"), "length", "sha256", problem.alias("problem"))


def folder_summary(scanned: DataFrame) -> DataFrame:
    """Files, distinct contents, distinct publications and problems of a scan."""
    return scanned.agg(
        F.count("*").alias("files"), F.countDistinct("sha256").alias("contents"), F.countDistinct("publication").alias("publications"), F.count("problem").alias("problems"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    )


def settings(path: str, needed: dict[str, type]) -> dict:
    """A YAML mapping with the needed keys of the needed kinds and no others."""
    import yaml

    got = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(got, dict):
        raise SourceError(f"{path}: not a mapping")
    problems = [f"unknown key {k}" for k in got if k not in needed] + [f"no {k}" for k in needed if k not in got]
    problems += [f"{k} is not of kind {t.__name__}" for k, t in needed.items() if k in got and not isinstance(got[k], t)]
    if problems:
        raise SourceError(f"{path}: {'; '.join(problems)}")
    return got


LIST_NAME = re.compile(r"cpc-section-([A-HY])_([0-9]{8})\.txt")  # Fixed value: how the files of a title list are named.
SYMBOL = re.compile(r"[A-HY]([0-9]{2}([A-Z]([0-9]{1,4}/[0-9]{2,6})?)?)?")


def title_lists(content: bytes) -> tuple[str, list[tuple]]:
    """(edition, entries) of a zip of title lists, entries being (pos, symbol, kind, dot_level, title, parent).

    Nothing is guessed: file names, one date for all, tab-separated fields and levels must be right, a group's parent is the
    nearest entry before it one level up, of the same subclass and, for indexing groups, of the same family of main groups.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            files = {n: z.read(n).decode("utf-8") for n in sorted(z.namelist())}
    except (zipfile.BadZipFile, UnicodeDecodeError) as e:
        raise SourceError(f"not a zip of texts: {e}") from e
    told = {n: LIST_NAME.fullmatch(n.rsplit("/", 1)[-1]) for n in files}
    if wrong := [n for n, m in told.items() if m is None]:
        raise SourceError(f"not a title list: {wrong}")
    dates = {m[2] for m in told.values()}
    if len(dates) != 1:
        raise SourceError(f"{len(dates)} dates in one zip")
    try:
        day = datetime.datetime.strptime(dates.pop(), "%Y%m%d")
    except ValueError as e:
        raise SourceError("no such date") from e
    rows, seen = [], set()
    for n, m in told.items():
        for row in _entries(n, m[1], files[n]):
            if row[0] in seen:
                raise SourceError(f"{n}: {row[0]} twice")
            seen.add(row[0])
            rows.append((len(rows), *row))
    return f"{day:%Y.%m}", rows


def _main_group(symbol: str) -> int:
    return int(re.match(r".{4}([0-9]+)/", symbol)[1])


def _entries(name: str, section: str, text: str):
    above: dict[int, str] = {}  # length of a symbol above groups -> the last such symbol
    open_groups: list[tuple[int, str]] = []
    for at, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        parts = line.split("\t")
        where = f"{name}:{at}"
        if len(parts) != 3 or not parts[2].strip():
            raise SourceError(f"{where}: {len(parts)} fields")
        symbol, level, title = parts
        if not SYMBOL.fullmatch(symbol) or symbol[0] != section:
            raise SourceError(f"{where}: {symbol!r} is no symbol of section {section}")
        if "/" not in symbol:
            if level:
                raise SourceError(f"{where}: a level above groups")
            above = {k: s for k, s in above.items() if k < len(symbol)} | {len(symbol): symbol}
            parent = {1: None, 3: above.get(1), 4: above.get(3)}[len(symbol)]
            if parent is None and len(symbol) > 1 or parent and not symbol.startswith(parent):
                raise SourceError(f"{where}: nothing above {symbol}")
            open_groups = []
            yield symbol, {1: "section", 3: "class", 4: "subclass"}[len(symbol)], None, title, parent
            continue
        if not level.isdecimal():
            raise SourceError(f"{where}: level {level!r}")
        n = int(level)
        while open_groups and open_groups[-1][0] >= n:
            open_groups.pop()
        parent = open_groups[-1][1] if open_groups else above.get(4)
        if above.get(4) is None or not symbol.startswith(above[4]) or n and (not open_groups or open_groups[-1][0] != n - 1 or _main_group(symbol) - _main_group(parent) not in (0, INDEXING)):
            raise SourceError(f"{where}: nothing one level above {symbol}")
        open_groups.append((n, symbol))
        yield symbol, "subgroup" if n else "main_group", n, title, parent
