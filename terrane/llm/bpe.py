"""Byte-level BPE over the whole corpus, merges driven by a segment tree.

The tree's leaves are the ranks of adjacent pairs; its root tells the leftmost pair of lowest rank. A merge
changes at most three leaves, so each costs a logarithmic number of updates, until no pair has a rank.

Defined results: null and empty texts have no ids (an empty list); texts of any length are encoded whole;
strings that look like special tokens are ordinary text; a repeated doc_id gives a row each time.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terrane.runtime import ship

TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the published splitting pattern of this tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 60
MEMORY = 200_000
_SENT: set[tuple[str, str]] = set()


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    out = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


def merged(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    if n == 1:
        return [rank[piece]]
    size = 1
    while size < n - 1:
        size *= 2
    get = rank.get
    # Each node holds rank * n + position, so the least value is the leftmost of the lowest rank.
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            x, y = tree[2 * k], tree[2 * k + 1]
            least = x if x < y else y
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while tree[1] != NONE:
        i = tree[1] % n
        j = after[i]
        parts[i] += parts[j]
        parts[j] = None
        nxt = after[j]
        after[i] = nxt
        if j < n - 1:
            put(j, NONE)
        if nxt < n:
            before[nxt] = i
            r = get(parts[i] + parts[nxt])
            put(i, NONE if r is None else r * n + i)
        else:
            put(i, NONE)
        p = before[i]
        if p >= 0:
            r = get(parts[p] + parts[i])
            put(p, NONE if r is None else r * n + p)
    return [rank[x] for x in parts if x is not None]


class Encoder:
    """Text to ids; pre-tokens seen before are remembered, up to a bounded number."""

    def __init__(self, path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"):
        import regex

        self.rank, self.split = ranks(path), regex.compile(PATTERN)
        self.memory: dict[str, list[int]] = {}

    def pieces(self, text: str) -> Iterator[list[int]]:
        """Ids of each pre-token of a text."""
        memory = self.memory
        for piece in self.split.findall(text):
            ids = memory.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                whole = self.rank.get(raw)
                ids = [whole] if whole is not None else merged(raw, self.rank)
                if len(memory) >= MEMORY:
                    memory.clear()
                if len(piece) <= 64:
                    memory[piece] = ids
            yield ids

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.pieces(text) for i in ids] if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text))) if text else 0


def encoder(spark: SparkSession, folder: str | None = None, name: str = "byte_bpe_50k") -> Callable[[], Encoder]:
    """How an executor makes an encoder: the driver's vocabulary file goes to the executors with the application."""
    ship(spark)
    path = str(Path(folder or TOKENIZER_DIR) / f"{name}.tiktoken")
    if (known := (spark.sparkContext.applicationId, path)) not in _SENT:
        spark.sparkContext.addFile(path)
        _SENT.add(known)

    def make() -> Encoder:
        from pyspark import SparkFiles

        return Encoder(SparkFiles.get(f"{name}.tiktoken"))

    return make


def encode_corpus(documents: DataFrame, folder: str | None = None, name: str = "byte_bpe_50k") -> DataFrame:
    """p7_ids: doc_id and ids of every text."""
    made = encoder(documents.sparkSession, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = made()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = pa.array([enc.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), ids], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")
