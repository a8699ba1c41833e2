"""Calls with a cache by canonical key, retries, repair of answers that don't fit, embeddings in batches, and the same over frames."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.gateway.prompts import GatewayError, Prompt, problems
from terrane.operators.audit import canonical_json
from terrane.sinks.versions import digest

LONGEST_WAIT = 30.0


class Again(Exception):
    """The provider may answer if asked again."""


@dataclass(frozen=True)
class Model:
    """Which model answers, where, and how it is asked. Temperature is text, as canonical JSON has no floats."""

    backend: str
    server: str
    name: str
    max_tokens: int = 1024
    temperature: str | None = "0"
    seed: int | None = 0
    batch: int = 64


def call_key(model: Model, operation: str, **asked: object) -> str:
    """The same question to the same model at the same place has the same key."""
    params = {"max_tokens": model.max_tokens, "temperature": model.temperature, "seed": model.seed} if operation != "embed" else {}
    return digest(canonical_json({"operation": operation, "backend": model.backend, "server": model.server, "model": model.name, "params": params, **asked}))


@dataclass
class Gateway:
    """``chat(system, messages, schema)`` and ``embedder(texts)`` are the clients; ``cache`` a mapping; every attempt is logged."""

    model: Model
    chat: Callable[[str, list[dict], dict | None], str] | None = None
    embedder: Callable[[list[str]], list[list[float]]] | None = None
    cache: dict[str, str] = field(default_factory=dict)
    retries: int = 3
    repairs: int = 2
    wait: Callable[[float], None] = time.sleep
    log: list[dict] = field(default_factory=list)

    def _tried(self, key: str, call: Callable[[], object]) -> object:
        for attempt in range(1, self.retries + 2):
            try:
                got = call()
            except Again as e:
                self.log.append({"key": key, "attempt": attempt, "error": str(e)})
                if attempt > self.retries:
                    raise GatewayError(f"gave up after {attempt} attempts: {e}") from e
                self.wait(min(LONGEST_WAIT, 2.0**attempt))
            else:
                self.log.append({"key": key, "attempt": attempt, "error": None})
                return got
        raise AssertionError

    def _cached(self, key: str) -> str | None:
        if (got := self.cache.get(key)) is not None:
            self.log.append({"key": key, "attempt": 0, "error": None})
        return got

    def _key(self, prompt: Prompt, system: str, user: str, schema: dict | None) -> str:
        return call_key(self.model, "text" if schema is None else "structured", prompt=[prompt.id, prompt.version, prompt.digest()], system=system, user=user, schema=schema)

    def text(self, prompt: Prompt, values: dict[str, str]) -> str:
        system, user = prompt.render(values)
        key = self._key(prompt, system, user, None)
        if (got := self._cached(key)) is None:
            got = self._tried(key, lambda: self.chat(system, [{"role": "user", "content": user}], None))
            self.cache.setdefault(key, got)
        return got

    def structured(self, prompt: Prompt, values: dict[str, str], schema: dict) -> object:
        """An answer that fits the schema; one that doesn't is sent back with what is wrong, and never cached."""
        system, user = prompt.render(values)
        key = self._key(prompt, system, user, schema)
        if (got := self._cached(key)) is not None:
            return json.loads(got)
        said, why = [{"role": "user", "content": user}], ""
        for _ in range(self.repairs + 1):
            answer = self._tried(key, lambda: self.chat(system, said, schema))  # noqa: B023
            try:
                value = json.loads(answer)
                why = "; ".join(problems(value, schema)[:5])
            except ValueError as e:
                why = f"not JSON: {e}"
            if not why:
                self.cache.setdefault(key, answer)
                return value
            self.log.append({"key": key, "attempt": 0, "error": why})
            said = [*said, {"role": "assistant", "content": answer}, {"role": "user", "content": f"That doesn't fit the schema ({why}). Answer with JSON that does and nothing else."}]
        raise GatewayError(f"no answer that fits after {self.repairs + 1}: {why}")

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text; equal texts are asked for once, what is cached not at all, the rest in batches."""
        if not texts:
            raise GatewayError("nothing to embed")
        keys = {t: call_key(self.model, "embed", text=t) for t in dict.fromkeys(texts)}
        have = {t: json.loads(v) for t, k in keys.items() if (v := self._cached(k)) is not None}
        todo = [t for t in keys if t not in have]
        for at in range(0, len(todo), self.model.batch):
            part = todo[at : at + self.model.batch]
            got = self._tried(keys[part[0]], lambda: self.embedder(part))  # noqa: B023
            if len(got) != len(part):
                raise GatewayError(f"{len(got)} vectors for {len(part)} texts")
            have |= dict(zip(part, got))
        if len(sizes := {len(v) for v in have.values()}) != 1:
            raise GatewayError(f"vectors of {sorted(sizes)} numbers")
        for t in todo:
            self.cache.setdefault(keys[t], json.dumps(have[t]))
        return [have[t] for t in texts]


def complete(rows: DataFrame, model: Model, client: Callable[[], Callable[[str], str]], cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers to ``rows`` (prompt STRING) on the executors: (prompt, key, answer), and what the cache (key, answer) has to take on.

    Each distinct prompt that isn't cached is asked once; ``client`` makes a client in each task.
    """
    head = canonical_json({"backend": model.backend, "server": model.server, "model": model.name, "seed": model.seed})
    asked = rows.where("prompt is not null").select("prompt").distinct()
    asked = asked.withColumn("key", F.sha2(F.concat_ws("\u0000", F.lit(head), "prompt"), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = client()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ask(p) for p in b.column(1).to_pylist()], pa.string())], ["key", "answer"])

    new = asked.join(cache.select("key"), "key", "left_anti").select("key", "prompt").mapInArrow(run, "key string, answer string")
    return asked, new


def answered(asked: DataFrame, cache: DataFrame) -> DataFrame:
    return asked.join(cache.select("key", "answer"), "key").select("prompt", "key", "answer")


def check_models(clients: dict[str, Callable[[], str]]) -> list[tuple[str, bool, str]]:
    """Every role is asked once; none is left out because another failed."""
    return run_checks({f"model {r}": c for r, c in clients.items()})


def run_checks(checks: dict[str, Callable[[], str | None]]) -> list[tuple[str, bool, str]]:
    """(name, passed, detail) of every check; a check that raises has failed and says why."""
    out = []
    for name, check in checks.items():
        try:
            out.append((name, True, check() or "ok"))
        except Exception as e:
            out.append((name, False, f"{type(e).__name__}: {e}"))
    return out
