"""Registered ingestion tasks, and callables that stand for a model or an embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TASKS: dict[str, Callable] = {}
DIMS = 768


def ingest_task(name: str):
    """Register a function of the session and a folder under ``name``; a second one of the name replaces the first."""

    def add(f: Callable) -> Callable:
        TASKS[name] = f
        return f

    return add


def run_tasks(spark: SparkSession, folder: str, names: list[str] | None = None, threads: int = 4) -> list[tuple[str, int | None, str | None]]:
    """``(task, result, error)`` of the tasks, run side by side; a failing task fails alone."""

    def one(name: str):
        try:
            return name, TASKS[name](spark, folder), None
        except Exception as e:  # noqa: BLE001  reported, not raised
            return name, None, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(one, sorted(names or TASKS)))


def answered(rows: DataFrame, prompt: str, out: str, transport: Callable[[list[str]], list[str]]) -> DataFrame:
    """Rows with what ``transport`` answers to their prompts, an Arrow batch at a time; null prompts get null."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            some = x[prompt].notna()
            answer = pd.Series([None] * len(x), index=x.index, dtype=object)
            if some.any():
                answer[some] = transport(x.loc[some, prompt].tolist())
            yield x.assign(**{out: answer})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` string"
    return rows.mapInPandas(run, schema)


def hashed_vector(text: str | None, dims: int = DIMS) -> np.ndarray:
    """Signed counts of words by hash, of length 1; all zero for a text without words."""
    v = np.zeros(dims)
    for w in (text or "").lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dims] += 1 if h >> 63 else -1
    if text and text.split() and not v.any():
        v[0] = 1.0
    n = np.linalg.norm(v)
    return v / n if n else v


def embedded(rows: DataFrame, text: str, out: str, model: Callable[[str], np.ndarray] = hashed_vector, dims: int = DIMS) -> DataFrame:
    """Rows with the vector that ``model`` gives for ``text``; a zero vector where it fails or has another length."""

    def one(t: str) -> list[float]:
        try:
            v = np.asarray(model(t), float)
            return v.tolist() if v.shape == (dims,) else [0.0] * dims
        except Exception:  # noqa: BLE001  a text that cannot be embedded has no direction
            return [0.0] * dims

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            yield x.assign(**{out: [one(t) for t in x[text]]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` array<double>"
    return rows.mapInPandas(run, schema)
