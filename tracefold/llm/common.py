"""Helpers shared by the operators: tables, samples, hashed text features, registration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can express it."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The quarter of the rows that no model may learn from (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A pseudo-random number in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def training_sample(docs: DataFrame, labels: DataFrame, bound: int, seed: int = 7) -> DataFrame:
    """About ``bound`` labelled texts at most, chosen by a hash of their id.

    ``labels`` has doc_id and the label columns. A repeated id counts once (largest
    labels, smallest text); rows without id, text or label are left out.
    """
    names = [c for c in labels.columns if c != "doc_id"]
    known = labels.dropna().groupBy("doc_id").agg(*(F.max(c).alias(c) for c in names))
    share = bound / max(1, known.count())
    chosen = known.where(unit_hash(F.col("doc_id"), seed=seed) < share)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(
        F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(chosen, "doc_id")


def chunks(n: int, size: int) -> Iterator[slice]:
    for at in range(0, n, size):
        yield slice(at, min(n, at + size))


def gram_counts(codes: np.ndarray, n: int, dim: int) -> np.ndarray:
    """Counts of the hashed n-grams of a code sequence; ``dim`` is a power of two."""
    if len(codes) < n:
        return np.zeros(dim, np.float32)
    mixed = np.full(len(codes) - n + 1, n, np.uint64)
    for j in range(n):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += codes[j:len(codes) - n + 1 + j]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    at = (mixed >> np.uint64(64 - dim.bit_length() + 1)).astype(np.int64)
    return np.bincount(at, minlength=dim).astype(np.float32)


def unit_rows(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts, each row scaled to length one (a zero row stays)."""
    roots = np.sqrt(counts)
    return roots / np.maximum(np.linalg.norm(roots, axis=1, keepdims=True), 1e-12)


def collected(sample: DataFrame, features: Callable[[str], np.ndarray],
              labels: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Feature counts of a bounded sample, computed by the tasks, on the driver."""
    import pandas as pd

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({
                "doc_id": part["doc_id"],
                "counts": [features(t).astype(np.float16).tobytes() for t in part["text"]],
                **{c: part[c] for c in labels}})

    kinds = dict(sample.dtypes)
    found = sample.mapInPandas(
        rows, "doc_id long, counts binary, " + ", ".join(f"{c} {kinds[c]}" for c in labels)
    ).toPandas().sort_values("doc_id")
    if found.empty:
        return np.zeros((0, 0), np.float32), [np.array([]) for _ in labels]
    matrix = np.stack([np.frombuffer(b, np.float16) for b in found["counts"]])
    return matrix.astype(np.float32), [found[c].to_numpy() for c in labels]
