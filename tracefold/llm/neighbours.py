"""Approximate nearest neighbours: a forest of hash prefixes.

Every tree gives a vector a long string of hyperplane signs and keeps the strings sorted. A
query descends in every tree to its longest matching prefix; the trees are then ascended
together, one prefix length at a time, until enough vectors share that prefix with the query
in some tree. All of those, without a limit, are ranked by inner product.

Largest inner products become nearest angles by one more coordinate, which lifts all vectors
to the largest length. Equal vectors count as one in the forest and are told apart again in
the result. Sorted arrays are dealt to tasks by tree and leading bits; crowded ones are split
further, for vectors and queries alike. A query with too few vectors under its leading bits
goes up to the root of one tree and meets all of it.

Vectors that are null, empty, zero or hold null or non-finite components take no part; nor do
those of another dimension than most. Of rows with the same id, the smallest vector counts.
A null id takes no part. Other columns are not used; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm import common as C
from tracefold.sources.sinks import stored

TREES, BITS, SEED = 32, 40, 404
#: An ascent collects at least this share of the vectors, counted once a tree, so that recall
#: is alike at every size. Vectors that lie almost at random need this much for a recall of
#: 0.9 of the nearest 20; clustered ones need far less.
SHARE = 0.75
#: Vectors under one set of leading bits, about, and queries, that a task holds at once.
ARRAY_ROWS, QUERY_ROWS = 8192, 4096

_KEYS = ["tree", "lead", "part", "ask"]


def valid_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (array<double>) of the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + 0.0)
    sound = rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)
                                           & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    once = sound.groupBy("id").agg(F.min("v").alias("v"))
    return once


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((TREES * BITS, dim + 1))


def _strings(v: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """[n, TREES] hash strings as integers, first sign in the highest bit."""
    planes = _planes(v.shape[1])
    signs = (np.column_stack([v, extra]) @ planes.T > 0).reshape(len(v), TREES, BITS)
    return signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _in_trees(rows: DataFrame, longest: float, lead: int, lift: bool) -> DataFrame:
    """One row per tree: tree, lead (leading bits), string and the columns id, v."""
    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in C.chunks(len(part), 1000):
                some = part.iloc[at]
                v = np.stack(some["v"].to_numpy())
                room = np.maximum(longest ** 2 - (v * v).sum(axis=1), 0.0)
                strings = _strings(v, np.sqrt(room) if lift else np.zeros(len(v)))
                for tree in range(TREES):
                    yield pd.DataFrame({
                        "tree": tree, "lead": strings[:, tree] >> (BITS - lead),
                        "string": strings[:, tree], "id": some["id"].to_numpy(),
                        "v": some["v"].to_numpy()})

    return rows.select("id", "v").mapInPandas(
        spread, "tree int, lead long, string long, id long, v array<double>")


def _ranges(sorted_strings: np.ndarray, strings: np.ndarray, depth: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that share the first ``depth`` bits with each query stand."""
    shift = BITS - depth
    low = strings >> shift << shift
    return (np.searchsorted(sorted_strings, low, "left"),
            np.searchsorted(sorted_strings, low + (np.int64(1) << shift), "left"))


def _route(index: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Arrays and queries dealt to the same groups; crowded groups in parts."""
    sizes = stored(index.groupBy("tree", "lead").count().withColumn(
        "parts", F.ceil(F.col("count") / ARRAY_ROWS).cast("int")).drop("count"), "arrays")
    asks = asked.groupBy("tree", "lead").agg(
        F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("asks"))
    plan = stored(sizes.join(asks, ["tree", "lead"]), "routes")
    spot: Column = F.pmod(F.xxhash64("id", "tree"), F.col("parts")).cast("int")
    dealt = index.join(plan, ["tree", "lead"]).withColumn("part", spot).withColumn(
        "ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).select(
        *_KEYS, "string", "id", "v")
    where = F.pmod(F.xxhash64("id", F.lit(1)), F.col("asks")).cast("int")
    questions = asked.join(plan, ["tree", "lead"]).withColumn("ask", where).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *_KEYS, "string", "id", "v", *[c for c in asked.columns if c == "depth"])
    return dealt, questions, sizes


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k best places, larger score first, then smaller id."""
    if len(scores) > 4 * k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bound)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def nearest(rows: DataFrame, queries: Column, k: int = 20, key: str = "vec_id",
            vector: str = "embedding", share: float = SHARE) -> DataFrame:
    """query_id, rank, ``key``, score: the k nearest found of every row with ``queries``."""
    spark = rows.sparkSession
    sound = stored(valid_vectors(rows, key, vector), "vectors")
    dims = sound.groupBy(F.size("v").alias("dim")).count().orderBy(
        F.desc("count"), F.desc("dim")).first()
    empty = spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    if dims is None:
        return empty
    sound = sound.where(F.size("v") == dims["dim"])
    # a class of equal vectors is named by its smallest id; k + 1 members are enough of it
    order = Window.partitionBy("v").orderBy("id")
    members = stored(sound.withColumn("nth", F.row_number().over(order)).where(
        F.col("nth") <= k + 1), "members")
    classes = members.where(F.col("nth") == 1).select("id", "v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    facts = classes.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
    candidates = max(10 * k, int(np.ceil(share * facts["n"])))
    # leading bits that tasks are dealt by: short enough for the ascent to end below them
    lead = int(np.clip(np.log2(max(1, facts["n"]) / ARRAY_ROWS), 0,
                       max(0.0, np.log2(0.5 * TREES / max(share, 1e-9)))))
    lead = min(lead, BITS - 1)
    index = stored(_in_trees(classes, facts["longest"], lead, True), "forest")
    asking = sound.withColumn(key, F.col("id")).where(queries).select("id", "v")
    asked = stored(_in_trees(asking, facts["longest"], lead, False), "questions")
    depths = list(range(lead, BITS + 1))

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"id": right["id"].to_numpy()}
        ordered, strings = np.sort(left["string"].to_numpy()), right["string"].to_numpy()
        for d in depths:
            low, high = _ranges(ordered, strings, np.full(len(strings), d))
            out[f"d{d}"] = high - low
        return pd.DataFrame(out)

    dealt, questions, sizes = _route(index, asked)
    counted = questions.groupBy(*_KEYS).cogroup(dealt.groupBy(*_KEYS)).applyInPandas(
        lambda right, left: count(left, right),
        "id long, " + ", ".join(f"d{d} long" for d in depths))
    summed = counted.groupBy("id").agg(*(F.sum(f"d{d}").alias(f"d{d}") for d in depths))
    depth = F.coalesce(*(F.when(F.col(f"d{d}") >= candidates, d) for d in reversed(depths)))
    reached = stored(asking.select("id").join(summed, "id", "left").select(
        "id", depth.alias("depth")), "depths")
    going = asked.join(reached.where("depth IS NOT NULL"), "id")
    # too few under the leading bits: up to the root of the first tree, which holds everything
    rest = asked.where("tree = 0").drop("lead").join(reached.where("depth IS NULL").select(
        "id"), "id").withColumn("depth", F.lit(0)).join(
        sizes.where("tree = 0").select("lead"), how="cross")
    going = going.select("tree", "lead", "string", "id", "v", "depth").unionByName(
        rest.select("tree", "lead", "string", "id", "v", "depth"))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": np.array([], np.int64), "id": np.array(
                [], np.int64), "score": np.array([], float)})
        left = left.sort_values("string", kind="stable")
        ids, vectors = left["id"].to_numpy(), np.stack(left["v"].to_numpy())
        low, high = _ranges(left["string"].to_numpy(), right["string"].to_numpy(),
                            right["depth"].to_numpy().astype(np.int64))
        out = []
        for query, v, a, b in zip(right["id"], right["v"], low, high, strict=True):
            if a == b:
                continue
            scores = (vectors[a:b] * v).sum(axis=1)
            best = _best(scores, ids[a:b], k + 1)
            out.append(pd.DataFrame({"query_id": query, "id": ids[a:b][best],
                                     "score": scores[best]}))
        return pd.concat(out)[names] if out else rank(left.iloc[:0], right)

    dealt, questions, _ = _route(index, going)
    found = questions.groupBy(*_KEYS).cogroup(dealt.groupBy(*_KEYS)).applyInPandas(
        lambda right, left: rank(left, right), "query_id long, id long, score double")
    unique = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    nearness = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = unique.withColumn("n", F.row_number().over(nearness)).where(F.col("n") <= k + 1)
    twins = members.select("v", F.col("id").alias("member")).join(
        classes.withColumnRenamed("id", "class_id"), "v").select("class_id", "member")
    spread = top.join(twins, F.col("id") == F.col("class_id")).where(
        F.col("member") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "member")
    return spread.withColumn("rank", F.row_number().over(final)).where(
        F.col("rank") <= k).select("query_id", "rank", F.col("member").alias(key), "score")



@C.query("op1_neighbours")
def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
