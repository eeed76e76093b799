"""Sharding by a hypergeometric communication matrix.

A uniform shuffle into shards of exact sizes: for every input part, how many of its rows
go to every shard is drawn from the multivariate hypergeometric law given what earlier
parts left free; rows are permuted inside their part, dealt by those counts, exchanged and
permuted again inside their shard.

Sizes differ by one row at most (law ``rows``). A null text counts no bytes. Repeated rows
are dealt separately; an empty table gives an empty result; columns other than doc_id and
text are not used. Random choices come from hashes of stored row positions and a seed, so a
task that runs again makes the same ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm import common as C
from tracefold.sources.sinks import stored

SHARDS, SEED = 24, 20_240
#: Rows, about, that one task orders in a shard.
BLOCK_ROWS = 50_000
LEAST_BLOCKS = 16
#: Population from which on numpy has no hypergeometric sampler.
SAMPLER_LIMIT = 1_000_000_000


def matrix(part_rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of each part that go to each shard; columns sum to the exact shard sizes."""
    total = sum(part_rows)
    free = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(part_rows), shards), np.int64)
    for i, n in enumerate(part_rows):
        out[i] = _draw(rng, free, n)
        free -= out[i]
    return out


def hypergeometric(rng: np.random.Generator, have: int, rest: int, n: int) -> int:
    """How many of ``n`` rows drawn from ``have`` + ``rest`` are of the first kind, exactly.

    Beyond the range of numpy's sampler the law is inverted: the weights of the values around
    the mode follow from each other by their exact ratios, and those left out are below 1e-30.
    """
    total = have + rest
    if total < SAMPLER_LIMIT:
        return int(rng.hypergeometric(have, rest, n))
    low, high = max(0, n - rest), min(n, have)
    mode = min(max((n + 1) * (have + 1) // (total + 2), low), high)
    spread = np.sqrt(n * (have / total) * (rest / total) * ((total - n) / (total - 1)))
    reach = int(12 * spread) + 60
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    above = np.cumprod((have - up) / (up + 1) * ((n - up) / (rest - n + up + 1)))
    below = np.cumprod(down / (have - down + 1) * ((rest - n + down) / (n - down + 1)))
    weights = np.concatenate([below[::-1], [1.0], above]).cumsum()
    at = int(np.searchsorted(weights, rng.random() * weights[-1], "right"))
    return mode - len(down) + min(at, len(weights) - 1)


def _draw(rng: np.random.Generator, free: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric row from its marginals (any population size)."""
    out = np.zeros_like(free)
    rest = int(free.sum())
    for s, have in enumerate(free.tolist()):
        rest -= have
        if n <= 0:
            break
        k = hypergeometric(rng, have, rest, n) if rest else n
        out[s], n = k, n - k
    return out


def shard_rows(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` (narrow columns) with shard and slot, gapless from 0 in every shard."""
    spark = rows.sparkSession
    columns = rows.columns
    placed = stored(rows.withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id()), "shard-rows")
    sizes = placed.groupBy("_part").count().orderBy("_part").collect()
    if not sizes:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).where("false")
    counts = matrix([r["count"] for r in sizes], shards, seed)
    ends = spark.createDataFrame(
        [(r["_part"], row.cumsum().tolist()) for r, row in zip(sizes, counts, strict=True)],
        "_part int, _ends array<long>")
    inside = Window.partitionBy("_part").orderBy(F.xxhash64("_at", F.lit(seed)), "_at")
    dealt = placed.withColumn("_rank", F.row_number().over(inside)).join(ends, "_part").withColumn(
        "shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
    total = int(counts.sum())
    blocks = max(LEAST_BLOCKS, -(-total // (shards * BLOCK_ROWS)))
    # the second permutation orders a shard by one hash: its high part is the block
    draw = F.pmod(F.xxhash64("_at", F.lit(seed + 1)), F.lit(1 << 40))
    dealt = stored(dealt.select(*columns, "shard", "_at", draw.alias("_draw")).withColumn(
        "_block", (F.col("_draw") * blocks / F.lit(1 << 40)).cast("int")), "shard-dealt")
    per_block = dealt.groupBy("shard", "_block").count()
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = per_block.select("shard", "_block", F.coalesce(
        F.sum("count").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("shard", "_block").orderBy("_draw", "_at")
    return dealt.withColumn("_n", F.row_number().over(order)).join(
        starts, ["shard", "_block"]).select(
        *columns, "shard", (F.col("_start") + F.col("_n") - 1).cast("long").alias("slot"))


@C.query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = C.table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    return shard_rows(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
