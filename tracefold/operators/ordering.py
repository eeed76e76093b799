"""Ordered and keyed work on groups of any size.

A task, project or target may hold a large share of all rows, so no operator may
sort a whole group in one Spark task. The helpers here cut each group into slices
that follow the row order (usually time), do the ordered work inside a slice, and
carry the small per-slice summary across slices. The big side is shuffled once, on
(keys, slice); only the summaries are shuffled on the keys alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import constants as K
from tracefold.functions.columns import SEP, floor_div
from tracefold.sources.sinks import stored

DEFAULT_SLICE_NS = K.NS_PER_SECOND
HOT_PARTS = 10_000
HOT_ROWS = 1_000_000
DIGEST_FANOUT = 100
#: Block lengths of ``range_members`` where ranges of any length occur.
RANGE_SIZES = (1, 8, 64, 512, 4096)


def fitting_slice_ns(events: DataFrame, key: str = "project_id",
                     rows_per_slice: int = 1_000_000) -> int:
    """Slice width under which no (key, slice) holds many more rows than the bound.

    One partial aggregate, one number back. A second dense enough to exceed the bound
    narrows the slices in proportion; the default width is kept otherwise.
    """
    densest = events.groupBy(key, time_slice()).agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n")).first()[0] or 0
    return max(1, DEFAULT_SLICE_NS // max(1, -(-densest // rows_per_slice)))


def time_slice(ns: str = "timestamp_ns", width_ns: int = DEFAULT_SLICE_NS) -> Column:
    return floor_div(F.col(ns), width_ns)


def sliced(
    df: DataFrame,
    keys: Sequence[str],
    slices: Sequence[Column],
    order: Sequence[str],
    running: Mapping[str, Column],
    previous: Mapping[str, Column] | None = None,
    totals: Mapping[str, str] | None = None,
    keep: Column | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Exact running sums and previous-row values per group.

    ``slices`` are columns that never decrease along ``order`` inside a group.
    ``running`` maps an output name to a number summed up to and including the row;
    ``previous`` maps an output name to an expression read from the row before;
    ``totals`` maps an output name to the running sum whose group total it takes;
    ``keep`` filters groups by those totals before the rows are shuffled;
    ``groups`` (one row per kept group) is joined to the summaries, so filtering and
    decorating groups never touches the hot key of the big side.
    """
    previous = previous or {}
    totals = totals or {}
    names = [f"_slice{i}" for i in range(len(slices))]
    cut = df.withColumns(dict(zip(names, slices, strict=True)))
    last = [F.struct(*(e.alias(n) for n, e in previous.items()))] if previous else []
    summary = cut.groupBy(*keys, *names).agg(
        *(F.sum(e).alias(f"_sum_{n}") for n, e in running.items()),
        *(F.max_by(s, F.struct(*order)).alias("_last") for s in last),
    )
    if groups is not None:
        summary = summary.join(groups, list(keys))
    across = Window.partitionBy(*keys).orderBy(*names)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = {
        f"_before_{n}": F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)) for n in running
    }
    carried |= {t: F.sum(f"_sum_{n}").over(Window.partitionBy(*keys)) for t, n in totals.items()}
    if previous:
        carried["_carry"] = F.lag("_last").over(across)
    summary = summary.withColumns(carried).drop(*(f"_sum_{n}" for n in running), "_last")
    if keep is not None:
        summary = summary.where(keep)
    rows = cut.join(summary, [*keys, *names])
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.col(f"_before_{n}") + F.sum(e).over(upto) for n, e in running.items()}
    first = F.row_number().over(inside) == 1
    for n, e in previous.items():
        out[n] = F.when(first, F.col(f"_carry.{n}")).otherwise(F.lag(e).over(inside))
    return rows.withColumns(out).drop(*names, *(f"_before_{n}" for n in running), "_carry")


def split_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
               rows_per_cell: int = HOT_ROWS) -> DataFrame:
    """Exact 1-based rank of every row within its group, however large a group is.

    The rows are dealt into ranges of (keys, order) by sampled splitters, so cells hold about as
    many rows each even if all rows are one group. A cell ranks its own rows, and a group's
    cells before it say where it starts. ``order`` has to tell all rows of a group apart.
    """
    cells = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-df.count() // rows_per_cell))
    cut = stored(df.repartitionByRange(cells, *keys, *order).withColumn(
        "_cell", F.spark_partition_id()), "cells")
    # a window over cells, of which there are few even where all rows are one group
    across = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_rows")).withColumn(
        "_before", F.coalesce(F.sum("_rows").over(across), F.lit(0))).drop("_rows")
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    ranked = cut.withColumn("_nth", F.row_number().over(inside))
    # a row a cell and group: small against the rows, and met by key equality with null keys
    same = F.col("r._cell") == F.col("s._cell")
    for key in keys:
        same = same & F.col(f"r.{key}").eqNullSafe(F.col(f"s.{key}"))
    joined = ranked.alias("r").join(starts.alias("s"), same)
    return joined.select("r.*", (F.col("s._before") + F.col("r._nth")).alias(name)).drop(
        "_cell", "_nth")


def blocked(df: DataFrame, position: str, size: int, ahead: int = 0) -> DataFrame:
    """Cut 1-based ``position`` into blocks of ``size`` rows plus ``ahead`` halo rows.

    A row near the start of a block is copied to the block before it, flagged
    ``halo``, so a window over (keys, block) can look ``ahead`` rows further.
    """
    zero = F.col(position) - 1
    own = floor_div(zero, size)
    if ahead == 0:
        return df.withColumns({"block": own, "halo": F.lit(False)})
    near = (F.pmod(zero, F.lit(size)) < ahead) & (own > 0)
    copies = F.when(near, F.array(F.struct(own.alias("block"), F.lit(False).alias("halo")),
                                  F.struct((own - 1).alias("block"), F.lit(True).alias("halo")))
                    ).otherwise(F.array(F.struct(own.alias("block"), F.lit(False).alias("halo"))))
    return df.withColumn("_copy", F.explode(copies)).select("*", "_copy.*").drop("_copy")


def range_members(ranges: DataFrame, rows: DataFrame, keys: Sequence[str], position: str,
                  sizes: Sequence[int] = RANGE_SIZES) -> DataFrame:
    """Join each [first_pos, last_pos] range to the rows whose position lies in it.

    Every range is cut into position blocks of the largest of ``sizes`` that is no longer
    than the range, and every row stands once at each size. Blocks at the ends reach past a
    range by less than its length on either side, so fewer than three rows are joined for
    each one that stays (positions are gapless). One size is enough for one range a group.
    """
    length = F.col("last_pos") - F.col("first_pos") + 1
    size = F.lit(min(sizes))
    for larger in sorted(sizes)[1:]:
        size = F.when(length >= larger, F.lit(larger)).otherwise(size)
    left = ranges.where(F.col("last_pos") >= F.col("first_pos")).withColumn(
        "_size", size).withColumn("_block", F.explode(F.sequence(
            floor_div(F.col("first_pos"), F.col("_size")),
            floor_div(F.col("last_pos"), F.col("_size")))))
    right = rows.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)))).withColumn(
        "_block", floor_div(F.col(position), F.col("_size")))
    return left.join(right, [*keys, "_size", "_block"]).where(
        F.col(position).between(F.col("first_pos"), F.col("last_pos"))
    ).drop("_size", "_block")


def hot_keys(df: DataFrame, on: Sequence[str], parts: int = HOT_PARTS,
             min_rows: int = HOT_ROWS) -> DataFrame:
    """Keys holding more than 1/``parts`` of all rows, with the salts each one needs.

    There can be at most ``parts`` such keys whatever the input, which is the proven
    bound that lets ``salted_join`` broadcast them. Keys are counted with a partial
    aggregate over the key columns only.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    share = F.col("_n") * parts / total
    return counts.where((F.col("_n") > min_rows) & (share > 1)).select(
        *on, F.ceil(share).cast("int").alias("_salts"))


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], row_id: Column,
                how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join a table with hot (or null) keys to one keyed by ``on``.

    A hot key is spread over as many salts as keep each one near 1/``HOT_PARTS`` of
    the rows, and only its rows of the small side are repeated; null keys, which match
    nothing, are spread as well. ``big`` is read twice, so it should be a stored table. ``hot`` may come from a cheaper view of the same
    rows. Only the bounded hot-key list is broadcast; for the join itself adaptive
    execution broadcasts the small side when its measured size allows.
    """
    marked = F.broadcast(hot_keys(big, on) if hot is None else hot)
    absent = F.lit(False)
    for key in on:
        absent = absent | F.col(key).isNull()
    spread = F.when(absent, F.lit(HOT_PARTS)).otherwise(F.coalesce("_salts", F.lit(1)))
    left = big.join(marked, list(on), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(row_id), spread).cast("int")).drop("_salts")
    right = small.join(marked, list(on), "left").withColumn("_salt", F.explode(
        F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def ordered_digest(members: DataFrame, key: str, ordinal: str = "ordinal",
                   value: str = "event_id", fanout: int = DIGEST_FANOUT) -> DataFrame:
    """Digest of each group's ordered members, by one rule for every size.

    The members are hashed as a tree of ``fanout``-wide nodes until one node is left, so no
    row ever holds more than ``fanout`` members however large the group is. The height is
    that of the largest group; smaller groups keep their root. ``members`` is a stored
    table with the size of its group in ``member_count``.
    """
    def digest(index: str, text: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct(index, text)))
        return F.sha2(F.array_join(F.transform(pairs, lambda p: p[text]), SEP), 256)

    size = F.max("member_count").alias("member_count")
    largest = members.agg(size).first()[0] or 0
    nodes = members.withColumn("_node", floor_div(F.col(ordinal) - 1, fanout)).groupBy(
        key, "_node").agg(digest(ordinal, value).alias("members_text"), size)
    held = fanout
    while held < largest:
        root = F.max("member_count") <= held
        nodes = nodes.withColumn("_up", floor_div(F.col("_node"), fanout)).groupBy(
            key, "_up").agg(F.when(root, F.min("members_text")).otherwise(
                digest("_node", "members_text")).alias("members_text"), size
            ).withColumnRenamed("_up", "_node")
        held *= fanout
    return nodes.select(key, "members_text")
