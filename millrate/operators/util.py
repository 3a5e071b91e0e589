"""Shared DataFrame helpers: schema conforming, range sizes,
and skew-safe global numbering / running sums without one-task windows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrate.schemas import JOURNAL, PARCELS
from millrate.session import cut_lineage, path_bytes

_KNOWN_TYPES = {f.name: f.dataType for f in list(PARCELS.fields) + list(JOURNAL.fields)}


def conform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Select ``columns`` in order, adding absent ones as typed NULLs."""
    out = []
    for name in columns:
        if name in df.columns:
            out.append(F.col(name).cast(_KNOWN_TYPES[name]).alias(name)
                       if name in _KNOWN_TYPES else F.col(name))
        else:
            out.append(F.lit(None).cast(_KNOWN_TYPES.get(name, "string")).alias(name))
    return df.select(*out)


#: Bytes of input for each range partition.
RANGE_BYTES = 256 * 1024 * 1024


def range_partitions(df: DataFrame) -> int:
    """Range partitions for ``df``: the session's shuffle partitions, or one per
    :data:`RANGE_BYTES` of the files it reads, if more.  (AQE merges range
    partitions but never splits them.)"""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(read_bytes(df) / RANGE_BYTES))


def read_bytes(df: DataFrame) -> int:
    """Stored bytes of the folders that ``df`` reads."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    return sum(path_bytes(df.sparkSession, f) for f in folders)


def _ranged(df: DataFrame, order: Sequence[Column | str], partitions: int | None) -> DataFrame:
    """Range-partition on the full ordering key and sort inside partitions.

    The sampled range bounds split even a single hot key across several
    partitions, so no task receives an unbounded group.  The partition id
    and in-partition position are fixed by a written table so every consumer
    sees the same assignment.
    """
    ranged = df.repartitionByRange(partitions or range_partitions(df), *order)
    ranged = ranged.sortWithinPartitions(*order)
    ranged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_mid", F.monotonically_increasing_id())
    return cut_lineage(ranged)


def global_row_number(df: DataFrame, order: Sequence[Column | str], out_col: str = "row_no",
                      partitions: int | None = None) -> DataFrame:
    """1-based position in a total order, without a single-partition window.

    Position = rows in earlier range partitions + position inside the
    partition.  The per-partition counts table has one row per partition,
    so its join is small whichever way AQE picks.
    """
    r = _ranged(df, order, partitions)
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    out = r.join(offsets, "_pid", "left").withColumn(
        out_col, F.coalesce(F.col("_off"), F.lit(0)) + local + 1)
    return out.drop("_pid", "_mid", "_off")


def running_sum(df: DataFrame, key: str, order: Sequence[str], value: str,
                out_col: str, partitions: int | None = None) -> DataFrame:
    """Per-key running total in ``order`` that stays bounded for hot keys.

    1. range-partition on (key, order) — a hot key spans several partitions;
    2. running total per (key, partition) with a window whose groups are at
       most one partition;
    3. keys that span partitions (at most partitions - 1 of them) get the
       totals of their earlier pieces added; that fix-up table is bounded
       by the partition count.
    """
    r = _ranged(df, [key, *order], partitions)
    w_local = Window.partitionBy(key, "_pid").orderBy("_mid").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = r.withColumn("_local", F.sum(value).over(w_local))
    pieces = r.groupBy(key, "_pid").agg(F.sum(value).alias("_piece"))
    spanning = pieces.groupBy(key).agg(F.count(F.lit(1)).alias("_np")).filter("_np > 1")
    fix = pieces.join(spanning.select(key), key, "left_semi")
    fix = fix.select(
        key, "_pid",
        F.sum("_piece").over(Window.partitionBy(key).orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)).alias("_before"))
    out = local.join(fix, [key, "_pid"], "left").withColumn(
        out_col, F.col("_local") + F.coalesce(F.col("_before"), F.lit(0)))
    return out.drop("_pid", "_mid", "_local", "_before")


def money_edge(df: DataFrame) -> DataFrame:
    """Cast every decimal column to double (the comparison edge)."""
    from pyspark.sql.types import DecimalType
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
        else F.col(f.name) for f in df.schema.fields])
