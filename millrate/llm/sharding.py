"""Sharding by a permutation-filled lookup table (operator 10).

Every shard has a preference order over the slots of a prime-sized table (an
offset and a step from md5 of its name; a prime size makes it a permutation).
Shards take turns claiming their next free slot until the table is full.  A
document's key is hashed to a slot, and the broadcast table gives its shard.
Adding or removing a shard moves few other keys.

The table has ``size`` rows whatever the input, which bounds both the filling
on the driver and the broadcast; documents only pass DataFrame functions.

Defined results: the key is the id's decimal text; a row without an id is
placed by its text, one without either by the empty text.  Repeated rows get
the same shard; an empty table gives no rows; other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters of the registered query: about 100 slots a shard.
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))
SIZE = 6421


def _number(text: str, part: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[part * 15:part * 15 + 15], 16)


def lookup_table(shards: Sequence[str] = SHARDS, size: int = SIZE) -> list[int]:
    """The shard's index for each slot."""
    if size < 2 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table's size must be prime")
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("give distinct shard names, no more than slots")
    at = [_number(s, 0) % size for s in shards]
    step = [_number(s, 1) % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        k = turn % len(shards)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % size
        owner[at[k]] = k
    return owner


def table_frame(spark: SparkSession, shards: Sequence[str] = SHARDS, size: int = SIZE) -> DataFrame:
    """(slot, shard): one row per slot."""
    names = json.dumps([shards[k] for k in lookup_table(shards, size)])
    return spark.range(1).select(
        F.posexplode(F.from_json(F.lit(names), "array<string>")).alias("slot", "shard"))


def slot_of(id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> Column:
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).cast("binary"))
    return (F.conv(F.substring(key, 1, 15), 16, 10).cast("long") % size).cast("int")


def place(docs: DataFrame, shards: Sequence[str] = SHARDS, size: int = SIZE) -> DataFrame:
    """``docs`` with its ``slot`` and ``shard`` (replacing such columns)."""
    table = table_frame(docs.sparkSession, shards, size)
    keyed = docs.drop("slot", "shard").withColumn("slot", slot_of(size=size))
    return keyed.join(F.broadcast(table), "slot").select(
        *[c for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(docs: DataFrame, path: str, files_per_shard: int = 8, **table) -> None:
    """One folder per shard, each written by ``files_per_shard`` tasks."""
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files_per_shard))
    (place(docs, **table).repartition("shard", part)
     .write.partitionBy("shard").parquet(path))
