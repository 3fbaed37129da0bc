"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: from an
offset in steps of a skip, both hashed from the shard's name. The shards take
turns, each claiming the first free slot of its order, so that their shares
differ by at most one slot, and adding or removing a shard moves little else.
A document goes to the shard in the slot that its key hashes to.

The table has ``SLOTS`` rows whatever the corpus, so it may always be broadcast;
placement is one hash and one lookup a row, without a shuffle of the documents.

Defined results: equal keys, in any number of rows, share a shard; a null key
counts as the empty string. Texts, of whatever length, are not looked at. Columns
other than the key pass through, whatever their names, except that one of the
result's name is replaced. An empty table stays empty.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from glyphwell.session import free_names

SHARDS = 256
#: A prime, well over 100 times the shards, so that shares are even.
SLOTS = 65_537
#: Rows that one task of ``write_shards`` writes.
FILE_ROWS = 1_000_000


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """The index into ``names`` of each slot's shard. ``slots`` is a prime."""
    if not names or len(names) > slots or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards, of which there must be one")
    at = [_number(f"offset/{n}") % slots for n in names]
    skip = [_number(f"skip/{n}") % (slots - 1) + 1 for n in names]
    table, free = [-1] * slots, slots
    while True:
        for k in range(len(names)):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + skip[k]) % slots
            table[slot], at[k] = k, (slot + skip[k]) % slots
            free -= 1
            if not free:
                return table


def shard_names(shards: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(shards)]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: its MD5's first 60 bits modulo the size of the table."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % slots


def place(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS, name: str = "shard") -> DataFrame:
    """``df`` and the INT column ``name`` with each row's shard, replacing one of that name."""
    slot, taken = free_names(df, "slot", "slot_shard")
    spark = df.sparkSession
    filled = ",".join(map(str, fill(shard_names(shards), slots)))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",").cast("array<int>")).alias(slot, taken))
    placed = df.withColumn(slot, slot_of(df[key], slots).cast("int")).join(F.broadcast(table), slot)
    others = [c for c in df.columns if c.lower() != name.lower()]
    return placed.select(*(F.col(f"`{c}`") for c in others), F.col(taken).alias(name))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS, file_rows: int = FILE_ROWS) -> None:
    """``df`` as Parquet with a folder for each shard, in one shuffle.

    A shard's rows are dealt to as many tasks as the largest shard asks for at
    ``file_rows`` rows each, by their place in the input, so neither a large shard
    nor a key that holds a third of all rows is one task.
    """
    placed = place(df, key, shards)
    largest = placed.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    turn, *_ = free_names(placed, "turn")
    files = -(-largest // file_rows)
    dealt = placed.withColumn(turn, F.monotonically_increasing_id() % files)
    dealt.repartition(shards * files, "shard", turn).drop(turn).write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"))


ORACLE = f"""
    SELECT doc_id, CAST([{",".join(map(str, fill(shard_names(SHARDS))))}][1 + CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS}] AS INTEGER) AS shard
    FROM documents
"""
