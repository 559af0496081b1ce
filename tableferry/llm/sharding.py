"""Shards by jump consistent hashing of stable keys; native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableferry.llm.common import ranked

#: Fixed value of the published generator (Lamping and Veach).
MULTIPLIER = 2862933555777941757


def _decimal(value: int, digits: int) -> Column:
    return F.lit(str(value)).cast(f"decimal({digits},0)")


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0 to ``shards`` - 1, of a 64-bit key (read as unsigned).

    Adding a shard moves about one key in ``shards`` + 1, and only into the new shard.
    A key jumps from shard to ever higher shard; as each jump goes up by one at least,
    ``shards`` steps are enough, and steps after the last jump cost nothing. Products of
    64-bit numbers are taken as decimals, because Spark's longs refuse to wrap around.
    NULL stays NULL.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    word, top = _decimal(1 << 64, 20), _decimal(1 << 33, 10)
    signed = key.cast("decimal(20,0)")
    unsigned = F.when(key < 0, signed + word).otherwise(signed).cast("decimal(20,0)")
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), unsigned.alias("k"))

    def step(state: Column, _: Column) -> Column:
        following = ((state["k"] * _decimal(MULTIPLIER, 19) + 1) % word).cast("decimal(20,0)")
        high = ((following - following % top) / top).cast("double")
        jump = F.floor((state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1.0))).cast("long")
        moved = F.struct(state["j"].alias("b"), jump.alias("j"), following.alias("k"))
        return F.when(state["j"] < shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def shard(df: DataFrame, key: str, shards: int, into: str = "shard") -> DataFrame:
    """``df`` with the shard of each row by a hash of ``key``; a map without a shuffle.

    Equal keys share a shard. NULL is a key of its own.
    """
    return df.withColumn(into, jump_hash(F.xxhash64(key), shards))


def sharded(df: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """Shard, place in it, size and checksum of each row, and its shard with one more.

    Returns ``key``, ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32``, ``law``
    ('key'), ``shard``, ``slot`` (gapless from 0 in its shard) and ``grown_shard``.
    Repeated rows each get a slot; NULL and empty texts have size 16; an empty table
    gives no rows; other columns are left out. Only numbers are shuffled, never texts.
    """
    numbers = df.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(F.xxhash64(key), shards).alias("shard"),
        jump_hash(F.xxhash64(key), shards + 1).alias("grown_shard"),
    )
    return ranked(numbers, ["shard"], [key, "text_crc32", "size"], "slot").select(
        key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )


def write_shards(df: DataFrame, key: str, shards: int, path: str, rows_per_file: int = 1_000_000) -> None:
    """Whole rows as Parquet, one folder per shard.

    A shard is dealt over several tasks by a second hash, so none has to hold it whole.
    """
    spread = F.pmod(F.xxhash64(F.lit("spread"), F.col(key)), F.lit(8))
    placed = shard(df, key, shards, "_shard").repartition("_shard", spread)
    placed.write.option("maxRecordsPerFile", rows_per_file).partitionBy("_shard").parquet(path)
