import struct
import zlib

import xxhash
from helpers import SF, awkward, documents, empty
from pyspark.sql import functions as F

from tableferry.llm.queries import QUERIES
from tableferry.llm.sharding import jump_hash, sharded, write_shards


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_published_function(spark):
    keys = [0, 1, 2, -1, 2**63 - 1, -(2**63), 123456789]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 40, 41, 1000):
        assert [r[0] for r in df.select(jump_hash(F.col("k"), n)).collect()] == [jump(k, n) for k in keys]


def test_whole_table(spark):
    rows, texts = QUERIES["op6_sharding"](spark, SF).collect(), documents(spark)
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        key = xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert (r["shard"], r.grown_shard) == (jump(key, 40), jump(key, 41))
        assert r.grown_shard in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_awkward_rows(spark):
    rows = sharded(awkward(spark), "doc_id", "text", 5).collect()
    assert len(rows) == awkward(spark).count() and all(0 <= r["shard"] < 5 for r in rows)
    assert {r["size"] for r in rows if r.doc_id in (1, 2)} == {16}
    assert len({r["shard"] for r in rows if r.doc_id == 4}) == 1 and len({r.slot for r in rows if r.doc_id == 4}) == 2
    assert sharded(empty(spark), "doc_id", "text", 5).count() == 0


def test_written_shards_hold_all_rows(spark, path):
    write_shards(awkward(spark), "doc_id", 3, path("shards"))
    back = spark.read.parquet(path("shards"))
    assert back.count() == awkward(spark).count() and {r[0] for r in back.select("_shard").distinct().collect()} <= {0, 1, 2}
