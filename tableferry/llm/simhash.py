"""Near-duplicate documents by SimHash; candidates by Golay codes of fingerprint segments.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. If two
fingerprints differ in two bits at most, one segment is free of errors, and the segment
after it holds two errors at most. Seen as a word of 23 bits, a segment decodes to one
codeword of the perfect binary Golay code; words at the rim of a ball (three errors) also
take the five codewords at distance four. Any two words that differ in two bits at most
then share a codeword. A key is an exact segment with one codeword of the next segment:
34 bits, up to six keys a segment, and no pair within two bits is missed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tableferry.llm.common import by_place, checkpoint, components, stand_ins

SEED = 42
#: Shingles hashed at once, so that long texts need no more memory.
CHUNK = 1 << 16
#: Generator polynomial of the binary Golay code, and the segments' places.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that are paired; larger groups are linked through shared neighbours.
PAIRED = 24
#: Bits that may differ.
DISTANCE = 2
#: Rows that are broadcast, at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """In how many of the 64-bit hashes each bit is set."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of unsigned hashes; 0 without any."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), CHUNK):
        ones += ones_of(hashes[start : start + CHUNK])
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash over shingles of ``words`` words of the whole text; 0 without a word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, CHUNK):
        stop = min(n, start + CHUNK)
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), SEED) for i in range(start, stop)),
            dtype=np.uint64,
            count=stop - start,
        )
        ones += ones_of(hashes)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, keep: list[str], text: str, words: int) -> DataFrame:
    """``keep`` and ``fingerprint`` (long) of every row, by Arrow batches."""

    def batches(frames):
        for batch in frames:
            prints = [fingerprint(t, words) for t in batch.column(len(keep)).to_pylist()]
            signed = np.array(prints, dtype=np.uint64).view(np.int64)
            columns = [*batch.columns[: len(keep)], pa.array(signed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "fingerprint"])

    narrow = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kept = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep]
    return narrow.mapInArrow(batches, ", ".join([*kept, "fingerprint bigint"]))


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator; 0 for codewords."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << bit - 11), rest)
    return rest


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Error pattern by syndrome, and for patterns of weight three the other five.

    Row s of the second table holds words e so that x ^ e is a codeword at distance four
    of any x with syndrome s; zeros where a word has one key only.
    """
    units = 1 << np.arange(23, dtype=np.int64)
    i, j = np.triu_indices(23, 1)
    pairs = units[i] | units[j]
    triples = np.array([p | u for p in pairs for u in units if u > p], dtype=np.int64)
    errors = np.zeros(2048, dtype=np.int64)
    for patterns in (np.zeros(1, dtype=np.int64), units, pairs, triples):
        errors[syndromes(patterns)] = patterns
    more = np.zeros((2048, 5), dtype=np.int64)
    for s, pattern in zip(syndromes(triples), triples, strict=True):
        around = set((units ^ errors[syndromes(pattern ^ units)]).tolist())
        more[s] = sorted(e for e in around if e.bit_count() == 4)
    return errors, more


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: row numbers and codeword indices, one to six of each row."""
    errors, more = golay_tables()
    rest = syndromes(words)
    rows = np.arange(len(words))
    found = [(rows, (words ^ errors[rest]) >> 11)]
    rim = more[rest, 0] != 0
    for column in range(5):
        found.append((rows[rim], (words[rim] ^ more[rest[rim], column]) >> 11))
    return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])


def candidate_keys(prints: DataFrame) -> DataFrame:
    """``fingerprint`` and each of its keys (3 to 18)."""

    def batches(frames):
        for batch in frames:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [((values >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            for s in range(3):
                rows, index = golay_keys(parts[(s + 1) % 3])
                key = (s << 34) | (parts[s][rows] << 12) | index
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[rows].view(np.int64)), pa.array(key)], ["fingerprint", "code"]
                )

    return prints.select("fingerprint").mapInArrow(batches, "fingerprint bigint, code bigint")


def links(prints: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all pairs within two bits.

    ``prints`` holds each fingerprint once. Keys with few fingerprints: the pairs are
    joined and verified. Keys with many: two words within two bits have a common
    neighbour within one bit of each, so every fingerprint of the key names its 64
    neighbours and itself, and those that name the same word are tied to the smallest of
    them; that takes 65 rows for each, however large the group is, and misses no link.
    """
    keys = checkpoint(candidate_keys(prints))
    sizes = keys.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keys.join(sizes, "code")
    few = sized.where(F.col("n") <= PAIRED).select("code", "fingerprint")
    pairs = (
        few.select("code", F.col("fingerprint").alias("a"))
        .join(few.select("code", F.col("fingerprint").alias("b")), "code")
        .where(F.col("a") < F.col("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
        .select("a", "b")
    )
    many = sized.where(F.col("n") > PAIRED).select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    near = many.withColumn("flip", F.explode(flips)).select(
        F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("word"), "fingerprint"
    )
    least = near.groupBy("word").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("z"))
    tied = near.join(least.where("a <> z").select("word", "a"), "word").select("a", F.col("fingerprint").alias("b"))
    return pairs.unionByName(tied.where("a <> b")).distinct()


def classes(prints: DataFrame, key: str) -> DataFrame:
    """``fingerprint`` with the ``root`` and the smallest key, ``component_id``, of its component."""
    distinct = prints.groupBy("fingerprint").agg(F.min(key).alias("_least"))
    roots = components(links(distinct)).withColumnsRenamed({"node": "fingerprint"})
    members = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = members.groupBy("root").agg(F.min("_least").alias("component_id"))
    return members.join(smallest, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key``, ``fingerprint`` (long) and ``component_id`` of every row.

    ``component_id`` is the smallest key that can be reached over links of two differing
    bits or fewer, the own key included. NULL, empty and blank texts have fingerprint 0 and are
    linked like any other. Repeated rows stay; a NULL key never names a component unless
    all keys of it are NULL; an empty table gives no rows; other columns are left out.
    """
    prints = checkpoint(fingerprints(docs, [key], text, words))
    return prints.join(classes(prints, key), "fingerprint").select(key, "fingerprint", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for a component: one row of each.

    That is the row of the smallest key (NULL last), then of the smallest hash of text and row.
    """
    names = docs.columns
    docs, (key, text) = by_place(docs, key, text)
    rows = docs.select(
        F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_rest"), F.col(text).alias("_text"),
    )
    prints = checkpoint(fingerprints(rows, ["_key", "_hash", "_rest"], "_text", words))
    placed = prints.join(classes(prints, "_key").select("fingerprint", "root"), "fingerprint")
    return stand_ins(docs, placed, key, text, BROADCAST_ROWS).toDF(*names)


def hex_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
