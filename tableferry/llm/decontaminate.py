"""Benchmark decontamination by spaced-seed hashing; native expressions only.

A seed is a fixed mask over neighbouring tokens; tokens at its open places do not count.
Windows of benchmark and of training text are hashed under each mask and joined. A hit
gives a diagonal (place in the text less place in the item), on which the tokens are
compared one by one: substitutions, also several, do not hide a passage.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tableferry.llm.common import broadcast_if_small, by_place, checkpoint

#: Five tokens count under each mask.
MASKS = ("1101011", "11100101", "1100010011")
#: Tokens of an overlap (of a shorter item: all of it), and the share that has to be equal.
OVERLAP, SIMILARITY = 20, 0.8
#: Items of fewer tokens have masks of their own length, as MASKS miss allowed substitutions in them.
SHORT = 11
#: Rows of hashes or texts that are broadcast, at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits of a whole text."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _places(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def short_masks(n: int) -> list[str]:
    """Masks of ``n`` tokens, one of which is intact under any allowed number of substitutions.

    The tokens are cut into two parts more than may differ; each mask opens as many parts
    as may differ.
    """
    wrong = n - math.ceil(n * SIMILARITY - 1e-9)
    part = [i * (wrong + 2) // n for i in range(n)]
    return ["".join("01"[p not in opened] for p in part) for opened in combinations(range(wrong + 2), wrong)]


def _windows(df: DataFrame, name: str, masks: tuple[str, ...]) -> DataFrame:
    """``name``, ``at`` and ``hash`` of every window of the tokens ``t`` under every mask."""

    def under(mask: str) -> Column:
        last = F.size("t") - len(mask)
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        seed = F.lit(int("1" + mask, 2))
        return F.transform(places, lambda i: F.xxhash64(seed, *[F.get(F.col("t"), i + p) for p in _places(mask)]))

    by_mask = df.select(name, F.explode(F.array(*map(under, masks))).alias("hashes"))
    return by_mask.select(name, F.posexplode("hashes").alias("at", "hash"))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Diagonals on which a window of a text and of an item agree.

    ``docs`` has ``doc`` and ``t``, ``items`` has ``item`` and ``t``. Short items are
    looked for with masks of their own length.
    """
    short = sorted(r[0] for r in items.where(F.size("t").between(1, SHORT - 1)).select(F.size("t")).distinct().collect())
    whole = tuple(mask for n in short for mask in short_masks(n))  # 25 at most
    sown = _windows(items.where(F.size("t") >= SHORT), "item", MASKS)
    for n in short:
        sown = sown.unionByName(_windows(items.where(F.size("t") == n), "item", tuple(short_masks(n))))
    sown = checkpoint(sown.select("item", "hash", F.col("at").alias("item_at")).distinct())
    seeds = broadcast_if_small(sown, sown.count(), BROADCAST_ROWS)
    grown = _windows(docs, "doc", MASKS + whole)
    return grown.join(seeds, "hash").select("doc", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """``doc`` and ``item`` (MD5 of the texts) with the verified overlap, once for each pair.

    ``start`` and ``end`` are tokens of the text, ``similarity`` the share of equal tokens
    in the best window. Texts and items without a token have no overlap.
    """
    def named(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).select(F.md5(F.col(column).cast("binary")).alias(name), F.col(column).alias("_text"))

    items = checkpoint(
        named(benchmark, item_text, "item").groupBy("item").agg(F.first("_text").alias("_text"))
        .select("item", tokens(F.col("_text")).alias("t")).where(F.size("t") > 0)
    )
    texts = named(docs, text, "doc")
    found = checkpoint(hits(texts.select("doc", tokens(F.col("_text")).alias("t")), items))
    names = checkpoint(found.select("doc").distinct())
    wanted = broadcast_if_small(names, names.count(), BROADCAST_ROWS)
    hit = texts.join(wanted, "doc").groupBy("doc").agg(F.first("_text").alias("_text"))
    both = (
        found.join(hit.select("doc", tokens(F.col("_text")).alias("d")), "doc")
        .join(items.withColumnRenamed("t", "i"), "item")
        .withColumn("low", F.greatest(F.lit(0), -F.col("diagonal")))
        .withColumn("high", F.least(F.size("i"), F.size("d") - F.col("diagonal")))
        .withColumn("width", F.least(F.lit(OVERLAP), F.size("i")))
        .where(F.col("high") - F.col("low") >= F.col("width"))
    )
    equal = F.transform(
        F.sequence(F.col("low"), F.col("high") - 1),
        lambda k: (F.get("i", k) == F.get("d", k + F.col("diagonal"))).cast("int"),
    )
    both = both.withColumn("equal", equal)
    sums = F.transform(
        F.sequence(F.lit(1), F.size("equal") - F.col("width") + 1),
        lambda k: F.aggregate(F.slice("equal", k, F.col("width")), F.lit(0), lambda a, x: a + x),
    )
    both = both.withColumn("sums", sums).withColumn("best", F.array_max("sums"))
    need = F.col("best") >= F.ceil(F.col("width") * SIMILARITY - 1e-9)
    at = F.col("low") + F.col("diagonal") + F.array_position("sums", F.col("best")).cast("int") - 1
    good = both.where(need).select(
        "doc", "item", at.alias("start"), (at + F.col("width")).alias("end"),
        (F.col("best") / F.col("width")).alias("similarity"),
    )
    best = F.struct("similarity", (-F.col("start")).alias("_late"), "start", "end")
    return good.groupBy("doc", "item").agg(F.max(best).alias("b")).select("doc", "item", "b.start", "b.end", "b.similarity")


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """A row for each document and benchmark item that share a passage.

    Repeated rows of either side each have theirs; NULL keys are kept; empty tables give
    no rows; other columns are left out.
    """
    found = checkpoint(overlaps(docs, benchmark, text, item_text))
    keyed = docs.select(F.col(key).alias("_key"), F.md5(F.col(text).cast("binary")).alias("doc"))
    named = benchmark.select(F.col(item).alias("_item"), F.md5(F.col(item_text).cast("binary")).alias("item"))
    return (
        found.join(keyed, "doc").join(named, "item")
        .select(F.col("_key").alias(key), F.col("_item").alias(item), "start", "end", "similarity")
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that share no passage with the benchmark."""
    names = docs.columns
    docs, (text,) = by_place(docs, text)
    found = checkpoint(overlaps(docs, benchmark, text, item_text).select(F.col("doc").alias("_leak")).distinct())
    leaked = broadcast_if_small(found, found.count(), BROADCAST_ROWS)
    name = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return docs.join(leaked, name == F.col("_leak"), "left_anti").toDF(*names)
