"""What several operators share: checkpoints, ranks, connected components, labelled samples."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tableferry.scratch import hadoop_path, scratch_path, shared_root

#: Rows of one group that a single task ranks; larger groups are split by hash.
RANK_ROWS = 20_000
#: Codes that are broadcast, at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: The same for codes alone, of two numbers each (about 100 MB).
BROADCAST_CODES = 4_000_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Rows written to the shared checkpoint folder; later reads survive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


#: Lists that note the tables written while they are open (``noting``).
_NOTED: list[list[str]] = []


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Adds the path of every table that ``stored`` writes meanwhile to ``paths``."""
    _NOTED.append(paths)
    try:
        yield
    finally:
        _NOTED.remove(paths)


def drop_noted(spark: SparkSession, paths: list[str], docs: DataFrame) -> None:
    """Delete noted tables and forget them, but for those that ``docs`` reads."""
    read = docs.inputFiles() if paths else []
    kept = [p for p in paths if any(p.rsplit("/", 1)[1] in f for f in read)]
    for path in paths:
        if path not in kept:
            jpath, fs = hadoop_path(spark, path)
            fs.delete(jpath, True)
    paths[:] = kept


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, read back."""
    path = scratch_path(df.sparkSession, name)
    for paths in _NOTED:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint for a counted side of at most ``limit`` rows; else Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """Gapless ranks from 0 within ``keys``, without holding a whole group in a task.

    Groups are dealt into buckets by a hash of ``order``; a rank is the number of rows
    in the buckets before, plus the place by ``order`` in the own bucket. Rows that are
    equal in ``order`` get neighbouring ranks.
    """
    buckets = math.ceil(max(1, df.count()) / RANK_ROWS)
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        bucketed.withColumn("_place", place)
        .join(starts, [*keys, "_bucket"])
        .withColumn(rank, F.col("_before") + F.col("_place") - 1)
        .drop("_bucket", "_place", "_before")
    )


def _is_forest_of_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("h"), F.lit(0).alias("l")).unionByName(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("h"), F.lit(1).alias("l"))
    )
    seen = ends.groupBy("node").agg(F.sum("h").alias("h"), F.max("l").alias("l"))
    return seen.where((F.col("h") > 1) | ((F.col("h") > 0) & (F.col("l") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b``), as ``node`` and ``root``.

    ``root`` is the smallest node of the component; nodes without an edge are absent.
    Large-star and small-star rounds in turn: each is a partial aggregate and a join,
    the number of rounds grows with the logarithm of the longest chain, and no group
    of neighbours is ever collected.
    """
    star = checkpoint(
        edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    )
    while not _is_forest_of_stars(star):
        both = star.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            star.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(below, "hi").where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        star = checkpoint(moved.unionByName(below.select(F.col("m").alias("lo"), "hi")).distinct())
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        star.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def fold(key: str = "doc_id") -> Column:
    """The fold of a row: crc32 of its key as text, modulo 3; fold 1 is never learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def by_place(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns called by their places, and what ``names`` are called then.

    No column of a caller can then clash with a name that an operator uses itself.
    """
    columns = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(columns))]), [f"c{columns.index(n)}" for n in names]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, key: str = "doc_id"
) -> DataFrame:
    """Whole texts of at most ``per_class`` documents of each class 0 and 1, outside fold 1.

    The documents are those whose keys have the smallest hashes, so that the sample does
    not depend on the order of rows. A key labelled twice counts as its largest label.
    """
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (fold(key) != 1))
        .groupBy(key)
        .agg(F.max(label).cast("int").alias("_label"))
    )
    parts = [
        known.where(F.col("_label") == value).orderBy(F.xxhash64(key), key).limit(per_class) for value in (0, 1)
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * per_class rows of two numbers at most
    return docs.select(F.col(key), "text").join(chosen, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def group_links(
    coded: DataFrame,
    extra: list[str],
    paired: int,
    near: Callable[[str, str], Column],
    verified: Callable[[DataFrame], DataFrame],
    prepare: Callable[[DataFrame], None] = lambda ids: None,
    attributes: DataFrame | None = None,
    marked: Callable[[DataFrame], DataFrame] | None = None,
    nearer: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all verified pairs that share a code.

    ``coded`` has ``code``, ``id`` and the columns ``extra`` that ``near`` (of two
    aliases) reads; or ``attributes`` has them, one row for each id, and is joined only
    with ids that share a code. Groups of one code with few ids: all pairs. Larger groups: every id
    is held against one of the group, another for each code; only ids of a group that
    these links leave in different components are paired, without the pairs compared
    before. For those ``marked`` may give further columns of ids (distinct), and
    ``nearer`` (of two aliases) a condition on them that no verified pair fails.
    ``prepare`` is called once with all ids (distinct) that ``verified`` will see.
    """
    counts = checkpoint(coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = coded.join(broadcast_if_small(counts, counts.count(), BROADCAST_CODES), "code")
    if attributes is not None:
        shared = shared.join(attributes, "id")
    sized = stored(shared.select("code", "id", *extra, "n"), "groups")

    def pairs(left: DataFrame, right: DataFrame, more: Column, last: Column = F.lit(True)) -> DataFrame:
        joined = left.alias("l").join(right.alias("r"), "code").where(more & near("l", "r") & last)
        return joined.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()

    ordered = F.col("l.id") < F.col("r.id")
    few, large = sized.where(F.col("n") <= paired), sized.where(F.col("n") > paired)
    leaders = large.groupBy("code").agg(F.min_by("id", F.xxhash64("id", "code")).alias("leader"))
    many = checkpoint(large.join(leaders, "code"))
    led = pairs(many.where("id = leader"), many, F.col("l.id") != F.col("r.id"))
    first = checkpoint(pairs(few, few, ordered).unionByName(led).distinct())
    prepare(first.select(F.explode(F.array("a", "b")).alias("id")).unionByName(many.select("id")).distinct())
    found = verified(first)
    if many.isEmpty():
        return found
    roots = components(found).select(F.col("node").alias("id"), "root")
    placed = checkpoint(many.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    mixed = placed.groupBy("code").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("code")
    rest = placed.join(mixed, "code", "left_semi")
    apart, nearest = ordered & (F.col("l.root") != F.col("r.root")), F.lit(True)
    if marked is not None:
        rest = rest.join(marked(rest.select("id").distinct()), "id")
        nearest = nearer("l", "r")
    return found.unionByName(verified(pairs(rest, rest, apart, nearest).join(first, ["a", "b"], "left_anti")))


def stand_ins(docs: DataFrame, placed: DataFrame, key: str, text: str, broadcast_rows: int) -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``placed``, which has a row for each of ``docs``.

    ``placed`` has ``root``, ``_key``, ``_hash`` of the text and ``_rest``, the hash of
    the row. Smallest key (NULL last), then text and row, by hash; of equal rows one.
    """
    order = F.struct(F.col("_key").isNull().alias("_none"), "_key", "_hash", "_rest")
    least = placed.groupBy("root").agg(F.min(order).alias("_o"))
    chosen = checkpoint(least.select("_o._key", "_o._hash", "_o._rest"))
    wanted = broadcast_if_small(chosen, chosen.count(), broadcast_rows)
    columns = docs.columns
    marked = docs.select("*", F.xxhash64(text).alias("_h"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("_r"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_hash")) & (F.col("_r") == F.col("_rest"))
    repeated = checkpoint(placed.groupBy("_key", "_hash", "_rest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    found = marked.join(wanted, same, "left_semi")
    again = repeated.drop("_n")
    once = found.join(again, same, "left_anti").select(*columns)
    several = found.join(again, same, "left_semi").dropDuplicates(["_r"])
    return once.unionByName(several.select(*columns))
