"""CSV records whose cells may hold line breaks, read by as many tasks as a file has splits.

A line break ends a record where the number of quotes before it is even. Lines with an odd
number of quotes toggle that; their number in each split, summed over the splits before,
says how a split begins, and a running sum inside the split says it for each line. Lines
that are records of their own go on as they are, only the lines of broken records are
brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def split_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``record``: every record of the files as text, but not their first one, the header.

    Records are ended by ``\\n`` or ``\\r\\n``; blank ones are left out. Line
    breaks inside cells stay as they are. A quote that is never closed takes the rest of its file into one record.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumn("odd", quotes % 2)

    splits = lines.groupBy("file", "at").agg(F.sum("odd").alias("odd"))
    earlier = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select("file", "at", F.coalesce(F.sum("odd").over(earlier), F.lit(0)).alias("start")).where("start > 0")
    before = W.partitionBy("file", "at").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    toggled = F.coalesce(F.sum("odd").over(before), F.lit(0))
    blank = F.col("value").isin("", "\r")
    seen = F.coalesce(F.sum((~blank).cast("int")).over(before), F.lit(0))
    placed = lines.withColumns({"toggled": toggled, "first": (F.col("at") == 0) & (seen == 0) & ~blank})
    placed = placed.join(starts, ["file", "at"], "left")  # dealt as the window is
    placed = placed.withColumn("toggled", F.col("toggled") + F.coalesce("start", F.lit(0)))

    alone = (F.col("toggled") % 2 == 0) & (F.col("odd") == 0)
    single = placed.where(alone).select("value", "first")
    broken = (
        placed.where(~alone)
        .groupBy("file", F.floor(F.col("toggled") / 2).alias("record"))
        .agg(F.sort_array(F.collect_list(F.struct("at", "line", "value"))).alias("lines"), F.max("first").alias("first"))
        .select(F.array_join("lines.value", "\n").alias("value"), "first")
    )
    whole = F.regexp_replace("value", r"\r\z", "")
    return single.unionByName(broken).where(~F.col("first")).select(whole.alias("record")).where("record <> ''")
