"""Labels of the columns of a folder of CSV files, learned file by file and kept.

For every file and column the ledger has what its non-blank cells have in common: whether
all are INT, FLOAT or DATE text. Such states form a lattice, with "blank" at the bottom
and STRING at the top, and merge by "and", in any order and any number of times. A new
look at the folder reads only files whose path, size or time is not on record; files that
are gone or were changed drop out by themselves, since only states of files that are there
are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tableferry import fixed
from tableferry.operators.infer import _label, schema_frame
from tableferry.scratch import path_exists
from tableferry.sources.csv import clean_path, read_csv

KINDS = {"is_int": fixed.INT_TEXT, "is_float": fixed.FLOAT_TEXT, "is_date": fixed.DATE_TEXT}
STATE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("filled", T.BooleanType()),
        *[T.StructField(k, T.BooleanType()) for k in KINDS],
    ]
)
_FILE = ["file", "size", "modified"]


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``size`` and ``modified`` of the files of a folder; their content is not read."""
    found = spark.read.format("binaryFile").load(clean_path(path))
    return found.select(F.input_file_name().alias("file"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    if not path_exists(spark, ledger):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(ledger)


def file_states(spark: SparkSession, files: DataFrame, **options) -> DataFrame:
    """One row for each file and column: a partial aggregate by file, in one pass over these files."""
    paths = [r.path for r in files.select("path").sort("path").collect()]  # the new files
    df = read_csv(spark, paths, blanks="null", **options)
    names = df.columns
    text = df.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("file", F.input_file_name())
    flags = []
    for i in range(len(names)):
        cell = F.col(f"c{i}")
        filled = cell.isNotNull() & (cell != "")
        flags.append(F.coalesce(F.bool_or(filled), F.lit(False)).alias(f"c{i}_filled"))
        flags += [F.coalesce(F.bool_and(F.when(filled, cell.rlike(p))), F.lit(True)).alias(f"c{i}_{k}") for k, p in KINDS.items()]
    rows = text.groupBy("file").agg(*flags)
    found = files.drop("path").join(rows, "file", "left")  # files without a row are on record too
    cells = [
        F.struct(
            F.lit(i).alias("pos"), F.lit(name).alias("name"), F.coalesce(F.col(f"c{i}_filled"), F.lit(False)).alias("filled"),
            *[F.coalesce(F.col(f"c{i}_{k}"), F.lit(True)).alias(k) for k in KINDS],
        )
        for i, name in enumerate(names)
    ]
    if not cells:  # no header anywhere
        return spark.createDataFrame([], STATE)
    return found.select(*_FILE, F.inline(F.array(*cells)))


def merged(states: DataFrame) -> DataFrame:
    """``pos``, ``name`` and ``type`` of the columns of all these files: the same labels as one pass over their rows gives."""
    each = states.groupBy("name").agg(
        F.min_by("pos", F.struct("file", "pos")).alias("_pos"),
        F.bool_or("filled").alias("filled"),
        *[F.bool_and(k).alias(k) for k in KINDS],
    )
    fits = [F.col("filled") & F.col(k) for k in KINDS]
    return each.select(F.col("_pos").cast("int").alias("pos"), "name", _label(*fits).alias("type"))


def infer_incremental(spark: SparkSession, path: str, ledger: str, **options) -> DataFrame:
    """(pos, name, type) of a folder of CSV files by all of their rows, reading only what is new.

    ``ledger`` is a folder of states that this call adds to; ``options`` go to the reader.
    Two calls at once may both add the states of one file, which changes nothing. A path
    without files gives no columns.
    """
    if not path_exists(spark, clean_path(path)):
        return schema_frame(spark, [])
    there = listing(spark, path)
    known = read_ledger(spark, ledger)
    new = there.join(known.select(*_FILE).distinct(), _FILE, "left_anti")
    if not new.isEmpty():
        file_states(spark, new, **options).write.mode("append").parquet(ledger)
    return merged(read_ledger(spark, ledger).join(there.select(*_FILE), _FILE, "left_semi"))
