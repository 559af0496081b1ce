"""CSV files as DataFrames whose columns are all text."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tableferry.scratch import path_exists
from tableferry.sources.records import split_records

READ_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "sep": ",",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "nullValue": "",
    "emptyValue": "",
    "maxCharsPerColumn": -1,
}
_FLAGGED = "_flagged"
#: Files whose header lines one job reads.
HEADERS_PER_JOB = 256


def clean_path(path: str) -> str:
    return path.replace("\\", "/")


def read_header(spark: SparkSession, path) -> list[str]:
    """Names in the header line, as written; no names for an empty file.

    Only the first record of one file is parsed.
    """
    raw = spark.read.options(**READ_OPTIONS, multiLine=True, header=False).csv(path)
    first = raw.first() if raw.columns else None
    return [] if first is None else ["" if v is None else v for v in first]


def whole_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines of one file, in order and read by one task, however large the file is.

    Text of several splits has no first line: the tasks' rows come in any order.
    """
    unquoted = {"quote": "", "escape": "", "sep": "\u0001\u0002"}
    return spark.read.options(**READ_OPTIONS | unquoted, multiLine=True, header=False).schema("value string").csv(path)


def read_layouts(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the names in their header lines, in the order of the paths.

    One task per file reads its first line, in jobs of ``HEADERS_PER_JOB`` files. A
    header line that goes on after a line break is parsed by itself. Empty files are
    left out.
    """
    files = sorted(map(unquote, spark.read.text(paths).inputFiles()))  # given as URIs
    lines: dict[str, str] = {}
    for start in range(0, len(files), HEADERS_PER_JOB):
        firsts = [
            whole_lines(spark, f).where(F.trim("value") != "").limit(1).select(F.lit(f).alias("file"), "value")
            for f in files[start : start + HEADERS_PER_JOB]
        ]
        lines |= {r["file"]: r["value"] for r in reduce(DataFrame.union, firsts).collect()}
    layouts: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        if f in lines:
            whole = lines[f].removeprefix("\ufeff").rstrip("\r")
            if "\r" in whole or whole.count('"') % 2:
                names = read_header(spark, f)
            else:
                names = next(csv.reader([whole]))
            layouts.setdefault(tuple(names), []).append(f)
    return layouts


def _cells_in(line: Column) -> Column:
    """How many cells a raw line holds: separators outside quotes, plus one."""
    bare = F.regexp_replace(line, '"[^"]*+"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    *,
    multiline: bool | str = True,
    headers: str = "each",
    blanks: str = "exact",
    strict_rows: bool = False,
    malformed_column: str | None = None,
    missing_ok: bool = False,
    stream: bool = False,
    files_per_trigger: int | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Read CSV with a header line; every column is a string.

    ``multiline`` says whether a cell may hold a line break.  A file is then one task;
    without, files of any size are split over tasks, and a line break ends a row even
    inside quotes.  ``"split"`` gives both: files are split, and rows are put together by
    the parity of the quotes before each line, which takes two passes and a shuffle.  It
    counts every quote, so a lone one inside an unquoted cell is read otherwise.  Nothing
    else depends on the size of a file.

    ``blanks`` says what a blank cell becomes.  ``exact``: '' where the row has
    the cell and NULL where the row is too short.  ``empty``: always ''.
    ``null``: always NULL.  With the last two, and without ``multiline``, the scan
    skips unused columns.

    Files are matched by the names in their own headers: the columns are those of the
    first file by path, in its order, and a file whose names differ from them in more
    than their order is an error.  With ``headers="first"`` the driver reads one header
    only, and the tasks hold the others against it while they read: for any number of
    files, all with the same columns in the same order.

    ``strict_rows`` fails on a row with too few or too many cells.
    ``malformed_column`` adds a flag for rows whose number of cells differs from the
    header's.  ``stream`` gives a streaming frame over the files that are there and
    those that come later; ``columns`` names the header's columns for a folder that
    is still empty.  A later file with another header ends the stream with an error.
    """
    if blanks not in ("exact", "empty", "null"):
        raise ValueError(f"unknown treatment of blank cells: {blanks}")
    if headers not in ("each", "first"):
        raise ValueError(f"unknown treatment of headers: {headers}")
    if multiline == "split" and (stream or headers == "first"):
        raise ValueError("multiline='split' reads the header of each file, and no streams")
    paths = [clean_path(p) for p in ([path] if isinstance(path, str) else path)]
    one = headers == "first" and not stream
    if stream and columns:
        layouts = {tuple(columns): paths}
    elif (missing_ok or stream) and not any(path_exists(spark, p) for p in paths):
        if stream:
            raise ValueError(f"nothing is at {paths[0]} yet: name the columns")
        return spark.createDataFrame([], T.StructType([]))
    elif one:
        names = read_header(spark, paths)
        layouts = {tuple(names): paths} if names else {}
    else:
        layouts = read_layouts(spark, paths)
    if not layouts:
        if stream:
            raise ValueError(f"no header is at {paths[0]} yet: name the columns")
        return spark.createDataFrame([], T.StructType([]))
    first = next(iter(layouts))
    for names, files in layouts.items():
        if set(names) != set(first) or (stream and names != first):
            raise ValueError(f"{files[0]} has the columns {list(names)}, not {list(first)}")
    parts = [
        _read_layout(
            spark, paths if stream or len(layouts) == 1 else files, list(names), multiline, blanks,
            strict_rows, malformed_column, stream, files_per_trigger, one,
        )
        for names, files in layouts.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _read_layout(
    spark, paths, header, multiline, blanks, strict_rows, malformed_column, stream, files_per_trigger, one
) -> DataFrame:
    """Files with one header."""
    unique = len({n.lower() for n in header}) == len(header) and "" not in header
    if one and not unique:
        raise ValueError(f"headers='first' needs names that differ: {header}")
    checked = (stream or one) and unique  # other files, and those that come later, are held against the header
    names = header if checked else [f"c{i}" for i in range(len(header))]
    flag_rows = not strict_rows and (blanks == "exact" or malformed_column is not None)
    fields = [T.StructField(n, T.StringType()) for n in names]
    reader = spark.readStream if stream else spark.read
    reader = reader.options(**READ_OPTIONS, multiLine=multiline, header=True, enforceSchema=not checked)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if flag_rows:
        # with pruning a row is not compared with the header when columns are unused
        fields.append(T.StructField(_FLAGGED, T.StringType()))
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=_FLAGGED, columnPruning=False)
    elif strict_rows:
        reader = reader.options(mode="FAILFAST", columnPruning=False)
    if multiline == "split":
        mode = {"mode": "FAILFAST"} if strict_rows else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _FLAGGED}
        options = {k: str(v) for k, v in (READ_OPTIONS | mode | {"multiLine": True}).items()}
        kind = ", ".join(f"`{f.name}` string" for f in fields)
        df = split_records(spark, paths).select(F.from_csv("record", kind, options).alias("_row")).select("_row.*")
    else:
        df = reader.schema(T.StructType(fields)).csv(paths[0] if stream else paths)
    df = df.toDF(*[f"c{i}" for i in range(len(header))], *([_FLAGGED] if flag_rows else []))

    if flag_rows and blanks == "exact":
        df = df.withColumn("_cells", F.when(F.col(_FLAGGED).isNotNull(), _cells_in(F.col(_FLAGGED))))

    def cell(i: int) -> Column:
        c = F.col(f"c{i}")
        if blanks == "null":
            return c
        filled = F.coalesce(c, F.lit(""))
        if blanks == "empty" or strict_rows:
            return filled
        return F.when(F.col("_cells").isNull() | (F.col("_cells") > i), filled)

    # of several columns with one name the last one counts, where the first stands
    position = {name: i for i, name in enumerate(header)}
    out = [cell(i).alias(name) for name, i in position.items()]
    if malformed_column:
        flag = F.col(_FLAGGED).isNotNull() if flag_rows else F.lit(False)
        out.append(flag.alias(malformed_column))
    return df.select(*out)
