"""Secret scans over a ledger of content-addressed blobs; native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tableferry.scratch import path_exists

#: Fixed patterns. (kind, pattern, group whose length counts, least length). The hex and
#: access patterns hold their least length themselves: runs are matched whole, so that
#: dropping short matches and never matching them is the same. For ``assign`` it is not.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Added to the base kinds.
MORE = (("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),)
RULES = BASE + MORE
#: Raised with every change of ``RULES``: blobs are scanned anew for a new version.
RULE_VERSION = 1


def spans(text: Column, kind: str, pattern: str, group: int, least: int, order: int) -> Column:
    """All matches, as an array of (start, order, end, kind) in code points.

    Spark gives the matches and the pieces between them, not their places; a place is
    the length of everything before. Most texts fail the test of ``rlike`` at once.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    one = F.struct(
        F.lit(0).alias("start"), F.lit(order).alias("order"), F.lit(0).alias("end"), F.lit(kind).alias("kind")
    )
    nothing = F.filter(F.array(one), lambda x: F.lit(False))
    start = F.struct(F.lit(0).alias("at"), nothing.alias("found"))

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + F.length(m["between"])
        end = begin + F.length(m["whole"])
        hit = F.struct(begin.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"))
        keep = F.length(m["counted"]) >= least
        return F.struct(
            end.alias("at"),
            F.when(keep, F.concat(state["found"], F.array(hit))).otherwise(state["found"]).alias("found"),
        )

    zipped = F.arrays_zip(
        F.slice(between, F.lit(1), F.size(whole)).alias("between"), whole.alias("whole"), counted.alias("counted")
    )
    found = F.aggregate(zipped, start, step, lambda s: s["found"])
    return F.when(text.rlike(pattern), found).otherwise(nothing)


def find_secrets(text: Column, rules=RULES) -> Column:
    """Spans of all rules, by start, then in the order of the rules. NULL counts as empty."""
    text = F.coalesce(text, F.lit(""))
    parts = [spans(text, kind, pattern, group, least, i) for i, (kind, pattern, group, least) in enumerate(rules)]
    return F.array_sort(F.concat(*parts))


class BlobLedger:
    """A table of (blob, rule version) pairs that were scanned, with their findings.

    ``scan`` takes any table of versions: every row is one version of something at a
    path. Blobs are the SHA-256 of a text, so a text that was moved, copied or restored
    is never scanned twice. Each call appends one batch to the ledger; a batch is a
    Parquet write that becomes visible as a whole. A batch that is written again, after a
    failure, replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str, rules=RULES, rule_version: int = RULE_VERSION):
        self.spark, self.path, self.rules, self.rule_version = spark, path.rstrip("/"), rules, rule_version

    SCHEMA = (
        "blob_id string, rule_version int, "
        "found array<struct<start: int, `order`: int, `end`: int, kind: string>>, batch string"
    )

    def entries(self, besides: str = "") -> DataFrame:
        """Scanned pairs of this rule version, each once, but for those of one batch."""
        if not path_exists(self.spark, f"{self.path}/batch=*"):
            return self.spark.createDataFrame([], self.SCHEMA)
        reader = self.spark.read.schema(self.SCHEMA).option("basePath", self.path)
        rows = reader.parquet(f"{self.path}/batch=*").where(F.col("batch") != besides)
        return rows.where(F.col("rule_version") == self.rule_version).dropDuplicates(["blob_id"])

    def scan(self, versions: DataFrame, text: str, batch: str) -> DataFrame:
        """``versions`` with ``blob_id`` and ``found``; only unseen pairs are scanned.

        Rows are kept as they are, repeated ones and NULL texts (an empty blob) included;
        an empty table gives no rows. ``text`` is left out of the result. Columns named
        ``blob_id`` or ``found`` are replaced.
        """
        addressed = versions.drop("blob_id", "found").withColumn(
            "blob_id", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
        )
        known = self.entries(besides=batch).select("blob_id")
        blobs = (
            addressed.select("blob_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
            .join(known, "blob_id", "left_anti")
            .groupBy("blob_id")
            .agg(F.first("_text").alias("_text"))
        )
        found = blobs.select(
            "blob_id", F.lit(self.rule_version).alias("rule_version"), find_secrets(F.col("_text"), self.rules).alias("found")
        )
        found.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return addressed.drop(text).join(self.entries().select("blob_id", "found"), "blob_id", "left")


def joined(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind))


def digest(found: DataFrame, key: str) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    base = F.filter("found", lambda s: s["order"] < len(BASE))
    counts = [_count(kind).cast("long").alias(f"n_{kind}") for kind, *_ in BASE]
    return found.select(
        key, *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans")
    )
