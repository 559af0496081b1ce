"""Registered queries of this package: thin calls of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tableferry.llm import langid, toxicity, transcripts
from tableferry.llm.alignment import align
from tableferry.llm.common import documents, fold
from tableferry.llm.decontaminate import leaks
from tableferry.llm.divergence import audit
from tableferry.llm.linededup import deduplicated
from tableferry.llm.neighbours import near_vectors
from tableferry.llm.packing import pack
from tableferry.llm.quality import apply_rules, learn_rules
from tableferry.llm.secrets import BASE, RULES, BlobLedger, digest
from tableferry.llm.sharding import sharded
from tableferry.llm.simhash import hex_text, near_duplicates
from tableferry.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 40


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def held_out():
    return F.coalesce(fold() == 1, F.lit(False)).alias("held_out")


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.train(docs), ["doc_id"])
    return found.select("doc_id", held_out(), "lang_pred", "score")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.score(docs, toxicity.train(docs, labels(spark, sf_dir)), ["doc_id"])
    return found.select("doc_id", held_out(), "score", "predicted")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = transcripts.raw_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = transcripts.parse(raw, transcripts.train(raw), ["conv_id", "segment", "roles"])
    return found.select(
        "conv_id",
        "segment",
        F.coalesce(fold("conv_id") == 1, F.lit(False)).alias("held_out"),
        F.size("turns").alias("n_turns"),
        F.array_join("turns.role", ",").alias("roles_found"),
        F.array_join("roles", ",").alias("roles_told"),
        "rendered",
    )


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir).select("doc_id", "text"), dropped="n_dropped")


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir), "doc_id", "text", SHARDS)


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = BlobLedger(spark, scratch_path(spark, "ledger"))
    return digest(ledger.scan(documents(spark, sf_dir).select("doc_id", "text"), "text", "0"), "doc_id")


def _found_sql() -> str:
    """Matches of every rule: split and extracted pieces give the places, as in Spark."""
    parts = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        text = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""
            SELECT doc_id, '{kind}' AS kind, {order} AS rank, {least} AS least, regexp_extract_all(t, {text}) AS m,
                   regexp_extract_all(t, {text}, {group}) AS g, regexp_split_to_array(t, {text}) AS p
            FROM d WHERE regexp_matches(t, {text})""")
    return " UNION ALL ".join(parts)


ORACLES["op7_secret_scan"] = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({_found_sql()}),
    each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
    placed AS (
      SELECT doc_id, kind, rank, length(g[i]) >= least AS kept, length(m[i]) AS size,
             list_sum(list_transform(p[1:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start
      FROM each),
    joined AS (
      SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b,
             count(*) FILTER (kind = 'hex') AS c,
             string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank)
               FILTER (rank < {len(BASE)}) AS base,
             string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank) AS spans
      FROM placed WHERE kept GROUP BY doc_id)
    SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN joined USING (doc_id)"""


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", hex_text(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rated = apply_rules(docs, learn_rules(docs, labels(spark, sf_dir)))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query
def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES["op11_embedding_near_dedup"] = """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
        AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
    reached AS (
      SELECT vec_id, vec_id AS other FROM embeddings
      UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a),
    component AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
    counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN component USING (vec_id) LEFT JOIN counted USING (vec_id)"""


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


ORACLES["op13_source_divergence"] = r"""
    WITH d AS (
      SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    each AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
    kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    c AS (SELECT lang, source, term, count(*) AS n FROM each SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
    cn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
    p AS (
      SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(cn.total, 0) + v.v)::HUGEINT AS p
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN cn USING (lang, source)
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    q AS (
      SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)::HUGEINT) // (max(total) + max(v.v))::HUGEINT AS q
      FROM c JOIN (SELECT lang, sum(total) AS total FROM cn GROUP BY lang) USING (lang) JOIN v USING (lang)
      GROUP BY lang, term),
    f AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    terms AS (
      SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
      FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
