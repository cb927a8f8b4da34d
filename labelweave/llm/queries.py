"""Registered queries of the operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    cotraining,
    dimscan,
    lexical,
    linededup,
    mixing,
    ngramjoin,
    periodic,
    segmentations,
    simhash,
    suffixes,
    superkmer,
    token_files,
    winnowing,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op1_mix_sources")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(mixing.sized(table(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source")


@_query("op2_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.report(table(spark, sf_dir, "documents"))


@_query("op3_nearest")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimscan.search(table(spark, sf_dir, "embeddings"))


@_query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = superkmer.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@_query("op5_segmentations")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segmentations.segmentations(
        table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    )
    return found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@_query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@_query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_report(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", "n_equal", "n_near", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@_query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = cotraining.quality_scores(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_text", "p_page", "p_quality", "keep")


@_query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@_query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(
        table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2
    )


#: The text of every tenth document, by the hash of its doc_id, with a part that repeats.
PERIODIC_TAIL = """
transform(array(regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)), w ->
  transform(array(struct(size(w) as n, h div 10 as g)), s ->
    transform(array(struct(s.n as n, cast(s.g % s.n as int) as a, s.g % 8 as wide)), t ->
      transform(array(struct(t.a as a, cast(1 + (t.n - t.a) div (3 + t.wide) as int) as p)), u ->
        array_join(transform(w, (x, i) -> if(i < u.a, x, w[u.a + (i - u.a) % u.p])), ' ')
      )[0])[0])[0])[0]
"""


@_query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    changed = F.when(
        F.expr(r"h % 10 = 0 and regexp_like(text, '[^\\x20\\x09-\\x0D]')"), F.expr(PERIODIC_TAIL)
    )
    found = periodic.periodic_runs(hashed.select("doc_id", changed.otherwise(F.col("text")).alias("text")))
    longest = F.expr("get(array_sort(transform(runs, r -> struct(-r.length, r.start, r.period))), 0)")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("_best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        (-F.col("_best.col1")).alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("1000 * -_best.col1 div _best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)


@_query(
    "op13_lexical_search",
    f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS t FROM documents),
    totals AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
    tf AS (SELECT r, doc_id, len(t) AS n, term, count(*) AS tf
           FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
          FROM tf, totals GROUP BY term, n_docs),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
    scores AS (
        SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf)
               // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
        FROM q JOIN w USING (term) JOIN tf USING (term), totals GROUP BY ALL),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank,
                      doc_id, score FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op12_ngram_join")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_groups(table(spark, sf_dir, "documents"))
