"""One query per operator over the driver's tables, and the DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm import alignment, decontam, exact, language, mixing, pii, repeats, runs, scoring, simhash, templates, tokens, warc
from postsieve.llm.common import importable, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


ORACLES["op4_exact_dedup"] = exact.ORACLE


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op6_source_mix"] = mixing.ORACLE


@query
def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


ORACLES["op7_warc_bundles"] = warc.ORACLE


@query
def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(table(spark, sf_dir, "documents"))


@query
def op5_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", F.size("dropped").cast("bigint").alias("n_dropped"),
                          F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"), F.sha2("text", 256).alias("kept_sha256"))


@query
def op11_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), *paths)
    shown = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", *alignment.RESULTS, shown.alias("groups_sha256"))


@query
def op12_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("repeats", F.lit(0).cast("bigint"), lambda n, r: n + r["length"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def _repeated_tails(docs: DataFrame) -> DataFrame:
    """The table's texts, those of a tenth of the documents with a repeated end: with the crc32 h of the id and
    g = h // 10, the words from a = g % n on become repeats of the first 1 + (n - a) // (3 + g % 8) of them."""
    tail = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn("g", F.expr("h div 10"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    tail = tail.withColumn("words", F.when(F.col("h") % 10 == 0, words).otherwise(F.array())).withColumn("n", F.size("words"))
    tail = tail.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    made = ("concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a + 1), int(p)), int((n - a) div p + 1))), "
            "1, int(n - a)))")
    return tail.select("doc_id", F.expr(f"if(n > 0, array_join({made}, ' '), text)").alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_repeated_tails(table(spark, sf_dir, "documents")))
    top = F.expr("array_min(transform(runs, r -> struct(-r.length as length, r.start as start, r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "top.start", (-F.col("top.length")).alias("length"), "top.period",
        F.expr("(-1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
