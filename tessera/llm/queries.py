"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_polytope, decontaminate, divergence, edit_counts, jaccard_join, langid, lm_score, oracles, quality_rules, repair, sharding, suffix_dedup, wfst
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.ORACLES


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(n: int):
    """True where crc32(doc_id as text) mod n is 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == 2


def _register(f):
    QUERIES[f.__name__] = f
    return f


@_register
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, ~_fold(4))
    return langid.predict(docs, model).select("doc_id", _fold(4).alias("held_out"), "lang_pred", "score")


@_register
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


@_register
def op2_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


@_register
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(documents(spark, sf_dir), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_split")


@_register
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.encode(documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


@_register
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.clusters(documents(spark, sf_dir))


@_register
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


@_register
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir), ~_fold(7))


@_register
def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_register
def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with an insertion, a deletion and a replacement that its length alone decides."""
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda a, b, t: F.struct(F.floor(a).cast("int").alias("start"), F.floor(b).cast("int").alias("end"), F.lit(t).alias("text"))
    edits = F.array(edit(n / 2, n / 2, " a revised passage "), edit(n / 4, F.least(n, n / 4 + 20), ""), edit(n * 3 / 4, F.least(n, n * 3 / 4 + 1), "\n"))
    docs = documents(spark, sf_dir).select("doc_id", "text", edits.alias("edits"))
    return edit_counts.recount(docs, _tokenizer("word_bpe_49k.json"))


@_register
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


@_register
def op12_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(documents(spark, sf_dir))
