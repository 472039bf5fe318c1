"""The operators of this package as queries over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import bpe, fertility, huffman, jaccard, language, licenses, mixing, nearest, negatives, oracles, periodic, projections, pseudonyms, toxicity
from faultline.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every text, exact and with bounded edits."""
    return licenses.summarise(licenses.find_notices(_table(spark, sf_dir, "documents")), "doc_id")


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by target weights takes of every document."""
    return mixing.taken(_table(spark, sf_dir, "documents"))


@query
def op3_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, fertility and verdict of every text."""
    measured = fertility.measure(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return fertility.judge(measured)


@query
def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal numbers, dates, addresses and secrets replaced."""
    made = pseudonyms.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("pseudonyms", lambda p: p["kind"]))), ",")
    return made.select("doc_id", "text", F.coalesce(F.size("pseudonyms"), F.lit(0)).cast("long").alias("n_replaced"), F.coalesce(kinds, F.lit("")).alias("kinds"))


@query
def op5_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by its nearest labelled examples; a fifth of the labels is held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language.remainder("doc_id", 5) == 0
    labels = _table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query
def op6_compressed_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by dictionary compression; a quarter of the documents is held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language.remainder("doc_id", 4) == 2
    found = language.classify(docs, language.fit(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op7_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and near-duplicate components of all documents."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op8_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate components of all vectors."""
    return projections.near_duplicates(_table(spark, sf_dir, "embeddings"))


@query
def op9_byte_pair_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to tokens and back."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.round_trip(_table(spark, sf_dir, "documents"), path), "doc_id")


@query
def op10_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All token ids to coded files and back."""
    encoded = huffman.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    path = f"{shared_dir(spark)}/id-files-{uuid.uuid4().hex}"
    huffman.write_files(encoded, path)
    return huffman.checksums(huffman.read_files(spark, path))


@query
def op11_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product for every twentieth vector, against all."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.neighbours(vectors, vectors.filter("vec_id % 20 = 0"))


@query
def op12_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector and its positives, against all rows; a seventh of the labels is moved."""
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.sound(vectors.select("vec_id", "embedding", label.alias("label")))
    return negatives.mine(rows, rows.filter("vec_id % 100 = 0"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal periodic runs of words of every text, with runs planted in every tenth."""
    return periodic.digests(periodic.find_runs(periodic.with_planted_runs(_table(spark, sf_dir, "documents"))))


ORACLES |= {"op7_parity_sketch_join": oracles.JACCARD_JOIN, "op8_projection_passes": oracles.VECTOR_LINKS, "op12_threshold_negatives": oracles.HARD_NEGATIVES}
