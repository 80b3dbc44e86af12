"""The corpus pipeline: language ID, near duplicates, secrets, mixing and packing, one after the other.

Each stage works on all that its predecessor kept.  ``run`` writes every stage's result to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.llm import jaccard_join, language_id, mixing, packing, secrets
from sieve.llm.common import staged
from sieve.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose n-grams are farther out of place than this in every language is no prose.
LEAST_SCORE = 0.2


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those unlike every language; sets ``lang`` to the prediction.

    A null text has no letters.  Without any language to learn, all rows stay as they are; repeated rows and null ids are
    rows like any other.
    """
    profiles = language_id.learn(docs)
    if not profiles:
        return docs.select(*COLUMNS)
    found = language_id.identify(docs.select(*COLUMNS), profiles)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of five-word shingles at a similarity of 0.8: the one with the smallest id.

    Rows are told apart by a number of their own, staged so that it stays the same: of repeated rows one stays, and rows
    with a null id, which come last, are rows like any other.  Rows without a word are alone in their components.
    """
    rows = staged(docs.select(*COLUMNS).withColumn("row_id", F.monotonically_increasing_id()))
    found = jaccard_join.jaccard_components(rows, words=5, num=80, den=100, id_col="row_id").select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col("row_id").alias("row"), F.struct(F.col("doc_id").isNull(), "doc_id", "row_id").alias("place"))
    kept = found.join(ids, "row").groupBy("component_id").agg(F.min("place")["row_id"].alias("row_id"))
    return rows.join(kept.select("row_id"), "row_id").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; a text that is null stays null, and every row stays."""
    rows = docs.select(*COLUMNS).withColumn("was_null", F.col("text").isNull())
    found = secrets.scan(rows, keep=("lang", "source", "was_null"))
    clean = found.select("doc_id", F.expr(f"CASE WHEN NOT was_null THEN {secrets.redacted()} END").alias("text"), "lang", "source")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in order of training; one read twice comes twice, at a place each.

    A read that takes a document in part, where its source's target ends, has its first words, a space between them; the
    others have the text as it is.  Texts without a word are taken by no mix; null sources are a source, null ids ids.
    """
    reads = mixing.mixed_reads(docs.select(*COLUMNS), keep=COLUMNS[1:])
    part = F.expr("words < size")
    some = F.array_join(F.expr(r"slice(regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0), 1, cast(words as int))"), " ")
    reads = reads.withColumn("text", F.when(part, some).otherwise(F.col("text"))).withColumn("n_chars", F.when(part, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return mixing.in_training_order(reads, int(spark.conf.get("spark.sql.shuffle.partitions"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces with their sequence and offset; a null text is the end mark alone, repeated rows are rows."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("language_id", identify_languages),
    ("jaccard_join", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: Packing is a search and language ID a trained model: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
