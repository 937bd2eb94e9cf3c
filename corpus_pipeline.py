"""The corpus pipeline over the documents table: each stage is written as Parquet and reread by the next.

Language ID drops documents without a language, the quality classifier drops what it rejects, one document of each
group of near-duplicates stays, sources are mixed to their target weights, and what is left is encoded.

Every stage reads the columns of documents alone (others, whatever their names, are ignored), takes any of them null,
reads very long texts whole, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, mixing, ngram_join, quality, queries
from tidemark.llm.common import cut, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE = 0.5  # mean posterior below which a text has no language of its own


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose predicted language is likelier than not; null and empty texts go, repeated rows share their fate and stay repeated."""
    docs = docs.select(*COLUMNS)
    kept = langid.predict(docs, langid.train(docs), keep=COLUMNS)
    return kept.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; null, empty and blank texts go, repeated rows share their fate and stay repeated."""
    docs = docs.select(*COLUMNS)
    return quality.score(docs, quality.train(docs)[0], keep=COLUMNS).where(F.col("score") >= quality.KEEP).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates (five words, similarity 0.8); rows with a null id stay.

    Rows repeated with their id stay once. Texts without words (null, empty, blank) have no near-duplicates and stay.
    """
    docs = docs.select(*COLUMNS)
    groups = cut(ngram_join.jaccard_components(docs, keys=ngram_join.Bands))
    kept = docs.join(groups.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)
    repeated = groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0, 1 or 2 times); texts without words are never taken, null sources are a source."""
    return mixing.copies(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every whole text (packed little-endian unsigned 32-bit integers) and their number; a row each, none for a null or empty text."""
    coded = bpe.encode(docs.select(*COLUMNS), queries.vocabulary(), out="token_ids")
    return coded.select("doc_id", "lang", "source", "n_chars", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids")


STAGES = [("language_id", language_stage), ("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]
ORACLE_SQL = None  # trained models, links and merges have no SQL form; tests/llm holds the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``sf_dir``'s documents; what the stages hand on lies in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:  # what the stage read; the last folder stays for the rows that are returned
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        before = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
