"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import mixing, ngram_join, packing, pii, quality
from tallyframe.llm.common import small_batches, stored, table
from tallyframe.llm.queries import fitted_quality, tokenizer_path


def _measured(docs: DataFrame) -> DataFrame:
    """Brings n_chars in line with a changed text."""
    return docs.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go.

    Every row is scored by itself: null and empty texts get the score of an empty text, equal texts the same one; a score of
    0.5 stays. Without labelled documents nothing is known and every row stays. Columns of any name stay as they are.
    """
    small_batches(spark)
    plain = docs.toDF(*[f"in_{i}" for i in range(len(docs.columns))])
    scored = quality.score_quality(plain, fitted_quality(spark, docs, sf_dir), text=f"in_{docs.columns.index('text')}")
    return scored.where(F.col("predicted") == 1).select(*plain.columns).toDF(*docs.columns)


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the smallest id stays.

    Texts without words link with nothing and stay, and so do rows without an id. Rows that share an id are documents of
    their own: of linked ones the first stays, unlinked ones all do.
    """
    small_batches(spark)
    names, plain = docs.columns, docs.toDF(*[f"in_{i}" for i in range(len(docs.columns))])
    key, text = f"in_{names.index('doc_id')}", f"in_{names.index('text')}"
    ids = plain.where(F.col(key).isNotNull())
    if ids.groupBy(key).count().where("count > 1").head(1):
        plain = stored(plain.withColumn("row", F.monotonically_increasing_id()), "rows", codec="zstd")
        groups = stored(ngram_join.jaccard_groups(plain, "row", text), "groups")
        named = plain.where(F.col(key).isNotNull()).select("row", key).join(groups.select(F.col("doc_id").alias("row"), "component_id"), "row")
        first = named.groupBy("component_id").agg(F.min(F.struct(key, "row")).alias("first")).select(F.col("first.row").alias("row"))
        return plain.where(F.col(key).isNull()).unionByName(plain.join(first, "row", "left_semi").select(*plain.columns)).drop("row").toDF(*names)
    groups = stored(ngram_join.jaccard_groups(plain, key, text), "groups")
    return plain.join(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)), key, "left_anti").select(*plain.columns).toDF(*names)


def protect(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: personal data and the terms that give them away are replaced.

    Every row stays; null and empty texts and texts without personal data are unchanged, equal rows change alike. n_chars,
    where there is one, follows the text.
    """
    return _measured(pii.sanitise(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents come as often as their source's target asks for.

    Texts without words are not taken; a null source is one of its own; repeated rows count each. The document at the edge
    of a budget gives its first words. n_chars, where there is one, follows the text.
    """
    small_batches(spark)
    return _measured(mixing.mixed_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of documents in sequences of 2,048 tokens.

    Every row is packed, repeated rows each; a null or empty text is its end token; a long text becomes several pieces.
    """
    small_batches(spark)
    return packing.packed_documents(docs, tokenizer_path("word_bpe_49k.json"), 0)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_first_of_group),
    ("PII", protect),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A fitted classifier and a hashed sample have no form in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k + 1}")
    return docs
