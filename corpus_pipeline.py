"""Corpus preparation: documents through five stages, each over all that the one before kept.

Toxic documents go, then those that the quality rules reject, then all but one
document of each group of near copies; personal data in the rest is redacted,
and what remains is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeframe.llm import ngram_join, packing, pii, quality, toxicity
from planeframe.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, doesn't predict to be toxic.

    A null or empty text has no toxic word and stays; rows without an id are
    judged like others (they only can't be labelled); repeated rows stay as many;
    an empty table gives none.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the cascade of quality rules keep.

    A null or empty text has fewer than 50 words and goes; ids play no part;
    repeated rows stay as many; an empty table gives none.
    """
    return quality.only_kept(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked n-gram sets: of the smallest id, of several rows with that id any one, the same in each run.

    Rows are told apart by a fingerprint of all their columns, not by their id:
    those without an id are grouped by their text as others are, and one of them
    is kept if no row of its group has an id. Of rows that are equal in all
    columns one stays, even if their text has no word and so links with nothing.
    """
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in COLUMNS])
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS, nulls).alias("_row"))
    classes = ngram_join.ngram_classes(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    heads = classes.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(own).alias("head")).select("head._row")
    return rows.join(heads, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars counts the new text, null for a null one.

    Ids play no part; repeated rows stay as many; an empty table gives none.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences.

    A null or empty text is its end token alone; repeated rows are packed each;
    an empty table gives none.
    """
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("ngram_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; each stage but the last is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
