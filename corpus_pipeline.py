"""A corpus pipeline: toxic documents go, one of each group of near copies stays, personal data is masked, the rest is packed.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.llm import common, jaccard, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among docs, does not predict as toxic.

    Their columns stay, whatever their names. Null and empty texts score as low as a text without sentences and stay; long ones
    are scored whole; repeated rows are judged alike; no rows give none.
    """
    common.prepared(spark)
    model = toxicity.learned(docs, toxicity.training_labels(spark, sf_dir))
    aside = {c: f"__own_{c}" for c in docs.columns if c in toxicity.ADDED}
    kept = toxicity.scored(docs.withColumnsRenamed(aside), model).where("predicted = 0")
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram join: the one of smallest doc_id (rows without one last, then the first row).

    Rows are judged each by its own text, so a doc_id on rows with different texts keeps one of each, and repeated rows leave
    one. Rows without words stay.
    """
    common.prepared(spark)
    rows = common.saved(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = common.saved(jaccard.jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("component_id").alias("u"), F.col("doc_id").alias("v")), "found")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    least = rows.select("doc_id", F.col("__row").alias("v"), "__row").join(found, "v").groupBy("u").agg(F.min(place).alias("k"), F.count("*").alias("n")).where("n > 1")
    gone = common.attached(found, least.select("u", F.col("k.__row").alias("m"), "n"), found.count()).where("v <> m").select(F.col("v").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars of the new text.

    Every row stays, null texts too; long texts are masked whole; repeated rows are masked alike; no rows give none.
    """
    common.prepared(spark)
    masked = pii.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of 2048, a row for each piece.

    A null or empty text is its end id alone; long texts are cut into pieces; repeated rows are packed each; no rows give none.
    """
    import public_tokenizers

    common.prepared(spark)
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("personal_data", mask_personal_data), ("packing", pack)]

#: SQL can't express the fitted model, the field or the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each read from what the one before wrote."""
    common.prepared(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
