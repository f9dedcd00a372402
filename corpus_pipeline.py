"""A training-data pipeline over `documents`: filter by quality and toxicity, drop near-duplicates, mix sources, pack.

Defined cases, for every stage: a null text counts as empty; empty texts have no
words, so the classifiers judge them like any text and the mix never takes them (it takes words);
rows without doc_id are documents like others, and unlike texts stay apart
though they share an id or have none; of equal and near-equal texts one row stays, the one
of least doc_id, then content key, then least columns; repeated rows before that
stage are judged alike; an empty table passes through all stages as an empty table; columns beyond
COLUMNS are left out by name, so they cannot clash with computed ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm import mixing, neardup_text, packing, quality, toxicity
from arborspark.llm.common import bounded_batches, discard, new_path, table
from arborspark.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: All stages share the executors' Python workers, so batches and groups are smaller here than in single queries.
BATCH_MB, GROUP_TOKENS, SLICE_BYTES, MEMO = 4, 1 << 19, 1 << 20, 40_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    bounded_batches(spark, BATCH_MB)
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), carry=COLUMNS)
    return scored.filter("predicted = 1").select("doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model lets pass."""
    bounded_batches(spark, BATCH_MB)
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), carry=COLUMNS)
    return scored.filter("predicted = 0").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: of least doc_id (nulls last), then least content key; once if its row is repeated.

    Classes are told apart by their component, so texts that are unlike stay apart though their ids are null or equal.
    """
    _, texts = neardup_text.near_duplicates(docs)
    least = F.min(F.struct(F.col("lead").isNull(), F.col("lead").alias("id"), "k1", "k2")).alias("least")
    leads = texts.groupBy("component").agg(least).select(F.col("least.id").alias("_lead_id"), F.col("least.k1").alias("_lead_k1"), F.col("least.k2").alias("_lead_k2"))
    keyed = neardup_text.with_key(docs.select("doc_id", "lang", "source", "n_chars", "text"))
    alone = keyed.filter("_k1 IS NULL")
    same = (keyed["_k1"] == leads["_lead_k1"]) & (keyed["_k2"] == leads["_lead_k2"]) & keyed["doc_id"].eqNullSafe(leads["_lead_id"])
    # Of the rows of a kept text and id one is taken; a partial aggregate finds it, so repeated rows do not meet in one task.
    least = F.min(F.struct(*[F.struct(F.col(c).isNull(), F.col(c)).alias(c) for c in ("lang", "source", "n_chars", "text")])).alias("row")
    kept = keyed.join(leads, same, "left_semi").groupBy("_k1", "_k2", "doc_id").agg(least)
    kept = kept.select("doc_id", *[F.col(f"row.{c}.{c}").alias(c) for c in ("text", "lang", "source", "n_chars")])
    return alone.select(*COLUMNS).unionByName(kept.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs, COLUMNS).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces; see op2."""
    bounded_batches(spark, BATCH_MB)
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"), group_tokens=GROUP_TOKENS, slice_bytes=SLICE_BYTES, memo=MEMO, keep=False)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: The models and the tokenizer are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared folder and read again by the next, which then deletes it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if hasattr(docs, "scratch_path"):
            discard(docs)
        docs = spark.read.parquet(path)
        docs.scratch_path = path
    return docs
