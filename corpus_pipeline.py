"""The corpus pipeline: stages that each take (spark, docs, sf_dir) and return the documents they keep.

Every stage but the last returns the columns it was given. Stages that decide on rows by a join write their input down
with a number for each row, so that repeated ids and repeated rows stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import read, saved
from metricloom.llm.decontaminate import contamination
from metricloom.llm.language_id import fit, identify
from metricloom.llm.mixing import mix
from metricloom.llm.near_dedup import classes
from metricloom.llm.queries import quality_weights
from metricloom.llm.sharding import shard

ROW = "_stage_row"
#: With so many labelled documents named rightly, the least score that is asked for goes half of its way.
HALFWAY = 1000


def _numbered(docs: DataFrame) -> DataFrame:
    return saved(docs.withColumn(ROW, F.monotonically_increasing_id()), "stage")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn languages from the labelled documents; documents in none go: null, without a letter, or without a label of
    their own and scored too low.

    Too low is whatever is not above chance, where no n-gram speaks for a language, by a part of the way to the lowest
    score among labelled documents that the model has not learned from and names as their labels do. With n of them the
    part is n / (n + HALFWAY) / 2, so that few labels ask for little. With fewer than two languages to tell apart, every
    document with a letter stays. Repeated rows are judged alike, and an empty table stays empty.
    """
    unseen = F.pmod(F.xxhash64("text"), F.lit(4)) == 2
    model = fit(docs.where(~unseen)) if not docs.isEmpty() else None
    if model is None or len(model.labels) < 2:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = saved(identify(docs, model), "languages")
    right = known.where(unseen & (F.col("lang_pred") == F.col("lang"))).agg(
        F.count("*").alias("n"), F.min("score").alias("least")).first()
    chance = 1 / len(model.labels)
    above = max((right["least"] or 0.0) - chance, 0.0) * right["n"] / (right["n"] + HALFWAY) / 2
    sure = F.col("score") > chance + max(above, 1e-6)
    return known.where((F.col("lang_pred") != "und") & (F.col("lang").isNotNull() | sure)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the least id, a null id last.

    Equal texts are one group, all null and empty ones too; of rows alike in id and text one stays.
    """
    rows = _numbered(docs)
    # Numbers stand for ids inside the operator; the first row by id is found here.
    groups = classes(rows.select(F.col(ROW).alias("row"), F.col(ROW).alias("id"), "text")).select(
        F.col("doc_id").alias(ROW), F.col("class_id").alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(ROW).alias("number"))
    kept = (rows.select(ROW, "doc_id").join(groups, ROW).groupBy("group").agg(F.min(order).alias("first"))
            .select(F.col("first.number").alias(ROW)))
    return rows.join(kept, ROW, "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none and stay, as repeated rows do."""
    rows = _numbered(docs)
    judged = contamination(rows, read(spark, sf_dir, "benchmark"), doc_id=ROW)
    hit = judged.where("contaminated").select(F.col("doc_id").alias(ROW))
    return rows.join(hit, ROW, "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it; null and empty texts, of no words, as often as full epochs."""
    rows = _numbered(docs)
    quality = rows.select(ROW, "doc_id").join(
        quality_weights(spark, sf_dir).groupBy("doc_id").agg(F.avg("quality").alias("quality")), "doc_id")
    # Drawn by id and text, so that the choice does not hang on where a row lies; the number tells equal rows apart.
    taken = mix(rows, quality.select(F.col(ROW).alias("doc_id"), "quality"), doc_id=ROW, drawn_by="doc_id").where(
        "copies > 0")
    taken = taken.select(F.col("doc_id").alias(ROW), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return rows.join(taken.select(ROW), ROW).select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents to 24 shards of near equal bytes; equal texts, null ones among them, go together."""
    return shard(docs)


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

#: SQL can't express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written down and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
