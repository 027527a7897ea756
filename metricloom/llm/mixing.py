"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, divided by its quality weight, from a hash of its id and text. A source's
complete epochs come first; the rest of its target is filled by the documents of smallest key, by prefix sums. The sums
run over key buckets of a source, so only the bucket in which a target ends is ever sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import SPACE_WORDS, ranked, saved

#: Buckets of a source. One of them is sorted in a task: a thousandth of a source, about.
BUCKETS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Targets of (source_key, source, source_size): shares by weight, stopped at ``cap`` times a source's size.

    The excess of stopped sources goes to the others by weight until none is above. A level L with target =
    min(cap * size, L * weight) does that; it rises from round to round and each round is one aggregate.
    """
    order = [F.col("source").isNull(), F.col("source")]
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.col("place") % len(weights) + 1).cast("int"))
    table = saved(ranked(sizes, order, "place").withColumn("share", w), "sources")
    most, level = F.col("source_size") * cap, 0.0
    while True:
        stopped = most < F.lit(level) * F.col("share")
        row = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(stopped, most)).alias("full"),
                        F.sum(F.when(~stopped, F.col("share"))).alias("open")).first()
        higher = ((row["all"] or 0) - (row["full"] or 0.0)) / row["open"] if row["open"] else level
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return table.withColumn("target", F.least(most, F.lit(level) * F.col("share"))).drop("place", "share")


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0,
        seed: int = 17, text: str = "text", doc_id: str = "doc_id", source: str = "source",
        drawn_by: str | None = None) -> DataFrame:
    """Words that a mix of sources takes from every document.

    ``quality``: (doc_id, quality) with a positive weight, its mean where an id has several; without one it is 1. Gives
    doc_id, size (words of the text; null: 0), source_size, target (of its source), taken (words), copies (how often the
    document is taken whole). Sources weigh ``weights`` in turn by code point, the null source last. The document in
    which a target ends counts if that brings the sum nearer. Keys come from hashes, so reruns agree; only rows alike
    in id and text tie, which are interchangeable. Empty texts take 0; an empty table gives an empty result; other
    columns are ignored. ``drawn_by``: the column that is drawn by in place of the id, which then only orders ties.
    """
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("source_key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_WORDS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(drawn_by or doc_id), F.col(text)).alias("draw"))
    if quality is not None:
        known = quality.where("quality > 0").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
        base = base.join(known, "doc_id", "left")
    else:
        base = base.withColumn("quality", F.lit(1.0))
    u = (F.col("draw").bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    base = base.withColumn("key", -F.log(u) / F.coalesce("quality", F.lit(1.0)))
    # 1 - exp(-key) is uniform for weight 1: it rises with the key and spreads the buckets.
    base = saved(base.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * BUCKETS),
                                                   F.lit(BUCKETS - 1)).cast("int")).drop("quality"), "mix-keys")

    in_bucket = saved(base.groupBy("source_key", "bucket").agg(
        F.sum("size").alias("bucket_size"), F.first("source").alias("source")), "mix-buckets")
    sizes = in_bucket.groupBy("source_key").agg(F.sum("bucket_size").alias("source_size"),
                                                F.first("source").alias("source"))
    targets = source_targets(sizes, weights, cap).drop("source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (in_bucket.drop("source").join(targets, "source_key")
            .withColumn("epochs", epochs.cast("long"))
            .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
            .withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))))
    rows = base.join(plan, ["source_key", "bucket"])
    cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("bucket_size") > F.col("rest"))
    running = F.sum("size").over(Window.partitionBy("source_key", "bucket").orderBy("key", "draw", "size", "doc_id")
                                 .rowsBetween(Window.unboundedPreceding, 0))
    whole = rows.where(~cut).withColumn("chosen", F.col("before") + F.col("bucket_size") <= F.col("rest"))
    ended = rows.where(cut).withColumn("chosen", F.col("before") + running - F.col("size") / 2 <= F.col("rest"))
    copies = F.col("epochs") + F.col("chosen").cast("long")
    return whole.unionByName(ended).select("doc_id", "size", "source_size", F.col("target").cast("double"),
                                           (F.col("size") * copies).alias("taken"), copies.alias("copies"))
