"""Sharding by a k-d tree: weighted medians along the widest metadata dimension, down to leaves of the target bytes.

The points are groups of equal texts, weighted by their bytes, with the coordinates source, language, size and text
digest. Groups above a twentieth of a shard are cut into pieces that lie side by side, so that even one that holds a
third of all rows can be split; every other group stays in one shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import saved

PIECES_PER_SHARD = 20
#: A median search ends when what it leaves open is below this part of a shard.
TOLERANCE = 0.0005
DIMENSIONS = ("by_source", "by_lang", "by_size", "by_digest")
STEP, KEY_BITS = 12, 63


def _spread(hashed: Column) -> Column:
    """A hash as a coordinate of 31 bits."""
    return F.shiftrightunsigned(hashed, 33)


def _at(values: list, index: Column, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (index + 1).cast("int"))


def _cut_nodes(points: DataFrame, shares: list[int], shard_bytes: float) -> tuple[list[int], list[int]]:
    """For each node its widest dimension and the key below which its points go left.

    points: node, weight and a key per dimension. shares: shards of each node; one alone is not cut. The median is
    found by counting: each round sums weights by the next bits of the keys and keeps, for each node, the bucket in
    which the wanted weight lies, so a round returns a row per node.
    """
    widths = {r["node"]: r for r in points.groupBy("node").agg(
        F.sum("weight").alias("w"), *[(F.max(F.shiftright(d, 32)) - F.min(F.shiftright(d, 32))).alias(d)
                                      for d in DIMENSIONS]).collect()}
    n = len(shares)
    dims = [max(range(len(DIMENSIONS)), key=lambda i: widths[k][DIMENSIONS[i]]) if k in widths else 0
            for k in range(n)]
    keys = points.select("node", "weight", F.element_at(F.array(*DIMENSIONS), _at(
        [d + 1 for d in dims], F.col("node"), "int")).alias("key"))
    wanted = [widths[k]["w"] * (shares[k] // 2) / shares[k] if k in widths else 0.0 for k in range(n)]
    prefix, below, cuts = [0] * n, [0.0] * n, [1 << KEY_BITS] * n
    open_ = {k for k in widths if shares[k] > 1}
    left = KEY_BITS
    while open_ and left > 0:
        step = min(STEP, left)
        left -= step
        active = _at([k in open_ for k in range(n)], F.col("node"), "boolean")
        inside = F.shiftright("key", left + step) == _at(prefix, F.col("node"), "long")
        counts = (keys.where(active & inside)
                  .groupBy("node", F.shiftright("key", left).bitwiseAND((1 << step) - 1).alias("bucket"))
                  .agg(F.sum("weight").alias("w")))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bucket")) + _at(below, F.col("node"), "double")
        goal = _at(wanted, F.col("node"), "double")
        found = (counts.withColumn("upto", upto).where(F.col("upto") >= goal * (1 - 1e-12))
                 .groupBy("node").agg(F.min(F.struct("bucket", "upto", "w")).alias("hit")).collect())
        for node, hit in found:
            prefix[node], below[node] = (prefix[node] << step) + hit["bucket"], hit["upto"] - hit["w"]
            if left == 0 or hit["w"] <= shard_bytes * TOLERANCE:
                over = hit["upto"] - wanted[node] <= wanted[node] - below[node]  # the nearer border of the bucket
                cuts[node] = (prefix[node] + over) << left
                open_.discard(node)
    return dims, cuts


def shard(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id", source: str = "source",
          lang: str = "lang") -> DataFrame:
    """Deal rows to shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 8; text_crc32 of those bytes; law is ``bytes``; slots count from 0
    in each shard without gaps; grown_shard is null. Equal texts share a shard unless they exceed a twentieth of one
    and a cut falls among them. Null sources and languages are one value each. An empty table gives an empty result.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = saved(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"), F.xxhash64(content).alias("digest"),
        _spread(F.xxhash64(F.lit("source"), F.col(source))).alias("by_source"),
        _spread(F.xxhash64(F.lit("lang"), F.col(lang))).alias("by_lang")), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    limit = max(total / shards / PIECES_PER_SHARD, 1.0)

    groups = saved(rows.groupBy("digest").agg(F.sum("size").alias("weight"), F.min("by_source").alias("by_source"),
                                              F.min("by_lang").alias("by_lang"), F.min("size").alias("size")),
                   "shard-groups")
    # At most PIECES_PER_SHARD * shards groups can weigh more than the limit, so this side is bounded.
    heavy = groups.where(F.col("weight") > limit).select("digest", F.ceil(F.col("weight") / limit).alias("pieces"))
    cut = rows.drop("by_source", "by_lang").join(F.broadcast(heavy), "digest", "left").withColumn(
        "piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), "pieces")).cast("int"))
    cut = saved(cut.drop("pieces"), "shard-pieces")
    # Pieces of one group differ in the last bits only; light groups keep one weight.
    pieces = cut.groupBy("digest", "piece").agg(F.sum("size").alias("weight")).join(
        groups.drop("weight"), "digest")
    tail = F.shiftleft(F.col("digest").bitwiseAND((1 << 22) - 1), 10) + F.least("piece", F.lit(1023))
    by_size = (F.log2(F.col("size").cast("double")) * (1 << 25)).cast("long")
    points = saved(pieces.withColumns({"by_size": by_size, "by_digest": _spread(F.col("digest"))}).select(
        "digest", "piece", "weight", *[(F.shiftleft(d, 32) + tail).alias(d) for d in DIMENSIONS]), "shard-points")

    node, shares = points.withColumn("node", F.lit(0)), [shards]
    first = [0]  # the first shard of each node
    while max(shares) > 1:
        dims, cuts = _cut_nodes(node, shares, total / shards)
        key = F.element_at(F.array(*DIMENSIONS), _at([d + 1 for d in dims], F.col("node"), "int"))
        right = key >= _at([min(c, (1 << KEY_BITS) - 1) for c in cuts], F.col("node"), "long")
        children, base, starts = [], [], []
        for share, start in zip(shares, first):
            base.append(len(children))
            halves = [share] if share == 1 else [share // 2, share - share // 2]
            starts += [start] if share == 1 else [start, start + share // 2]
            children += halves
        single = _at([s == 1 for s in shares], F.col("node"), "boolean")
        node = saved(node.withColumn("node", _at(base, F.col("node"), "int") + F.when(
            single, 0).otherwise(right.cast("int"))), "shard-nodes")
        shares, first = children, starts
    placed = node.select("digest", "piece", _at(first, F.col("node"), "int").alias("shard"))

    dealt = saved(cut.join(placed, ["digest", "piece"]).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(64))),
                  "shard-dealt")
    parts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    start = parts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part"))
                                           - F.col("n")).alias("start"))
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1 + F.col("start")
    # 64 rows a shard, whatever the input.
    return dealt.join(F.broadcast(start), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
