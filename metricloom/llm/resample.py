"""Importance resampling towards a target text collection, by hashed word n-grams.

The texts of a batch are joined with a sentinel byte that no UTF-8 text holds. One regex pass finds all words and
sentinels; the sentinels' places are the texts' offsets, by which n-grams that cross from one text into the next are
masked before their buckets are counted. Bucket counts of both collections give each bucket a gain; a document's weight
is the sum over its features, and Gumbel noise from its id makes the highest scores a sample by weight.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import in_arrow, lower_ascii, ranked, saved
from metricloom.llm.words import PORTION, portions

SENTINEL = b"\xff"
#: Words are runs of digits, letters and all of non-ASCII.
TOKEN = re.compile(rb"\xff|[^\x00-\x2F\x3A-\x60\x7B-\x7F\xff]+")
NOT_WORD = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F\xff]")
#: Distinct features whose hashes a task remembers; beyond it the memory starts anew.
REMEMBERED = 500_000


class _Buckets(dict):
    """Feature to bucket: the CRC-32 of its bytes, worked out at the first look-up."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.n
        return found


def _pieces(joined: bytes) -> Iterator[bytes]:
    """Cut joined texts into pieces of about a portion, between words."""
    at = 0
    while at < len(joined):
        edge = NOT_WORD.search(joined, at + PORTION)
        stop = edge.start() if edge else len(joined)
        yield joined[at:stop]
        at = stop


def features(texts: list[bytes], longest: int, memory: _Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of all features of 1 to ``longest`` words, ordered by text, and the words of each text."""
    owners, buckets = [], []
    n_words = np.zeros(len(texts), dtype=np.int64)
    carried: list[bytes] = []  # the last words of the piece before, whose n-grams reach into this one
    text = 0  # of the first token
    for piece in _pieces(SENTINEL.join(texts)):
        found = TOKEN.findall(piece)
        tokens = carried + found
        places = np.arange(len(tokens))
        offsets = np.flatnonzero(np.fromiter(map(SENTINEL.__eq__, tokens), dtype=bool, count=len(tokens)))
        before = np.searchsorted(offsets, places, side="left")  # sentinels left of each token
        is_word = np.ones(len(tokens), dtype=bool)
        is_word[offsets] = False
        n_words += np.bincount(text + before[len(carried):][is_word[len(carried):]], minlength=len(texts))
        for n in range(1, longest + 1):
            start = max(len(carried) - n + 1, 0)
            if len(tokens) - n + 1 <= start:
                continue
            # Sentinels left of the first word and up to the last: alike only within one text.
            inside = (before[start:len(tokens) - n + 1] == np.searchsorted(
                offsets, places[start + n - 1:], side="right"))
            grams = zip(*(tokens[start + i:] for i in range(n))) if n > 1 else ((t,) for t in tokens[start:])
            keys = map(b" ".join, compress(grams, inside)) if n > 1 else compress(tokens[start:], inside)
            count = int(inside.sum())
            buckets.append(np.fromiter(map(memory.__getitem__, keys), dtype=np.int32, count=count))
            owners.append(text + before[start:len(tokens) - n + 1][inside])
        keep = max(len(tokens) - longest + 1, 0)
        text += int(before[keep]) if keep < len(tokens) else len(offsets)
        carried = tokens[keep:]
    owner = np.concatenate([np.zeros(0, dtype=np.int64), *owners])
    bucket = np.concatenate([np.zeros(0, dtype=np.int32), *buckets])
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order], n_words


def _hashed(batches: Iterator[pa.RecordBatch], longest: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """A row per text: id, number of words and of features, and its features' buckets as 32-bit numbers."""
    memory = _Buckets(n_buckets)
    for batch in portions(batches):
        texts = [(t or "").encode() for t in batch["text"].to_pylist()]
        owner, bucket, n_words = features(texts, longest, memory)
        counts = np.bincount(owner, minlength=len(texts))
        ends = np.concatenate([[0], np.cumsum(counts)])
        raw = bucket.astype("<i4")
        cells = [raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch["id"], pa.array(n_words), pa.array(counts.astype(np.int64)), pa.array(cells, type=pa.binary())],
            ["id", "n_words", "n_features", "buckets"])


def _counted(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The bucket counts of a task, one row per bucket that occurs."""
    total = np.zeros(n_buckets, dtype=np.int64)
    for batch in batches:
        for cell in batch["buckets"]:
            total += np.bincount(np.frombuffer(cell.as_buffer(), dtype="<i4"), minlength=n_buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def _weighed(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [int(gains[np.frombuffer(cell.as_buffer(), dtype="<i4")].sum()) for cell in batch["buckets"]]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["n_words"], batch["n_features"],
                                          pa.array(sums, type=pa.int64())],
                                         ["id", "n_words", "n_features", "weight"])


def hashed_features(df: DataFrame, longest: int, n_buckets: int, text: str = "text",
                    doc_id: str | None = None) -> DataFrame:
    """id (null without ``doc_id``), n_words, n_features and the buckets of each text's features, written down."""
    rows = df.select((F.col(doc_id) if doc_id else F.lit(None).cast("long")).alias("id"),
                     lower_ascii(F.col(text)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return saved(in_arrow(rows, lambda b: _hashed(b, longest, n_buckets),
                          f"id {kind}, n_words long, n_features long, buckets binary"), "features")


def bucket_counts(hashed: DataFrame, n_buckets: int) -> np.ndarray:
    """How often each bucket occurs. Tasks count for themselves; the driver gets one row per bucket at most."""
    rows = (in_arrow(hashed.select("buckets"), lambda b: _counted(b, n_buckets), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(n_buckets, dtype=np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier a bucket is in the target), both smoothed by one."""
    n = len(raw)
    ratio = ((target + 1).astype(np.float64) * float(raw.sum() + n)) / (
        (raw + 1).astype(np.float64) * float(target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, n_buckets: int = 10_000, least_words: int = 20,
             percent: int = 10, seed: int = 2024, text: str = "text", doc_id: str = "doc_id",
             target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Of the N documents with ``least_words`` words or more, floor(percent * N / 100) of the highest scores are drawn; ties
    go to the smaller id. A null or empty text has no features and weighs 0; a null id is hashed as an empty one and
    comes last among ties. Repeated rows are judged, and drawn, each; rows alike in id and score tie by weight and
    number of features, beyond which they are interchangeable. An empty target gives every bucket a count of 0, an empty
    table an empty result; other columns are ignored. Sums of gains are whole numbers, so reruns agree.
    """
    mine = hashed_features(docs, longest, n_buckets, text, doc_id)
    theirs = hashed_features(target, longest, n_buckets, target_text)
    gains = bucket_gains(bucket_counts(mine, n_buckets), bucket_counts(theirs, n_buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket
    kind = mine.schema["id"].dataType.simpleString()
    judged = saved(in_arrow(mine, lambda b: _weighed(b, shared.value),
                            f"id {kind}, n_words long, n_features long, weight long")
                   .withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "resample-scores")
    eligible = judged.where(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("weight"), F.asc("n_features")]
    placed = ranked(eligible, order, "place").withColumn("place", F.col("place") + 1)
    rest = judged.where(F.col("n_words") < least_words).withColumn("place", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(
        F.col("id").alias("doc_id"), "n_features", "weight", "score",
        F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
