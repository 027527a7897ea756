"""Benchmark decontamination by winnowing.

Words are hashed; of every window of six 5-grams the least hash is a fingerprint, so any ten words that two texts share
give both the same one. Training fingerprints join the benchmark's and each hit is extended to both sides, word by word;
runs of ten or more equal words are hits. Items of fewer words are one n-gram each, looked for at every place. A Bloom
filter of fixed size, made of the benchmark's fingerprints, keeps most others from leaving the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.bits import filter_of, passes
from metricloom.llm.common import in_arrow, saved
from metricloom.llm.words import Words, portions

WINDOW, GRAM = 10, 5
CANDIDATE = pa.struct([("kind", pa.int32()), ("hash", pa.int64()), ("at", pa.int64()), ("middle", pa.string()),
                       ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
FOUND = ("row long, id {kind}, n_words long, found array<struct<kind: int, hash: long, at: long, middle: string, "
         "before: array<string>, after: array<string>>>")


def winnowed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the 5-grams that are least in a window; of equal ones all, so both texts agree."""
    grams, whole = words.grams(GRAM), words.within(WINDOW)
    steps = WINDOW - GRAM + 1
    if not len(whole):
        return np.zeros(0, dtype=np.int64), grams[:0]
    least = grams[:len(whole)].copy()
    for i in range(1, steps):
        np.minimum(least, grams[i:len(whole) + i], out=least)
    chosen = np.zeros(len(grams), dtype=bool)
    for i in range(steps):
        chosen[i:len(whole) + i] |= whole & (grams[i:len(whole) + i] == least)
    at = np.flatnonzero(chosen)
    return at, grams[at]


def _candidates(words: Words, texts: np.ndarray, at: np.ndarray, hashes: np.ndarray, kind: int) -> list[tuple]:
    """(text, candidate) with up to WINDOW - GRAM words on both sides, the nearest first; none for short items."""
    n, reach = (kind, 0) if kind else (GRAM, WINDOW - GRAM)
    out = []
    for text, i, h in zip(texts.tolist(), at.tolist(), hashes.view(np.int64).tolist()):
        low, high = max(words.first[text], i - reach), min(words.first[text + 1], i + n + reach)
        out.append((text, {"kind": kind, "hash": h, "at": i - int(words.first[text]),
                           "middle": " ".join(words.words(i, i + n)), "before": words.words(low, i)[::-1],
                           "after": words.words(i + n, high)}))
    return out


def _find(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None, kinds: list[int]) -> Iterator[pa.RecordBatch]:
    """A row per text with its number of words and its fingerprints: of items (no bits) all, else those that pass."""
    for batch in portions(batches):
        texts = [t or "" for t in batch["text"].to_pylist()]
        words = Words(texts)
        found: list[list[dict]] = [[] for _ in texts]
        for kind in (0, *kinds):
            if kind:
                at = np.flatnonzero(words.within(kind))
                hashes = words.grams(kind)[at]
                if bits is None:  # an item of few words has one window, itself
                    own = words.counts[words.text[at]] == kind
                    at, hashes = at[own], hashes[own]
            else:
                at, hashes = winnowed(words)
            if bits is not None:
                passed = passes(hashes, bits)
                at, hashes = at[passed], hashes[passed]
            for text, candidate in _candidates(words, words.text[at], at, hashes, kind):
                found[text].append(candidate)
        yield pa.RecordBatch.from_arrays(
            [batch["row"], batch["id"], pa.array(words.counts.astype(np.int64)),
             pa.array(found, type=pa.list_(CANDIDATE))], ["row", "id", "n_words", "found"])


def _equal_run(mine: str, theirs: str, reach: int) -> Column:
    """How many words agree from the nearest on."""
    run = F.lit(0)
    for i in reversed(range(reach)):
        run = F.when(F.get(mine, F.lit(i)) == F.get(theirs, F.lit(i)), run + 1).otherwise(0)
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  item_text: str = "text", item_id: str = "item_id"
                  ) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words. A word inside any occurrence of ten consecutive item words (of a shorter item: of all its
    words) is hit. Items of one id count once, those without id only through their hits. Repeated rows are judged each;
    an empty benchmark hits nothing; other columns are ignored.
    """
    def located(df: DataFrame, text_: str, id_: str) -> DataFrame:
        return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_).alias("id"),
                         F.col(text_).alias("text"))

    short = list(range(1, WINDOW))
    questions = located(benchmark, item_text, item_id)
    items = saved(in_arrow(questions, lambda b: _find(b, None, short),
                           FOUND.format(kind=questions.schema["id"].dataType.simpleString()))
                  .select(F.col("id").cast("string").alias("item"), F.explode("found").alias("f"))
                  .select("item", "f.*"), "benchmark-fingerprints")
    kinds = sorted(r[0] for r in items.where("kind > 0").select("kind").distinct().collect())
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(items, F.col("hash")))
    rows = located(docs, text, doc_id)
    scanned = saved(in_arrow(rows, lambda b: _find(b, bits.value, kinds),
                             FOUND.format(kind=rows.schema["id"].dataType.simpleString())), "fingerprints")
    mine = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    theirs = items.select("item", "kind", "hash", F.col("middle").alias("middle_"), F.col("before").alias("before_"),
                          F.col("after").alias("after_"))
    reach = WINDOW - GRAM
    hits = (mine.join(theirs, ["kind", "hash"]).where("middle = middle_")
            .withColumns({"left": _equal_run("before", "before_", reach),
                          "right": _equal_run("after", "after_", reach)})
            .where(f"kind > 0 OR left + right >= {reach}")
            .select("row", "item", F.struct((F.col("at") - F.col("left")).alias("start"), (
                F.col("at") + F.when(F.col("kind") > 0, F.col("kind")).otherwise(GRAM)
                + F.col("right")).alias("end")).alias("span")))
    per_row = hits.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"),
                                      F.array_sort(F.collect_set("item")).alias("items"))
    # Spans sorted by start: each adds what lies behind the furthest end so far.
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
                          lambda acc, s: F.struct(
                              (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(
                                  s["start"], acc["end"]))).alias("n"),
                              F.greatest(acc["end"], s["end"]).alias("end")))["n"]
    none = F.array().cast("array<string>")
    out = (scanned.select("row", "id", "n_words").join(per_row.select("row", covered.alias("n_hit"), "items"), "row",
                                                       "left")
           .withColumn("items", F.coalesce("items", none)))
    return out.select(F.col("id").alias("doc_id"), "n_words",
                      F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"))
