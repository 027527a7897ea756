"""Near-duplicates by ProbMinHash, banding and verification.

A document's distinct shingles of five words are Poisson processes: each draws exponential arrivals at the rate of its
count, every arrival falls into a register, and a register keeps the shingle that came first. A shingle stops once its
next arrival is later than all registers of its document. Two registers agree with the probability Jaccard of the
weighted sets. Pairs are accepted by the Jaccard similarity of the plain sets, which a passage repeated often can set far
apart from it; so texts whose shingles repeat also bring the bands of equal weights, and none of these pairs is lost. For
all other texts the two are one. Bands of registers give buckets; every document is compared with the centre of each of
its buckets. Where that leaves a bucket unconnected, a prefix join finds the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.bits import filter_of, passes
from metricloom.llm.common import in_arrow, saved
from metricloom.llm.words import MIX, Words, mixed, portions

SHINGLE = 5
REGISTERS, BANDS, ROWS = 128, 25, 5
#: Shingles that one round of arrivals handles at once.
SLICE = 1 << 20


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash (52 bits) and count of each text's distinct shingles, in order of text.

    A text of one to four words is one shingle.
    """
    keep = np.uint64((1 << 52) - 1)
    place = np.flatnonzero(words.within(SHINGLE))
    text, value = words.text[place], words.grams(SHINGLE)[place] & keep
    for n in range(1, SHINGLE):
        few = words.first[:-1][words.counts == n]
        if len(few):
            text = np.concatenate([text, words.text[few]])
            value = np.concatenate([value, words.grams(n)[few] & keep])
    if not len(value):
        return text, value, np.zeros(0, dtype=np.int64)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])])
    first = np.flatnonzero(new)
    return text[first], value[first], np.diff(np.append(first, len(value)))


def registers(text: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """For each text and register, the shingle that arrived first (0 where a text has none)."""
    first = np.full(texts * REGISTERS, np.inf)
    owner = np.zeros(texts * REGISTERS, dtype=np.uint64)
    time, turn = np.zeros(len(value)), 0
    while len(value):
        turn += 1
        with np.errstate(over="ignore"):
            drawn = mixed(value + MIX * np.uint64(turn))
        time = time - np.log(((drawn >> np.uint64(12)) + 0.5) / (1 << 52)) / weight
        slot = text * REGISTERS + (drawn & np.uint64(REGISTERS - 1)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        owner[slot[won]] = value[won]
        alive = time < first.reshape(texts, REGISTERS).max(axis=1)[text]
        text, value, weight, time = text[alive], value[alive], weight[alive], time[alive]
    return owner.reshape(texts, REGISTERS)


def _parts(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, n in enumerate(counts.tolist()):
        if i > start and (total + n > SLICE or i - start >= 2048):
            yield start, i
            start, total = i, 0
        total += n
    if len(counts) > start:
        yield start, len(counts)


def _band_hashes(owner: np.ndarray) -> np.ndarray:
    out = np.zeros((len(owner), BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            h = np.full(len(owner), band, dtype=np.uint64)
            for column in range(band * ROWS, (band + 1) * ROWS):
                h = mixed(h * MIX + owner[:, column])
            out[:, band] = h
    return out


def band_hashes(text: np.ndarray, value: np.ndarray, count: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of each text by its counts, then by equal weights, and which of them it brings.

    Bands of both kinds meet in the same buckets. A text without shingles brings none, one whose shingles occur once
    each the first half, any other all that differ.
    """
    weighted = _band_hashes(registers(text, value, count.astype(np.float64), texts))
    plain, some = weighted.copy(), np.bincount(text, minlength=texts) > 0
    again = np.bincount(text, weights=count > 1, minlength=texts) > 0
    if again.any():
        own = again[text]
        plain[again] = _band_hashes(registers((np.cumsum(again) - 1)[text[own]], value[own], np.ones(own.sum()),
                                              int(again.sum())))
    return (np.concatenate([weighted, plain], axis=1),
            np.concatenate([np.repeat(some[:, None], BANDS, axis=1), weighted != plain], axis=1))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, two hashes of the shingle multiset, band hashes. A text without words has no bands, and its plain hash."""
    for batch in portions(batches):
        texts = [t or "" for t in batch["text"].to_pylist()]
        words = Words(texts)
        text, value, count = shingles(words)
        sizes = np.bincount(text, minlength=len(texts))
        edge = np.concatenate([[0], np.cumsum(sizes)])
        bands = np.zeros((len(texts), 2 * BANDS), dtype=np.uint64)
        brought = np.zeros((len(texts), 2 * BANDS), dtype=bool)
        marks = np.zeros((2, len(texts)), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i, salt in enumerate((1, 2)):
                np.add.at(marks[i], text, mixed(value * MIX + np.uint64(salt)) * count.astype(np.uint64))
        for a, b in _parts(sizes):
            own = slice(edge[a], edge[b])
            bands[a:b], brought[a:b] = band_hashes(text[own] - a, value[own], count[own], b - a)
        marks[1] = np.where(sizes > 0, marks[1], batch["plain"].to_numpy().view(np.uint64))
        offsets = np.concatenate([[0], np.cumsum(brought.sum(axis=1))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch["row"], pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[brought].view(np.int64)))],
            ["row", "mark", "mark2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """row and its distinct shingles, of the rows that pass the filter."""
    for batch in portions(batches):
        batch = batch.filter(pa.array(passes(batch["hash"].to_numpy().view(np.uint64), bits)))
        texts = [t or "" for t in batch["text"].to_pylist()]
        text, value, _ = shingles(Words(texts))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch["row"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))],
            ["row", "shingles"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the graph of links (a, b): root is the least node that can be reached.

    Large-star and small-star steps alternate until nothing changes. Minima are combined before they move, and each
    round is written to the shared folder.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
                  .distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.where("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b")))
        edges = saved(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    left = sets.select(F.col("row").alias("a"), F.col("shingles").alias("mine"))
    right = sets.select(F.col("row").alias("b"), F.col("shingles").alias("theirs"))
    common = F.size(F.array_intersect("mine", "theirs"))
    return (pairs.join(left, "a").join(right, "b").withColumn("common", common)
            .where(F.col("common") >= least * (F.size("mine") + F.size("theirs") - F.col("common")) - 1e-9)
            .select("a", "b"))


def _left_over(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of members (row, root) in different components that can be similar, by prefixes.

    With shingles in order of rarity, two sets of similarity ``least`` share one so early that what is left behind it on
    both sides still reaches the overlap they need. A shingle's main component is not compared with itself, so a group
    that is linked already makes no pairs.
    """
    rows = members.join(sets, "row").select("row", "root", F.size("shingles").alias("n"),
                                            F.explode("shingles").alias("shingle"))
    common = rows.groupBy("shingle").agg(F.count("*").alias("rows"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("rows", "shingle"))
    early = saved(rows.join(common, "shingle").withColumn("place", place)
                  .where((F.col("place") <= F.floor(F.col("n") * (1 - least) + 1e-9) + 1) & (F.col("rows") > 1)),
                  "prefixes")
    sizes = early.groupBy("shingle", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("shingle").agg(F.max(F.struct("size", "root"))["root"].alias("main"),
                                        F.count("*").alias("roots")).where("roots > 1")
    met = early.join(main, "shingle")
    other = met.select("shingle", F.col("row").alias("row_"), F.col("root").alias("root_"), F.col("n").alias("n_"),
                       F.col("place").alias("place_"))
    needed = least / (1 + least) * (F.col("n") + F.col("n_")) - 1e-9
    rest = F.least(F.col("n") - F.col("place"), F.col("n_") - F.col("place_")) + 1
    pairs = met.where("root <> main").join(other, "shingle").where((F.col("root") != F.col("root_")) & (rest >= needed))
    return pairs.select(F.greatest("row", "row_").alias("a"), F.least("row", "row_").alias("b")).distinct()


def near_duplicates(docs: DataFrame, least: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, kept.

    Documents whose shingle sets have a Jaccard similarity of ``least`` or more are linked; a class is what links
    connect, class_id the least doc_id in it, and its row is kept (of equal ids the first). Texts of equal shingles are
    one class from the start. A text without words is linked to texts equal to it only; a null text is one of its own
    kind. A class of null ids has a null class_id. An empty table gives an empty result; other columns are ignored.
    """
    return classes(saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"),
                                     F.col(text).alias("text")), "near-rows"), least)


def classes(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """The same for rows (row, id, text) of a table that is written down, with a number of its own for each."""
    plain = F.when(F.col("text").isNull(), F.lit(-1)).otherwise(F.xxhash64("text")).alias("plain")
    sketch = saved(in_arrow(
        rows.select("row", plain, "text"), _sketch, "row long, mark long, mark2 long, bands array<long>"), "sketch")
    keyed = sketch.select("row", "mark", "mark2")
    # Written down, so that the join below is one of two plain tables, whose hot keys Spark can split.
    groups = saved(keyed.groupBy("mark", "mark2").agg(F.min("row").alias("head")), "equal")
    heads = saved(keyed.join(groups, ["mark", "mark2"]).select("row", "head"), "heads")

    first = sketch.join(heads.where("row = head").select("row"), "row", "left_semi")
    bands = first.select("row", F.explode("bands").alias("bucket"))  # a band's number is part of its hash
    # The centre of a bucket is the document that meets most others, so that it links as many as one can.
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(bands.join(sizes, "bucket"), "buckets")
    met = members.groupBy("row").agg(F.sum("n").alias("met"))
    centres = members.join(met, "row").groupBy("bucket").agg(
        F.max_by("row", F.struct("met", -F.col("row"))).alias("centre"))
    around = saved(members.join(centres, "bucket").where("row <> centre").select("bucket", "row", "centre"), "around")
    star = saved(around.select(F.greatest("row", "centre").alias("a"), F.least("row", "centre").alias("b")).distinct(),
                 "pairs")
    # A filter of fixed size keeps most other documents in the scan; the join drops those that it lets through.
    wanted = members.select("row").distinct()
    bits = rows.sparkSession.sparkContext.broadcast(filter_of(wanted, F.xxhash64("row")))
    sets = saved(in_arrow(rows.select("row", F.xxhash64("row").alias("hash"), "text"), lambda b: _sets(b, bits.value),
                          "row long, shingles array<long>").join(wanted, "row", "left_semi"), "sets")
    links = saved(_verified(star, sets, least), "links")
    roots = components(links)

    # Documents of one bucket that met its centre but not each other, where they are not connected yet.
    rooted = around.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn(
        "root", F.coalesce("root", "row"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_ = saved(rooted.join(several, "bucket").select("row", "root").distinct(), "open")
    found = saved(_verified(_left_over(open_, sets, least), sets, least), "links")
    if not found.isEmpty():
        roots = components(links.unionByName(found))

    placed = heads.join(roots.withColumnRenamed("node", "head"), "head", "left").select(
        "row", F.coalesce("root", "head").alias("root"))
    named = rows.select("row", "id").join(placed, "row")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
    return named.join(best, "root").select(F.col("id").alias("doc_id"), F.col("best.id").alias("class_id"),
                                           (F.col("row") == F.col("best.row")).alias("kept"))
