"""Removal of byte strings that occur more than once, anywhere, by run-length indexes.

Every string of LENGTH bytes belongs to one anchor, the least hash of GRAM bytes in it, so equal strings have equal
anchors. The strings of an anchor are dealt to cells of neighbouring starts, keyed by the bytes that all of a cell's
strings share: strings whose key occurs once can't repeat. Equal cells repeat as a whole. Different cells of one key are
met in a bin, whose run-length index tells which of their strings repeat; a key with too many of them is dealt to
smaller cells, down to single strings, which counting alone decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.bits import filter_of, passes
from metricloom.llm.common import in_arrow, saved
from metricloom.llm.run_index import build, repeated
from metricloom.llm.words import MIX, mixed, portions

GRAM = 32
#: Bytes that are hashed at once, and bytes of a bin on the average.
SLICE, BIN = 1 << 21, 1 << 20
#: Different cells that a key may bring into a bin; one with more is dealt to smaller cells.
KINDS = 2048
#: Starts of a cell, level by level.
WIDTHS = (64, 8, 1)

CELL = "key long, mark long, row long, place int, start int, size int"


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each place on, by doubling."""
    with np.errstate(over="ignore"):
        h, size, factor = mixed(data.astype(np.uint64) + MIX), 1, MIX
        while size < GRAM:
            h = h[:-size] * factor + h[size:]
            size, factor = size * 2, factor * factor
    return mixed(h)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each ``width`` neighbouring ones."""
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[:len(keys) - (width - size)], keys[width - size:]) if width > size else keys


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Text number, place and hash of the anchors of all texts, and the first and last start of the strings that each
    is the anchor of. Texts below ``length`` bytes have none."""
    out: list[tuple[np.ndarray, ...]] = []
    width, low_bits = length - GRAM + 1, np.uint64((1 << 22) - 1)

    def flush(numbers: list[int], offsets: list[int], parts: list[bytes]) -> None:
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        if len(data) < length:
            return
        hashes = _gram_hashes(data)
        least = _least((hashes & ~low_bits) | np.arange(len(hashes), dtype=np.uint64), width)
        ends = np.cumsum([len(p) for p in parts])
        part = np.searchsorted(ends, np.arange(len(least)), side="right")
        start = np.flatnonzero(np.arange(len(least)) + length <= ends[part])
        place = (least[start] & low_bits).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(start)) - 1
        own = part[start[first]]
        move = np.array(offsets)[own] - (ends - [len(p) for p in parts])[own]
        out.append((np.array(numbers)[own], place[first] + move, hashes[place[first]].view(np.int64),
                    start[first] + move, start[last] + move))

    numbers, offsets, parts, total = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), SLICE):  # slices of a long text overlap, so that each string is whole in one
            part = t[at:at + SLICE + length - 1]
            if len(part) < length:
                continue
            if total + len(part) > 3 * SLICE // 2:
                flush(numbers, offsets, parts)
                numbers, offsets, parts, total = [], [], [], 0
            numbers.append(i)
            offsets.append(at)
            parts.append(part)
            total += len(part)
    flush(numbers, offsets, parts)
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none,) * 5


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch["text"].to_pylist()]


def _find_anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        text, place, value, first, last = anchors(_bytes(batch), length)
        yield pa.RecordBatch.from_arrays(
            [batch["row"].take(pa.array(text)), pa.array(value),
             *(pa.array(x.astype(np.int32)) for x in (place, first, last))],
            ["row", "anchor", "place", "first", "last"])


def _passing(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array(passes(batch["hash"].to_numpy().view(np.uint64), bits))
        yield batch.select(["row", "text"]).filter(keep)


def _mark(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)


def _cells(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Deal the strings of each spot (place, first and last start) to cells of ``width`` starts.

    Cells lie on a grid from the anchor on. key: hash of the bytes that all strings of a whole cell share; mark: hash of
    the bytes that the spot's own strings in the cell cover, ``size`` bytes from ``start``.
    """
    reach = length - GRAM
    names = ("key", "mark", "row", "place", "start", "size")
    for batch in portions(batches):
        made: dict[str, list[int]] = {n: [] for n in names}
        for row, text, spots in zip(batch["row"].to_pylist(), _bytes(batch), batch["spots"].to_pylist()):
            for spot in spots:
                place, start = spot["place"], spot["first"]
                while start <= spot["last"]:
                    low = (start - place + reach) // width * width - reach
                    high = min(low + width - 1, 0)
                    stop = min(spot["last"], place + high)
                    core = text[place + high:place + low + length]
                    for name, value in zip(names, (_mark(core + low.to_bytes(4, "little", signed=True)),
                                                   _mark(text[start:stop + length]), row, place, start,
                                                   stop + length - start)):
                        made[name].append(value)
                    start = stop + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(made[n], pa.int64() if n in ("key", "mark", "row") else pa.int32()) for n in names], list(names))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each text's cells."""
    for batch in portions(batches):
        bins, rows, starts, contents = [], [], [], []
        for row, text, pieces in zip(batch["row"].to_pylist(), _bytes(batch), batch["pieces"].to_pylist()):
            for p in pieces:
                bins.append(p["bin"])
                rows.append(row)
                starts.append(p["start"])
                contents.append(text[p["start"]:p["start"] + p["size"]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(bins, pa.int64()), pa.array(rows, pa.int64()), pa.array(starts, pa.int32()),
             pa.array(contents, pa.binary())], ["bin", "row", "start", "content"])


def _index_bin(table: pa.Table, length: int) -> pa.Table:
    """(row, a, b): the stretches of a bin's cells that repeat."""
    cells = sorted(zip(table["row"].to_pylist(), table["start"].to_pylist(), table["content"].to_pylist()))
    segments: list[bytearray] = []
    first: list[tuple[int, int, int]] = []  # row, where the segment starts in its text, where in the index
    where, total = [], 0
    for row, start, content in cells:  # cells of one text that overlap become one segment, so nothing meets itself
        end = first[-1][1] + len(segments[-1]) if first else -1
        if not first or first[-1][0] != row or start > end:
            total += len(segments[-1]) + 1 if segments else 0
            segments.append(bytearray(content))
            first.append((row, start, total))
        elif start + len(content) > end:
            segments[-1] += content[end - start:]
        where.append(first[-1][2] + start - first[-1][1])
    start, stop = repeated(build([bytes(s) for s in segments]), length)
    out: dict[str, list[int]] = {"row": [], "a": [], "b": []}
    for (row, begin, content), at in zip(cells, where):
        last = at + len(content) - length + 1
        for i in range(np.searchsorted(stop, at, side="right"), np.searchsorted(start, last, side="left")):
            out["row"].append(row)
            out["a"].append(int(max(start[i], at)) - at + begin)
            out["b"].append(int(min(stop[i], last)) - 1 - at + begin + length)
    return pa.table({"row": pa.array(out["row"], pa.int64()), "a": pa.array(out["a"], pa.int32()),
                     "b": pa.array(out["b"], pa.int32())})


def _repeats(cells: DataFrame, texts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(row, a, b) of the repeated stretches in cells, and the texts with the spots that need smaller cells."""
    kinds = saved(cells.groupBy("key", "mark").agg(
        F.count("*").alias("n"), F.min(F.struct("row", "place", "start", "size")).alias("first")), "cell-kinds")
    alike = kinds.where("n > 1").select("key", "mark")
    whole = cells.join(alike, ["key", "mark"]).select("row", F.col("start").alias("a"),
                                                      (F.col("start") + F.col("size")).alias("b"))
    # Cells of a kind that occurs twice are done; for the others the first of each kind speaks.
    several = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    met = saved(kinds.join(several, "key").select("key", "kinds", "first.*"), "cells-met")
    volume = met.where(F.col("kinds") <= KINDS).agg(F.sum("size")).first()[0] or 0
    bins = max(1, -(-volume // BIN))
    pieces = met.where(F.col("kinds") <= KINDS).groupBy("row").agg(F.collect_list(F.struct(
        F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin"), "start", "size")).alias("pieces"))
    found = in_arrow(texts.select("row", "text").join(pieces, "row"), _pieces,
                     "bin long, row long, start int, content binary")
    # A key lies in one bin and brings KINDS cells at most, so bins are bounded.
    found = found.groupBy("bin").applyInArrow(lambda t: _index_bin(t, length), "row long, a int, b int")
    spots = met.where(F.col("kinds") > KINDS).groupBy("row").agg(F.collect_list(F.struct(
        "place", F.col("start").alias("first"), (F.col("start") + F.col("size") - length).alias("last"))).alias("spots"))
    return saved(found.unionByName(whole).distinct(), "repeats"), spots


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, bytes removed, maximal runs of them, SHA-256 of the rest."""
    for batch in portions(batches):
        gone, runs, digests = [], [], []
        for text, spans in zip(_bytes(batch), batch["spans"].to_pylist()):
            kept, at, n, count = hashlib.sha256(), 0, 0, 0
            last = -1
            for s in sorted((s["a"], s["b"]) for s in spans):
                count += s[0] > last
                kept.update(text[at:max(at, s[0])])
                n += max(0, s[1] - max(at, s[0]))
                at = last = max(at, s[1])
            kept.update(text[at:])
            gone.append(n)
            runs.append(count)
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(gone, pa.int64()), pa.array(runs, pa.int64()),
                                          pa.array(digests, pa.string())],
                                         ["row", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, length: int = 400, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the UTF-8 texts without their repeated bytes.

    Every byte in a string of ``length`` bytes that also starts anywhere else, in the same text or another, goes; all
    strings are judged on the texts as given. A null text is empty; shorter texts stay whole. Equal texts of at least
    ``length`` bytes go entirely. Repeated rows count as copies; an empty table gives an empty result; other columns
    are ignored.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"),
                             content.cast("binary").alias("text")), "repeat-rows")
    facts = saved(rows.select("row", "id", F.octet_length("text").cast("long").alias("n_bytes"),
                              F.sha2("text", 256).alias("digest")), "repeat-facts")
    heads = saved(facts.groupBy("digest").agg(F.min("row").alias("head"), F.count("*").alias("copies"),
                                              F.min("n_bytes").alias("n_bytes")), "repeat-heads")
    found = saved(in_arrow(rows.select("row", "text"), lambda b: _find_anchors(b, length),
                           "row long, anchor long, place int, first int, last int"), "anchors")
    single = found.join(heads.select(F.col("head").alias("row")), "row", "left_semi")
    # Written down, so that the join below is one of two plain tables, whose hot keys Spark can split.
    twice = saved(single.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors-met")
    spots = saved(single.join(twice, "anchor").groupBy("row").agg(
        F.collect_list(F.struct("place", "first", "last")).alias("spots")), "spots")
    # A filter of fixed size keeps most texts without such anchors in the scan.
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(spots, F.xxhash64("row")))
    likely = in_arrow(rows.select("row", F.xxhash64("row").alias("hash"), "text"), lambda b: _passing(b, bits.value),
                      "row long, text binary")
    near = saved(likely.join(spots, "row"), "repeat-texts")
    cells = saved(in_arrow(near, lambda b: _cells(b, length, WIDTHS[0]), CELL), "cells")
    spans, many = _repeats(cells, near, length)
    for width in WIDTHS[1:]:
        many = saved(near.select("row", "text").join(many, "row"), "repeat-spots")
        if many.isEmpty():
            break
        cells = saved(in_arrow(many, lambda b, w=width: _cells(b, length, w), CELL), "cells")
        more, many = _repeats(cells, near, length)
        spans = spans.unionByName(more)
    by_row = spans.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    cut = in_arrow(near.select("row", "text").join(by_row, "row"), _removed, (
        "row long, n_removed long, n_spans long, kept_sha256 string"))
    none = F.lit(0).cast("long")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    judged = heads.join(cut.withColumnRenamed("row", "head"), "head", "left").select(
        "digest", F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(copied, none + 1).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(copied, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"))
    return facts.join(judged, "digest").select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                                               "kept_sha256")
