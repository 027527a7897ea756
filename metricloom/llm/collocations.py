"""Phrase collocations by dynamic itemset counting.

The documents are dealt to shards, which are scanned in a cycle. Phrases of all lengths are counted at once: words from
the first scan on, a longer phrase from the scan after both of its subphrases (all words but the last, all but the
first) have reached the threshold, and each for one full cycle of shards, so that its count is complete.

Tasks know when a subphrase reached it from a table of bounded size with a slot for many phrases: that of the first one
that did. A phrase may so begin its cycle earlier, or be counted though it can't be frequent, but its cycle is a full
one all the same. Counts stay in tables that tasks write and read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import in_arrow, saved
from metricloom.llm.words import MIX, PORTION, Words, mixed, portions

# What ends a piece, and the bytes that are in no word.
BREAK = re.compile("[.,;:!?\x0A-\x0D]")
_CODES = np.arange(256)
_IS_BREAK = np.isin(_CODES, np.frombuffer(b".,;:!?\x0A\x0B\x0C\x0D", dtype=np.uint8))
_IN_WORD = ~_IS_BREAK & (_CODES != 0x20) & (_CODES != 0x09)

#: Between a language and a phrase; no word holds one.
TAB = "\t"
#: Keys that are put together at once.
KEYS = 1 << 16
COUNTED = "key string, start int, n long"
#: A slot that no phrase of the threshold has.
NEVER = 255
#: The table has 2**22 slots at most, whatever the number of phrases.
MOST_SLOTS = 22


def _one_space(text: str) -> str:
    """The text with one space for each run of spaces and tabs; each pass halves the longest run."""
    text = text.replace("\x09", " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def _parts(langs: list[str], texts: list[str | None]) -> Iterator[tuple[list[str], list[str]]]:
    """Texts with one space between words, gathered up to a portion; longer ones are cut where a piece ends."""
    some_langs, some, size = [], [], 0
    for lang, text in zip(langs, texts):
        text = _one_space(text or "")
        at = 0
        while at < len(text):
            edge = BREAK.search(text, at + PORTION)
            stop = edge.end() if edge else len(text)
            some_langs.append(lang)
            some.append(text[at:stop])
            size += stop - at
            at = stop
            if size >= PORTION:
                yield some_langs, some
                some_langs, some, size = [], [], 0
    if some:
        yield some_langs, some


def _salt(langs: np.ndarray) -> np.ndarray:
    """A hash of each language."""
    return Words([f"x{lang.encode().hex()}" for lang in langs]).hash


def _slot(total: np.ndarray, salt: np.ndarray, n: int, slots: int) -> np.ndarray:
    return (mixed(total * MIX + salt + np.uint64(n)) & np.uint64(slots - 1)).astype(np.int64)


def _counts(words: Words, salt: np.ndarray, scan: int, shards: int, longest: int, times: np.ndarray | None
            ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, first word, start of its cycle, count) of the phrases that are counted in this scan."""
    piece = np.cumsum(_IS_BREAK[words.bytes], dtype=np.int64)[words.start]
    salt = salt[words.text]
    total = np.zeros(len(words.start), dtype=np.uint64)
    start = np.ones(len(words.start), dtype=np.int32)  # words are counted from the first scan on
    for n in range(1, longest + 1):
        last = len(words.start) - n + 1
        if last < 1:
            return
        with np.errstate(over="ignore"):
            total = total[:last] * MIX + words.hash[n - 1:]
        whole = (piece[:last] == piece[n - 1:]) & (words.text[:last] == words.text[n - 1:])
        at = np.flatnonzero(whole & (start <= scan) & (start + shards > scan))
        with np.errstate(over="ignore"):
            keys = mixed(total[at] + salt[at])
        _, first, times_ = np.unique(keys, return_index=True, return_counts=True)
        yield n, at[first], start[at[first]], times_
        if times is None or n == longest:
            return
        with np.errstate(over="ignore"):
            reached = times[_slot(total, salt[:last], n, len(times))].astype(np.int32)
        start = np.maximum(reached[:-1], reached[1:]) + 1


def _keys(source: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Strings of two stretches of the bytes each: starts and lengths of shape strings x 2."""
    start, length = start.ravel(), length.ravel()
    edges = np.concatenate([[0], np.cumsum(length)])
    taken = source[np.repeat(start - edges[:-1], length) + np.arange(edges[-1])]
    return pa.StringArray.from_buffers(len(start) // 2, pa.py_buffer(edges[::2].astype(np.int32)), pa.py_buffer(taken))


def _scan(batches: Iterator[pa.RecordBatch], scan: int, shards: int, longest: int, times: np.ndarray | None
          ) -> Iterator[pa.RecordBatch]:
    columns = ["key", "start", "n"]
    for batch in portions(batches):
        for langs, texts in _parts(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            words = Words(texts, member=_IN_WORD)
            names, code = np.unique(langs, return_inverse=True)
            heads = [(name + TAB).encode() for name in names.tolist()]
            size = np.array([len(head) for head in heads])
            source = np.concatenate([np.frombuffer(b"".join(heads), dtype=np.uint8), words.bytes])
            for n, first, start, found in _counts(words, _salt(names)[code], scan, shards, longest, times):
                for at in range(0, len(first), KEYS):
                    some = first[at:at + KEYS]
                    lang, begin = code[words.text[some]], words.start[some]
                    key = _keys(source, np.stack([(np.cumsum(size) - size)[lang], size.sum() + begin], axis=1),
                                np.stack([size[lang], words.end[some + n - 1] - begin], axis=1))
                    yield pa.RecordBatch.from_arrays([key, pa.array(start[at:at + KEYS]),
                                                      pa.array(found[at:at + KEYS].astype(np.int64))], columns)
            if scan <= shards:  # all words of a language: how often the empty phrase occurs
                every = np.bincount(code, weights=words.counts, minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name + TAB for name in names.tolist()], type=pa.string()),
                     pa.array(np.ones(len(names), dtype=np.int32)), pa.array(every)], columns)


def _slots(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """The slot of each phrase, as _counts() works it out."""
    for batch in batches:
        langs, texts = (batch[c].to_pylist() for c in ("lang", "phrase"))
        words = Words(texts, member=_IN_WORD)
        names, code = np.unique(langs, return_inverse=True)
        out, salt = np.zeros(len(texts), dtype=np.int64), _salt(names)[code]
        total = np.zeros(len(texts), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, int(words.counts.max(initial=0)) + 1):
                on = np.flatnonzero(words.counts >= n)
                total[on] = total[on] * MIX + words.hash[words.first[on] + n - 1]
                ends = np.flatnonzero(words.counts == n)
                out[ends] = _slot(total[ends], salt[ends], n, slots)
        yield pa.RecordBatch.from_arrays([pa.array(out)], ["slot"])


def _phrase(key: Column) -> Column:
    return F.substring_index(key, TAB, -1)


def _named(table: DataFrame) -> DataFrame:
    """lang, phrase and length (in words) from the key."""
    phrase = _phrase(F.col("key"))
    return table.withColumns({
        "phrase": phrase, "lang": F.substring(F.col("key"), F.lit(1), F.length("key") - F.length(phrase) - 1),
        "length": F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))}).drop("key")


def frequent_phrases(docs: DataFrame, longest: int, least: int, shards: int) -> DataFrame:
    """(lang, length, phrase, a) of all phrases that occur ``least`` times or more in (lang, text), and of words.

    The phrase of length 0 bears the number of all words of a language.
    """
    dealt = saved(docs.withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int")), "phrase-shards",
                  by="shard")
    context = docs.sparkSession.sparkContext
    table, times, latest = None, None, 0
    for scan in range(1, NEVER):
        known = context.broadcast(times)
        # Defaults bind what this scan is to use; the frames are only run when they are written.
        counted = in_arrow(dealt.where(F.col("shard") == (scan - 1) % shards).select("lang", "text"),
                           lambda batches, scan=scan, known=known: _scan(batches, scan, shards, longest, known.value),
                           COUNTED).withColumn("reach", F.lit(None).cast("int"))
        grown = ((table.unionByName(counted) if table is not None else counted).groupBy("key").agg(
            F.sum("n").alias("n"), F.min("start").alias("start"), F.min("reach").alias("reach")))
        reach = F.coalesce("reach", F.when((F.col("n") >= least) & (_phrase(F.col("key")) != ""), F.lit(scan)))
        # A phrase whose cycle has ended below the threshold is forgotten.
        table = saved(grown.withColumn("reach", reach).where(
            (_phrase(F.col("key")) == "") | F.col("reach").isNotNull() | (F.col("start") + shards > scan + 1)), "phrases")
        known.destroy()
        if times is None:  # so many slots that few phrases share one
            times = np.full(1 << min(MOST_SLOTS, max(12, (16 * table.count()).bit_length())), NEVER, dtype=np.uint8)
        fresh = _named(table.where(F.col("reach") == scan)).where(F.col("length") < longest).select("lang", "phrase")
        found = in_arrow(fresh, lambda batches, n=len(times): _slots(batches, n), "slot long").distinct().toArrow()
        slots = found["slot"].to_numpy()
        times[slots] = np.minimum(times[slots], scan)
        latest = scan if len(slots) else latest
        if scan >= max(shards, latest + shards):  # no cycle is going on, and none begins
            break
    return _named(table.where("reach IS NOT NULL OR start = 1")).where("reach IS NOT NULL OR length = 0").select(
        "lang", "length", "phrase", F.col("n").alias("a"))


def _head(phrase: Column, k: Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), k)


def _behind(phrase: Column, head: Column) -> Column:
    """What follows ``head`` and a space."""
    return F.substring(phrase, F.length(head) + 2, F.length(phrase))


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, share: int = 100, top: int = 2000,
                 shards: int = 2, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Of a phrase's cuts the one of lowest score counts, the first of equal ones. Phrases that lie inside a longer one
    which occurs ``share`` percent as often or more are dropped. A null language is ``und``; null and empty texts have no
    words; repeated rows count each; an empty table gives an empty result; other columns are ignored. Scores are whole
    numbers from decimals of 38 digits: exact up to 10**16 words of a language. Within one portion of a task phrases are
    told apart by 64-bit hashes, across portions by their text. A text is held a portion at a time, a piece of it whole.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    found = frequent_phrases(rows, longest, least, shards)
    parts = found.where("length > 0")
    candidates = found.where("length > 1")
    cuts = (candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
            .withColumn("head", _head(F.col("phrase"), F.col("k")))
            .withColumn("tail", _behind(F.col("phrase"), F.col("head"))))
    cuts = (cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
            .join(parts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
            .join(found.where("length = 0").select("lang", F.col("a").alias("n")), "lang"))
    score = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(16, 0)) * CAST(n AS DECIMAL(16, 0)))"
                   " div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(18, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    inner = F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda m: F.transform(
        F.sequence(F.lit(0), F.col("length") - m), lambda i: F.array_join(
            F.slice(F.split("phrase", " "), i + 1, m), " ")))
    inside = (candidates.where("length > 2").select("lang", "a", F.explode(F.array_distinct(F.flatten(inner))).alias(
        "phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    kept = best.join(inside, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
