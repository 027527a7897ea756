"""Secret scans: patterns of known kinds, and sliding-window entropy over strings that could be keys.

A candidate is a long run of key characters. A window slides over it; the counts of its characters change by one that
enters and one that leaves, so the sum of c * log2(c) over them is carried on in whole numbers. Windows are judged by
their character class: hexadecimal ones, ones with letters and digits, and ones of letters alone need different
entropies, digits alone never suffice. Runs of windows that pass are spans, unless an allow-list knows the candidate.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import saved

# The patterns of the known kinds. Whole runs are matched, so a least length within the pattern of the
# last two gives the same spans as one that is asked for afterwards.
ASSIGN = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")

#: A candidate: key characters, as many as a window at least.
WINDOW = 24
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
#: Least entropy of a window by class, in bits. Random windows of 24 reach 3.4, 4.0 and 4.2 on average.
LEAST_BITS = {"hex": 3.1, "mixed": 3.8, "letters": 4.1}
#: Candidates that are no keys: runs in order and placeholders, addresses behind their scheme, UUIDs.
ALLOWED = (r"(?i)abcdefghij|0123456789|1234567890|qwertyuiop|example|placeholder|lorem", r"^//",
           r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")
#: Nor are words and numbers joined by signs: every part between signs is one of these.
SIGNS, PLAIN_PART = r"[+/_=-]+", r"^([A-Z]?[a-z]*|[A-Z]+|[0-9]+)$"
#: Windows of a candidate that are judged in one row.
PIECE = 4096
#: Entropy is summed in millionths of a bit.
UNIT = 1_000_000
_MARKS = "\x01\x02"


def _marked(text: str, pattern: str) -> Column:
    """What lies between and in the matches of a pattern, in turn: every second piece is a match."""
    return F.split(F.regexp_replace(F.col(text), F.lit(pattern), F.lit(f"{_MARKS[0]}$0{_MARKS[1]}")), f"[{_MARKS}]")


def _terms(most: int) -> Column:
    """c * log2(c) for c from 0, in whole units."""
    return F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0).cast("long") for c in range(most + 1)])


def _steps(window: int, least_bits: dict[str, float]) -> Column:
    """Starts of the windows of ``piece`` (its characters, ``chars``) that pass, runs of them joined: (start, end).

    The state holds the sum over the current window, the counts of its classes, and the runs found so far.
    """
    terms, chars = F.col("terms"), F.col("chars")
    # entropy = log2(w) - sum / w: the least entropy of a class is a largest sum.
    most = {k: math.floor((math.log2(window) - v) * window * UNIT) for k, v in least_bits.items()}
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    state = F.struct(zero.alias("sum"), zero.alias("digits"), zero.alias("other"), zero.alias("letters"),
                     none.alias("start"), none.alias("end"),
                     F.array().cast("array<struct<start: bigint, end: bigint>>").alias("runs"))

    def is_in(c: Column, pattern: str) -> Column:
        return c.rlike(pattern).cast("long")

    def occurrences(c: Column, low: Column, n: Column) -> Column:
        return F.size(F.filter(F.slice(chars, low, n), lambda x: x == c))

    def step(acc: Column, i: Column) -> Column:  # i: place of the entering character, from 1
        entering = F.element_at(chars, i)
        full = i > window
        leaving = F.when(full, F.element_at(chars, F.greatest(i - window, F.lit(1))))
        low = F.greatest(i - window + 1, F.lit(1))
        # Without the leaving one, then with the entering one.
        out = F.when(full, occurrences(leaving, low - 1, F.lit(window))).otherwise(0)
        inside = F.when(i > 1, occurrences(entering, low, F.greatest(i - low, F.lit(0)))).otherwise(0)
        total = (acc["sum"] - F.when(full, F.get(terms, out) - F.get(terms, out - 1)).otherwise(zero)
                 + F.get(terms, inside + 1) - F.get(terms, inside))
        gone = lambda p: F.when(full, is_in(leaving, p)).otherwise(zero)
        digits = acc["digits"] + is_in(entering, "[0-9]") - gone("[0-9]")
        other = acc["other"] + is_in(entering, "[^0-9A-Fa-f]") - gone("[^0-9A-Fa-f]")
        letters = acc["letters"] + is_in(entering, "[A-Za-z]") - gone("[A-Za-z]")
        limit = (F.when(letters == 0, none)
                 .when((other == 0) & (digits > 0), F.lit(most["hex"]))
                 .when(digits > 0, F.lit(most["mixed"])).otherwise(F.lit(most["letters"])))
        hit = (i >= window) & (total <= limit)
        begins = i - window
        joined = hit & (acc["end"] >= begins)
        closed = hit & ~joined & (acc["end"] >= 0)
        run = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
        return F.struct(total.alias("sum"), digits.alias("digits"), other.alias("other"), letters.alias("letters"),
                        F.when(joined, acc["start"]).when(hit, begins.cast("long")).otherwise(acc["start"]).alias(
                            "start"),
                        F.when(hit, i.cast("long")).otherwise(acc["end"]).alias("end"),
                        F.when(closed, F.concat(acc["runs"], run)).otherwise(acc["runs"]).alias("runs"))

    def finish(acc: Column) -> Column:
        last = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
        return F.when(acc["end"] >= 0, F.concat(acc["runs"], last)).otherwise(acc["runs"])

    return F.aggregate(F.sequence(F.lit(1), F.size(chars)), state, step, finish)


def entropy_spans(candidates: DataFrame, window: int, least_bits: dict[str, float]) -> DataFrame:
    """(row, start, end) from (row, start, piece): the windows that pass, joined where they touch within a candidate.

    A long candidate is cut into pieces of PIECE windows; each also takes the characters that its last window needs.
    Runs of neighbouring pieces touch, and are joined, where the candidate goes on.
    """
    pieces = (candidates
              .withColumn("head", F.regexp_extract_all("piece", F.lit(f"(.{{1,{PIECE}}})"), 1))
              .withColumn("tail", F.regexp_extract_all("piece", F.lit(
                  f".{{1,{PIECE}}}(?=(.{{0,{window - 1}}}))"), 1))
              .select("row", "start", F.posexplode(F.arrays_zip("head", "tail")).alias("n", "part"))
              .select("row", F.col("start").alias("candidate"), (F.col("start") + F.col("n") * PIECE).alias("base"),
                      F.split(F.concat("part.head", "part.tail"), "").alias("chars"))
              # The table of terms rides along, so that steps look values up.
              .withColumn("terms", _terms(window)))
    runs = (pieces.where(F.size("chars") >= window).select("row", "candidate", "base", F.explode(
        _steps(window, least_bits)).alias("run"))
        .select("row", "candidate", (F.col("base") + F.col("run.start")).alias("start"),
                (F.col("base") + F.col("run.end")).alias("end")))
    order = Window.partitionBy("row", "candidate").orderBy("start", "end")
    fresh = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(True)).cast("long")
    return (runs.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
            .groupBy("row", "candidate", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .select("row", "start", "end"))


def _pieces(kind: int, pattern: str) -> Column:
    """A kind's pieces of ``text``: kind, place among the pieces, length, and the matched string."""
    return F.transform(_marked("text", pattern), lambda p, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("n"), F.char_length(p).cast("long").alias("length"),
        F.when(i % 2 == 1, p).alias("match")))


def with_pieces(docs: DataFrame, window: int) -> DataFrame:
    """``text`` gives way to ``pieces``: of every kind that has a match in it, all that lies in and between them."""
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE % window)
    # The marks are blanked in the texts first; no pattern can match what they become.
    clean = docs.withColumn("text", F.translate("text", _MARKS, "\x03\x03"))
    return clean.withColumn("pieces", F.flatten(F.filter(
        F.array(*[_pieces(k, p) for k, p in enumerate(patterns)]), lambda found: F.size(found) > 1))).drop("text")


def secret_spans(cut: DataFrame, window: int = WINDOW, least_bits: dict[str, float] | None = None,
                 allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """(row, kind, start, end) of every span, from (row, pieces): the known kinds, then ``entropy``.

    Places count code points; the end is exclusive. Kinds may overlap; within one, spans don't.
    """
    pieces = cut.select("row", F.explode("pieces").alias("p")).select("row", "p.*")
    before = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = saved(pieces.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))
                   .where("match IS NOT NULL").withColumn("end", F.col("start") + F.col("length"))
                   .where((F.col("kind") != 0) | (F.length(F.regexp_extract("match", ASSIGN, 2)) >= LEAST_VALUE))
                   .select("row", "kind", "start", "end", F.when(F.col("kind") == 3, F.col("match")).alias("match")),
                   "secret-matches")
    known = F.forall(F.split("match", SIGNS), lambda part: part.rlike(PLAIN_PART))
    for pattern in allowed:
        known = known | F.col("match").rlike(pattern)
    candidates = placed.where((F.col("kind") == 3) & ~known).select("row", "start", F.col("match").alias("piece"))
    entropy = entropy_spans(candidates, window, least_bits or LEAST_BITS)
    return (placed.where("kind < 3").select("row", "kind", "start", "end")
            .unionByName(entropy.select("row", F.lit(3).alias("kind"), "start", "end")))


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW,
                 least_bits: dict[str, float] | None = None, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document.

    ``spans`` lists kind:start:end by start, then by kind (assign, access, hex, entropy), comma-joined; base_sha256 is
    the digest of the first three kinds alone. A null text is empty and has none. Repeated rows are scanned each, a null
    id stays null, an empty table gives an empty result; other columns are ignored. Texts are read once and not moved;
    the pieces of one are placed together, as they came from one row.
    """
    cut = saved(with_pieces(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text")), window), "secret-pieces")
    found = secret_spans(cut.select("row", "pieces"), window, least_bits, allowed)
    per_row = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("every", lambda s: s["kind"] == kind)).cast("long")

    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    return (cut.select("row", "doc_id").join(per_row, "row", "left").withColumn("every", F.coalesce("found", none))
            .select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                    F.sha2(listed(F.filter("every", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
                    listed(F.col("every")).alias("spans")))
