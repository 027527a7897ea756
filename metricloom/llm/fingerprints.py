"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A fingerprint has three subtables of cells; a paragraph's digest goes into one cell of each. A cell holds a count, the
digests' exclusive or and that of their check hashes, so tables subtract cell by cell. A cell of count 1 or -1 whose
check fits holds one digest of the difference; taking it out of its other cells frees more (peeling). Pairs whose
difference is too large for the fingerprint are done again with larger tables, until all are recovered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import ranked, saved

#: Cells of each of the three subtables of a fingerprint.
CELLS = 8
#: Rounds of peeling before a larger table is tried; tables of sufficient size need fewer.
ROUNDS = 10
#: Documents are put in order by blocks of ids: at least so many documents each, and at most so many blocks.
BLOCK, BLOCKS = 256, 1 << 18


def digests(text: Column) -> Column:
    """Hashes of the distinct paragraphs: lines that are not empty."""
    lines = F.filter(F.split(text, "\n"), lambda p: p != "")
    return F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("check"), digest), 32)


def _place(digest: Column, subtable: int, cells: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(subtable), digest), cells)


def _mask(digest: Column) -> Column:
    """The digest's three cells in a fingerprint, as bits."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), (
        F.lit(CELLS * i) + _place(digest, i, F.lit(CELLS))).cast("int")) for i in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _has(mask: Column, cell: Column) -> Column:
    return F.call_function("shiftright", mask, cell).bitwiseAND(1) == 1


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def table(found: Column) -> Column:
    """The cells (n, k, h) of a set of digests."""
    marked = F.transform(found, lambda d: F.struct(d.alias("d"), _mask(d).alias("m"), _check(d).alias("h")))

    def cell(own: Column) -> Column:
        return F.struct(F.size(own).cast("long").alias("n"), _xor(own["d"]).alias("k"), _xor(own["h"]).alias("h"))

    return F.transform(
        F.transform(F.sequence(F.lit(0), F.lit(3 * CELLS - 1)),
                    lambda j: F.filter(marked, lambda x: _has(x["m"], j))), cell)


def text_of(cells: Column) -> Column:
    """A fingerprint as text: count, digest and check of each cell in hexadecimal."""
    return F.concat_ws("", F.transform(cells, lambda c: F.concat(
        F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["h"]), 8, "0"))))


def _less(a: Column, b: Column) -> Column:
    return F.struct((a["n"] - b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"),
                    a["h"].bitwiseXOR(b["h"]).alias("h"))


def peeled(mine: Column, theirs: Column) -> Column:
    """Subtract two fingerprints and peel: (only_mine, only_theirs, whole); not whole if cells are left."""
    def pure(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"]))

    def step(state: Column, _: Column) -> Column:
        at = F.array_position(F.transform(state["cells"], pure), F.lit(True)).cast("int")
        one = F.struct(at.alias("at"), F.get(state["cells"], F.greatest(at - 1, F.lit(0))).alias("c"))

        def taken(found: Column) -> Column:
            c, mask = found["c"], found["m"]
            return F.struct(
                F.transform(state["cells"], lambda x, i: F.when(_has(mask, i), F.struct(
                    (x["n"] - c["n"]).alias("n"), x["k"].bitwiseXOR(c["k"]).alias("k"),
                    x["h"].bitwiseXOR(c["h"]).alias("h"))).otherwise(x)).alias("cells"),
                (state["mine"] + (c["n"] == 1).cast("int")).alias("mine"),
                (state["theirs"] + (c["n"] == -1).cast("int")).alias("theirs"), F.lit(False).alias("stuck"))

        # A list of one carries what was found, so that it is worked out once.
        found = F.transform(F.array(one), lambda o: F.struct(o["at"].alias("at"), o["c"].alias("c"),
                                                             _mask(o["c"]["k"]).alias("m")))
        after = F.get(F.transform(found, lambda o: F.when(o["at"] > 0, taken(o)).otherwise(F.struct(
            state["cells"].alias("cells"), state["mine"].alias("mine"), state["theirs"].alias("theirs"),
            F.lit(True).alias("stuck")))), F.lit(0))
        return F.when(state["stuck"], state).otherwise(after)

    start = F.struct(F.zip_with(mine, theirs, _less).alias("cells"), F.lit(0).alias("mine"), F.lit(0).alias("theirs"),
                     F.lit(False).alias("stuck"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(3 * CELLS)), start, step,
        lambda s: F.struct(s["mine"].alias("mine"), s["theirs"].alias("theirs"), F.forall(
            s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0)).alias("whole")))


def likeness(a: Column, b: Column, only_mine: Column, only_theirs: Column) -> Column:
    """Common paragraphs over all paragraphs of two documents with a and b of them; 1 for two without any."""
    return F.when(a + only_theirs == 0, 1.0).otherwise((a - only_mine) / (a + only_theirs))


def _merge(cells: DataFrame) -> DataFrame:
    merged = cells.groupBy("pair", "cells", "cell").agg(
        F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return merged.where("n <> 0 OR k <> 0 OR h <> 0")


def _round(cells: DataFrame) -> DataFrame:
    """Take every digest that some cell holds alone out of its other cells. Cells -1 and -2 count what was found.

    All rows of a pair are in one task already, so neither aggregate moves any.
    """
    sub = F.floor(F.col("cell") / F.col("cells")).cast("int")
    home = F.lit(False)
    for i in range(3):
        home = home | (F.col("cell") == i * F.col("cells") + _place(F.col("k"), i, F.col("cells")))
    pure = (F.col("cell") >= 0) & (F.abs("n") == 1) & (F.col("h") == _check(F.col("k"))) & home
    once = (cells.withColumn("pure", pure).withColumn("what", F.when(F.col("pure"), F.col("k")).otherwise(F.col("cell")))
            .groupBy("pair", "cells", "pure", "what").agg(
                F.min("cell").alias("cell"), F.min("n").alias("n"), F.min("k").alias("k"), F.min("h").alias("h"),
                F.bit_or(F.call_function("shiftleft", F.lit(1), F.when(F.col("pure"), sub).otherwise(0))).alias("in")))
    zero = F.lit(0).cast("long")

    def row(cell: Column, n: Column, k: Column, h: Column) -> Column:
        return F.struct(cell.cast("long").alias("cell"), n.cast("long").alias("n"), k.alias("k"), h.alias("h"))

    others = [F.when(F.call_function("shiftright", F.col("in"), F.lit(i)).bitwiseAND(1) == 0, row(
        i * F.col("cells") + _place(F.col("k"), i, F.col("cells")), -F.col("n"), F.col("k"), F.col("h")))
        for i in range(3)]
    noted = row(F.when(F.col("n") > 0, -1).otherwise(-2), F.lit(1), zero, zero)
    made = F.when(F.col("pure"), F.array_compact(F.array(noted, *others))).otherwise(
        F.array(row(F.col("cell"), F.col("n"), F.col("k"), F.col("h"))))
    return _merge(once.select("pair", "cells", F.explode(made).alias("x")).select("pair", "cells", "x.*"))


def recovered(pairs: DataFrame, factor: float) -> DataFrame:
    """Peel tables of ``factor`` times the digests of each pair (pair, mine, theirs): pair, only_mine, only_theirs,
    whole."""
    cells = F.ceil((F.size("mine") + F.size("theirs")) * factor / 3 + 4).cast("long")
    signed = F.concat(F.transform("mine", lambda d: F.struct(F.lit(1).cast("long").alias("n"), d.alias("k"))),
                      F.transform("theirs", lambda d: F.struct(F.lit(-1).cast("long").alias("n"), d.alias("k"))))
    rows = pairs.repartition("pair").select("pair", cells.alias("cells"), F.explode(signed).alias("x")).select(
        "pair", "cells", "x.n", "x.k", _check(F.col("x.k")).alias("h"))
    spots = F.array(*[i * F.col("cells") + _place(F.col("k"), i, F.col("cells")) for i in range(3)])
    state = _merge(rows.withColumn("cell", F.explode(spots)))
    for _ in range(ROUNDS):
        state = _round(state)
    out = state.groupBy("pair").agg(
        F.max(F.when(F.col("cell") == -1, F.col("n"))).alias("only_mine"),
        F.max(F.when(F.col("cell") == -2, F.col("n"))).alias("only_theirs"),
        (F.count(F.when(F.col("cell") >= 0, 1)) == 0).alias("whole"))
    none = F.lit(0).cast("long")
    return pairs.select("pair").join(out, "pair", "left").select(
        "pair", F.coalesce("only_mine", none).alias("only_mine"), F.coalesce("only_theirs", none).alias("only_theirs"),
        F.coalesce("whole", F.lit(True)).alias("whole"))


def with_next(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """row, id, text and the next document's text, by ascending id (null ids first, equal ones by text); the last's
    next is the first.

    Ids are cut into blocks of equal width, and each block also gets the first document of the block behind it.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    low, high, n = rows.agg(F.min("id"), F.max("id"), F.count("*")).first()
    each = max(BLOCK, -(-n // BLOCKS))
    width = max(1, ((high or 0) - (low or 0) + 1) * each // max(n, 1))
    block = F.coalesce(F.floor((F.col("id").cast("decimal(38,0)") - F.lit(low or 0)) / F.lit(width)).cast("long"),
                       F.lit(-1).cast("long"))
    rows = rows.withColumn("block", block)
    places = ranked(rows.groupBy("block").agg(F.min("id").alias("first")), [F.col("block")], "place")
    places = saved(places, "blocks")  # at most BLOCKS rows and a few
    total = max(places.count(), 1)
    ahead = places.select(F.pmod(F.col("place") + 1, F.lit(total)).alias("place"), F.col("block").alias("target"))
    lead = places.join(ahead, "place").select(F.col("block").alias("from"), "first", "target")
    guests = (rows.join(F.broadcast(lead), (F.col("block") == F.col("from")) & F.col("id").eqNullSafe(F.col("first")))
              .groupBy("target").agg(F.min("text").alias("text"))
              .select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "text", F.col("target").alias("block"),
                      F.lit(1).alias("guest")))
    every = rows.withColumn("guest", F.lit(0)).unionByName(guests)
    order = Window.partitionBy("block").orderBy("guest", "id", "text")
    return every.withColumn("next", F.lead("text").over(order)).where("guest = 0").drop("guest", "block")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) characters replaced by as many of the next document's first ones,
    or all. A null text counts as empty and has no paragraphs; likeness is the share of common paragraphs, 1 for two
    documents without any. Repeated rows are kept each; an empty table gives an empty result; other columns are ignored.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", 1, F.length("text") - half), F.substring("next", 1, half))
    full = with_next(docs, text, doc_id).withColumn("edited", edited)
    full = full.select("id", F.length("text").cast("long").alias("n_chars"),
                       F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       digests(F.col("text")).alias("mine"), digests(F.col("edited")).alias("changed"),
                       digests(F.col("next")).alias("following"))
    tables = full.withColumns({"t": table(F.col("mine")), "u": table(F.col("changed")), "v": table(F.col("following"))})
    first = tables.withColumns({"edit": peeled(F.col("t"), F.col("u")), "turn": peeled(F.col("t"), F.col("v"))})
    sizes = {c: F.size(c).cast("long") for c in ("mine", "changed", "following")}

    def known(peel: str, other: str) -> Column:
        return F.when(F.col(f"{peel}.whole"), likeness(sizes["mine"], sizes[other], F.col(f"{peel}.mine"),
                                                       F.col(f"{peel}.theirs")))

    done = saved(first.select(
        F.monotonically_increasing_id().alias("row"), "id", "n_chars", "edited_sha256",
        text_of(F.col("t")).alias("fingerprint"), text_of(F.col("u")).alias("edited_fingerprint"),
        known("edit", "changed").alias("near_edited"), known("turn", "following").alias("near_next"),
        F.when(~F.col("edit.whole") | ~F.col("turn.whole"), F.col("mine")).alias("mine"),
        F.when(~F.col("edit.whole"), F.col("changed")).alias("changed"),
        F.when(~F.col("turn.whole"), F.col("following")).alias("following")), "fingerprints")

    open_ = done.where("changed IS NOT NULL").select(
        (F.col("row") * 2).alias("pair"), "mine", F.col("changed").alias("theirs")).unionByName(
        done.where("following IS NOT NULL").select((F.col("row") * 2 + 1).alias("pair"), "mine",
                                                   F.col("following").alias("theirs")))
    factor, results = 1.5, []
    while not open_.isEmpty():
        tried = saved(recovered(open_, factor), "peeled")
        size = open_.select("pair", F.size("mine").cast("long").alias("a"), F.size("theirs").cast("long").alias("b"))
        results.append(tried.where("whole").join(size, "pair").select("pair", likeness(
            F.col("a"), F.col("b"), F.col("only_mine"), F.col("only_theirs")).alias("near")))
        open_ = open_.join(tried.where("NOT whole").select("pair"), "pair", "left_semi")
        factor *= 2
    out = done.select("row", "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                      "near_next")
    if results:
        more = results[0]
        for r in results[1:]:
            more = more.unionByName(r)
        more = more.groupBy(F.shiftright("pair", 1).alias("row")).agg(
            F.max(F.when(F.col("pair") % 2 == 0, F.col("near"))).alias("edited_later"),
            F.max(F.when(F.col("pair") % 2 == 1, F.col("near"))).alias("next_later"))
        out = out.join(more, "row", "left").withColumns({"near_edited": F.coalesce("near_edited", "edited_later"),
                                                         "near_next": F.coalesce("near_next", "next_later")})
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      "near_edited", "near_next")
