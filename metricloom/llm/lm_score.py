"""Language-model scores: a causal self-attention model over subword ids, beside a word unigram baseline.

Both learn from all training rows. Classes and pair shares of tokens come from pairs counted over all of them. The
gradient steps take every token of every training row: windows that cover each text without overlap are dealt by hash to
rounds and shards; in a round the shards start from common weights and take their steps, and the weights are averaged by
tasks. Counts of the most frequent words go to every task in a table of fixed size, the others are joined.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm import attention
from metricloom.llm.attention import Attention
from metricloom.llm.common import in_arrow, saved, small_batches
from metricloom.llm.words import MIX, Words, mixed, portions

#: Words whose counts each task holds.
HELD = 1 << 18
#: Characters that the tokenizer gets at once, so that its work on one very long text is bounded. Cuts are where a
#: pre-token ends; one longer than this goes to the merges by itself, whole.
PIECE = 200_000
#: The end of patterns that look ahead behind white space, and what shows that a text may hold neighbouring white space:
#: blanks and line feeds side by side, or any other white space.
AHEAD = r"|\s+(?!\S)|\s+"
CLOSE = ("  ", " \n", "\n ", "\n\n", *"\t\v\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))
#: Windows of a shard, rounds of averaging, and neighbouring windows that are dealt together.
SHARD, ROUNDS, RUN = 1 << 16, 3, 64
#: Tokens whose weights are averaged together, tokens whose pairs are counted at once, and pairs put in a table at once.
BLOCK, FLOW, PAIRS = 1024, 1 << 21, 1 << 19
SCORED = ("row long, id {kind}, held_out boolean, n_tokens long, known long, part double, score double, "
          "rest array<struct<hash: long, n: int>>")


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    # The special token is never allowed in texts; without any the library looks for one at every place.
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|end|>": len(ranks)}), len(ranks)


@lru_cache(maxsize=2)
def _spread(encoding):
    """A tokenizer for texts in which no white space stands beside other white space: there looking ahead behind white
    space changes nothing, and a pattern that does not look ahead is matched faster."""
    import tiktoken

    if not encoding._pat_str.endswith(AHEAD):
        return encoding
    return tiktoken.Encoding("spread", pat_str=encoding._pat_str.removesuffix(AHEAD) + r"|\s+",
                             mergeable_ranks=encoding._mergeable_ranks, special_tokens=encoding._special_tokens)


def _ids(text: str, encoding) -> np.ndarray:
    """The ids of the whole text, in pieces that end with a pre-token."""
    if len(text) <= PIECE:
        close = any(x in text for x in CLOSE)
        return (encoding if close else _spread(encoding)).encode_to_numpy(text, disallowed_special=())
    import regex

    parts, start, end = [], 0, 0
    for found in regex.finditer(encoding._pat_str, text):
        if found.end() - start > PIECE:
            parts.append(encoding.encode_ordinary(text[start:end]))
            start = end
            if found.end() - start > PIECE:
                parts.append(encoding._encode_single_piece(text[start:found.end()]))
                start = found.end()
        end = found.end()
    parts.append(encoding.encode_ordinary(text[start:]))
    return np.array([x for p in parts for x in p], dtype=np.int64)


def _distinct(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each text's distinct words."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    if not len(text):
        return text, value, text
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])]))
    return text[first], value[first], np.diff(np.append(first, len(text)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, size=8 << 20):
        value, count = np.unique(Words(batch["text"].to_pylist(), spaced=True).hash, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count.astype(np.int64))],
                                         ["hash", "n"])


def _places(hashes: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function that gives where hashes stand among the sorted ones, and whether they do. It starts from where those
    with the same leading bits begin, and takes few steps, for hashes are spread evenly."""
    ends, shift = np.append(hashes, np.uint64((1 << 64) - 1)), np.uint64(64 - 18)
    begins = np.searchsorted(hashes, np.arange(1 << 18, dtype=np.uint64) << shift)

    def look(wanted):
        at = begins[(wanted >> shift).astype(np.int64)]
        low = np.flatnonzero(ends[at] < wanted)
        while len(low):
            at[low] += 1
            low = low[ends[at[low]] < wanted[low]]
        return at, (ends[at] == wanted) & (at < len(hashes))

    return look


def _score(batches: Iterator[pa.RecordBatch], model: Attention, hashes: np.ndarray, counts: np.ndarray, ends: int) -> Iterator[pa.RecordBatch]:
    """Each text's model score, its baseline over the words held (``hashes`` sorted) and its other words."""
    logs, look = np.log10(counts + 1.0), _places(hashes)
    for batch in portions(batches, size=1 << 20):
        texts = batch["text"].to_pylist()
        words = Words(texts, spaced=True)
        at, held = look(words.hash)
        part = np.bincount(words.text[held], weights=logs[at[held]], minlength=len(texts)) + np.log10(ends + 1)
        known = np.bincount(words.text[held], minlength=len(texts)) + (ends > 0)
        text, value, n = _distinct(words.text[~held], words.hash[~held])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))]).astype(np.int32)
        rest = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
            [pa.array(value.view(np.int64)), pa.array(n.astype(np.int32))], ["hash", "n"]))
        yield pa.RecordBatch.from_arrays(
            [batch["row"], batch["id"], batch["held_out"], pa.array(words.counts.astype(np.int64) + 1),
             pa.array(known), pa.array(part), pa.array(model.score(_lists(batch, model.end))), rest],
            ["row", "id", "held_out", "n_tokens", "known", "part", "score", "rest"])


def _tokenised(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoding, end = _tokenizer(path, pattern)
    for batch in portions(batches, size=1 << 20):
        ids = [_ids(t, encoding) for t in batch["text"].to_pylist()]
        offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int32)
        packed = [x.astype(_small(end)).tobytes() for x in ids]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(packed, pa.binary())],
            [*batch.schema.names, "list", "ids"])


def _small(end: int) -> type:
    """The type in which tokens travel, as bytes: Spark passes these on whole, but lists number by number."""
    return np.uint16 if end < 1 << 16 else np.int32


def _lists(batch: pa.RecordBatch, end: int) -> list[np.ndarray]:
    column = batch["ids"]
    if pa.types.is_binary(column.type):
        return [np.frombuffer(ids, dtype=_small(end)) for ids in column.to_pylist()]
    edges, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _count_pairs(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[pa.RecordBatch]:
    """Neighbours in the texts, each between two ends, and how often they meet."""
    kind = np.uint32 if (end + 1) ** 2 <= 1 << 32 else np.int64  # shorter numbers sort faster
    edge = np.array([end], dtype=kind)

    def counted(flows):
        codes = np.concatenate([f[:-1] * kind(end + 1) + f[1:] for f in flows])
        codes, n = np.unique(codes, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

    flows, held = [], 0
    for batch in batches:
        for ids in _lists(batch, end):
            flows.append(np.concatenate([edge, ids.astype(kind), edge]))
            held += len(flows[-1])
            if held >= FLOW:
                yield counted(flows)
                flows, held = [], 0
    if flows:
        yield counted(flows)


def _beside(batches: Iterator[pa.RecordBatch], kind: np.ndarray, classes: int) -> Iterator[pa.RecordBatch]:
    table = np.zeros(len(kind) * 2 * classes)

    def add(held):
        pair, n = (np.concatenate(x) for x in zip(*held))
        return attention.beside(pair // len(kind), pair % len(kind), n, kind, classes)

    held, rows = [], 0
    for batch in batches:
        held.append((batch["pair"].to_numpy(), batch["n"].to_numpy()))
        rows += batch.num_rows
        if rows >= PAIRS:
            table += add(held)
            held, rows = [], 0
    if held:
        table += add(held)
    cells = np.flatnonzero(table)
    for at in range(0, len(cells), 1 << 16):
        some = cells[at:at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some].astype(np.int64))], ["cell", "n"])


def _cells(batches: Iterator[pa.RecordBatch], before: np.ndarray, column: np.ndarray, width: int
           ) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pair = batch["pair"].to_numpy()
        cell = before[pair // len(column)] * width + column[pair % len(column)]
        yield pa.RecordBatch.from_arrays([pa.array(cell), batch["n"]], ["cell", "n"])


def _runs(batches: Iterator[pa.RecordBatch], end: int, window: int, shards: int, turn: int | None
          ) -> Iterator[pa.RecordBatch]:
    """Each text between two ends, cut into runs of windows, with their shard; of one round only, if ``turn`` is given.

    Neighbouring runs share the token at which they meet: it is predicted in the first and read in the second.
    """
    length, edge = window * RUN, np.array([end], dtype=_small(end)).tobytes()
    for batch in batches:
        texts, tokens = _lists(batch, end), []
        number = np.array([-(-(len(t) + 1) // length) for t in texts], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), number)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * length
        with np.errstate(over="ignore"):
            draw = mixed(batch["hash"].to_numpy().view(np.uint64)[owner] + MIX * (start // length).astype(np.uint64))
            other = mixed(draw + MIX)
        chosen = slice(None) if turn is None else other % np.uint64(ROUNDS) == turn
        drawn, shard = draw[chosen], (other[chosen] // np.uint64(ROUNDS) % np.uint64(shards)).astype(np.int32)
        for i, at in zip(owner[chosen], start[chosen]):
            text = texts[i]
            run = text[max(at - 1, 0):at + length].astype(_small(end), copy=False).tobytes()
            tokens.append((b"" if at else edge) + run + (edge if len(text) < at + length else b""))
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard), pa.array(drawn.view(np.int64)), pa.array(tokens, pa.binary())], ["shard", "draw", "tokens"])


def _windows(runs: list[bytes], end: int, window: int) -> np.ndarray:
    """The windows of runs, each with the token that follows it; -1 behind the end."""
    parts: list[np.ndarray] = []
    for run in runs:
        tokens = np.frombuffer(run, dtype=_small(end)).astype(np.int32)
        number = -(-(len(tokens) - 1) // window)
        flow = np.full(number * window + 1, -1, dtype=np.int32)
        flow[:len(tokens)] = tokens
        parts.append(flow[np.arange(number)[:, None] * window + np.arange(window + 1)])
    return np.concatenate(parts)


def _learned(shard: pa.Table, weights: dict[str, np.ndarray], kind: np.ndarray, end: int, batch: int, rate: float,
             epochs: int, steps: int, turn: int) -> pa.Table:
    """Weights after the steps of one shard, times how often it met them, in blocks."""
    runs = sorted(zip(shard["draw"].to_pylist(), shard["tokens"].to_pylist()))
    flow = _windows([r for _, r in runs], end, len(weights["place"]))
    random = np.random.default_rng(turn)
    order = np.concatenate([random.permutation(len(flow)) for _ in range(epochs)])
    parts = np.array_split(order, min(steps, -(-len(order) // batch)))

    def draws():
        for part in parts:
            tokens, after = flow[part, :-1], flow[part, 1:]
            yield np.where(tokens < 0, end, tokens), np.where(after < 0, -1, kind[after])

    found = attention.descend(weights, draws(), len(parts), rate, turn / ROUNDS, (turn + 1) / ROUNDS)
    met = np.bincount(flow[:, :-1][flow[:, :-1] >= 0], minlength=len(kind)).astype(np.float64)
    out = [(-1, len(flow) * np.append(np.concatenate([v.ravel() for k, v in found.items() if k != "embed"]), 1.0))]
    for at in range(0, len(kind), BLOCK):
        own = met[at:at + BLOCK, None]
        if own.any():
            out.append((at // BLOCK, np.hstack([own * found["embed"][at:at + BLOCK], own]).ravel()))
    number = shard["shard"][0].as_py()
    return pa.table({"block": pa.array([b for b, _ in out], pa.int32()), "shard": pa.array([number] * len(out), pa.int32()),
                     "sums": pa.array([v.astype(np.float32).tobytes() for _, v in out], pa.binary())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, value in zip(batch["block"].to_pylist(), batch["sums"].to_pylist()):
            value = np.frombuffer(value, dtype=np.float32).astype(np.float64)
            sums[block] = sums[block] + value if block in sums else value
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()],
                                                                                pa.binary())], ["block", "sums"])


def _averaged(rows: list, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A token's weights are averaged by how often a shard met it, so those that few shards hold are not diluted."""
    new = {k: v.copy() for k, v in weights.items()}
    width = weights["embed"].shape[1]
    for r in rows:
        value = np.frombuffer(r["sums"])
        if r["block"] < 0:
            value, at = value[:-1] / value[-1], 0
            for k, v in weights.items():
                if k != "embed":
                    new[k] = value[at:at + v.size].reshape(v.shape).astype(np.float32)
                    at += v.size
        else:
            table = value.reshape(-1, width + 1)
            met = np.flatnonzero(table[:, -1])
            new["embed"][r["block"] * BLOCK + met] = table[met, :-1] / table[met, -1:]
    return new


def fit(texts: DataFrame, vocabulary: int, end: int, classes: int = 32, width: int = 12, window: int = 32,
        overlap: int = 8, steps: int = 600, batch: int = 256, rate: float = 0.01, rows: int = 2000, columns: int = 6000,
        back_off: float = 8.0, seed: int = 5) -> Attention:
    """Learn from every token of the texts (hash, ids as bytes), in at least ``steps`` batches: few texts are read again."""
    context = texts.sparkSession.sparkContext
    pairs = saved(in_arrow(texts.select("ids"), lambda b: _count_pairs(b, end), "pair long, n long").groupBy("pair").agg(
        F.sum("n").alias("n")), "token-pairs")
    count = np.zeros(vocabulary)
    # A row per token of the vocabulary at most. An end closes every text and opens the next.
    for r in pairs.groupBy(F.pmod("pair", F.lit(vocabulary)).alias("token")).agg(F.sum("n").alias("n")).collect():
        count[r["token"]] = r["n"]

    def table(cells: DataFrame, size: int) -> np.ndarray:
        found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size, dtype=np.float32)
        out[found["cell"].to_numpy()] = found["n"].to_numpy()
        return out

    def near(kind: np.ndarray) -> np.ndarray:
        held = context.broadcast(kind)
        return table(in_arrow(pairs, lambda b: _beside(b, held.value, classes), "cell long, n long"),
                     vocabulary * 2 * classes).reshape(vocabulary, -1)

    def learner(held, turn: int):
        return lambda shard: _learned(shard, *held.value, end, batch // 2, rate, epochs, steps, turn)

    kind = attention.token_classes(near, count, classes)
    high, wide = rows + classes, columns + classes
    placed = context.broadcast(attention.places(count, kind, rows, columns))
    pair = table(in_arrow(pairs, lambda b: _cells(b, *placed.value, wide), "cell long, n long"), high * wide)
    tables = attention.inside_classes(pair.reshape(high, wide), count, kind, classes, rows, columns, back_off)

    total = texts.agg(F.sum(F.ceil((F.octet_length("ids") / np.dtype(_small(end)).itemsize + 1) / F.lit(window)))).first()[0] or 0
    weights = attention.starting(count, kind, classes, width, window, seed)
    if total:
        # A window belongs to one round, or to all where that would leave the rounds fewer than their batches.
        once = total >= steps * batch
        number = total / ROUNDS if once else total
        epochs = max(1, min(steps, round(steps * batch / (ROUNDS * number))))
        shards = max(1, round(number / SHARD))
        for turn in range(ROUNDS):
            held = context.broadcast((weights, kind))
            drawn = in_arrow(texts, lambda b: _runs(b, end, window, shards, turn if once else None),
                             "shard int, draw long, tokens binary")
            moved = drawn.groupBy("shard").applyInArrow(learner(held, turn), "block int, shard int, sums binary")
            sums = in_arrow(moved.repartition("block").sortWithinPartitions("block", "shard"), _summed,
                            "block int, sums binary")
            weights = _averaged(sums.collect(), weights)  # the model itself
    return Attention(end, overlap, kind=kind, **tables, **weights)


def lm_scores(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id",
              held_out: str = "held_out", **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Only rows that are not ``held_out`` (null: not) are learned from. Tokens of the baseline are words between white
    space, A-Z lower-cased, and one end; score is the attention model's log10 probability of the subword ids and their
    end. A null text is empty: its end alone. Repeated rows are scored each; an empty table gives an empty result, and
    without training rows the baseline is 0; other columns are ignored. ``path``: token ranks, on every executor.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"),
                       F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = _tokenizer(path, pattern)[1]
    kind = rows.schema["id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        rows = in_arrow(rows, lambda b: _tokenised(b, path, pattern),
                        f"row long, id {kind}, held_out boolean, text string, list array<int>, ids binary")
        rows = saved(rows.select("row", "id", "held_out", "text", F.xxhash64("list").alias("hash"), "ids"), "lm-ids")
    learned = rows.where("NOT held_out")
    with small_batches(docs.sparkSession):
        # The first free id closes a text.
        model = fit(learned.select("hash", "ids"), size + 1, size, **options)
    with small_batches(docs.sparkSession):
        counts = saved(in_arrow(learned.select("text"), _count_words, "hash long, n long").groupBy("hash").agg(
            F.sum("n").alias("n")), "word-counts")
    ends = learned.count()
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    n, v = (total or 0) + ends, distinct + (ends > 0)

    level = F.floor(F.log2("n") * 8)
    room, least = HELD, 1 << 62
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
                    .collect(), key=lambda r: -r["level"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["least"]
    held = counts.where(F.col("n") >= least).orderBy("hash").collect()  # HELD rows at most
    hashes = np.array([r["hash"] for r in held], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model, hashes[order], np.array([r["n"] for r in held], dtype=np.float64)[order]))
    with small_batches(docs.sparkSession):
        scored = saved(in_arrow(rows, lambda b: _score(b, *shared.value, ends),
                                SCORED.format(kind=kind)), "lm-scored")
    rest = (scored.select("row", F.explode("rest").alias("w")).select("row", "w.*")
            .join(counts.select("hash", F.col("n").alias("count")), "hash")
            .groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("count") + 1.0)).alias("logs")))
    return scored.drop("rest").join(rest, "row", "left").select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1))).alias(
            "base_score"), "score")
