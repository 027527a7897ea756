"""Token counts from distinct pre-tokens: pieces are counted once for each, then summed by frequency.

No piece of the model crosses from other characters into a space, so a text's pieces are those of its pre-tokens: a run
of spaces and what follows up to the next space. Token ids are never kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from metricloom.llm.common import in_arrow
from metricloom.llm.words import portions

#: The model writes a space as U+2581 and takes that sign in a text for a space.
PRE_TOKEN = re.compile("[ ▁]+[^ ▁]*")
#: Pre-tokens whose counts a worker remembers from batch to batch; beyond it the memory starts anew.
REMEMBERED = 500_000


def _piece_counts(pre_tokens: list[str], model) -> list[int]:
    """Pieces of each pre-token. Its first space is the one that the model itself puts before a text."""
    ids = model.encode([p[1:] for p in pre_tokens], num_threads=1)
    return [len(x) if len(p) > 1 else 1 for p, x in zip(pre_tokens, ids)]


def _count(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[pa.RecordBatch]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    known: dict[str, int] = {}
    for batch in portions(batches):
        split = [PRE_TOKEN.findall(" " + t) if t else [] for t in batch["text"].to_pylist()]
        numbers: dict[str, int] = {}  # by the whole pre-token: characters behind a NUL count too
        codes = np.fromiter((numbers.setdefault(p, len(numbers)) for p in chain.from_iterable(split)), dtype=np.int64)
        distinct = list(numbers)
        if len(known) > REMEMBERED:
            known = {}
        new = [p for p in distinct if p not in known]
        known.update(zip(new, _piece_counts(new, model)))
        pieces = np.fromiter((known[p] for p in distinct), dtype=np.int64, count=len(distinct))
        doc = np.repeat(np.arange(len(split)), [len(s) for s in split])
        # One row per document and distinct pre-token, joined to the piece counts and summed.
        pairs, frequency = np.unique(doc * max(len(distinct), 1) + codes, return_counts=True)
        sums = np.bincount(pairs // max(len(distinct), 1), weights=frequency * pieces[pairs % max(len(distinct), 1)],
                           minlength=len(split))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(sums.astype(np.int64))],
                                         ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens as the library's encode() gives them, over_limit (n_tokens > limit).

    A null text counts as empty, an empty one has no tokens. Repeated rows are counted each; an empty table gives an
    empty result; other columns are ignored. ``model_path`` must exist on every executor.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    schema = StructType([*rows.drop("text").schema.fields, StructField("n_tokens", LongType())])
    return in_arrow(rows, lambda batches: _count(batches, model_path), schema).withColumn(
        "over_limit", F.col("n_tokens") > limit)
