"""Language identification by string kernels with Nyström landmarks and kernel ridge regression.

Two texts are as alike as the n-grams (1 to ``longest`` characters, blended) present in both:
k(x, y) = |X & Y| / sqrt(|X| |Y|). Landmark texts span the feature space, one ridge regression per language is solved
against the rest, and both fold into one matrix, so that a batch is scored by two matrix products. Presence is read off
a trie of the landmarks' n-grams; n-grams that no landmark has can't add to any kernel value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from metricloom.llm.common import in_arrow
from metricloom.llm.words import portions

#: Characters that are looked up at once, and texts of one presence matrix.
SLICE, TEXTS = 1 << 20, 512


@dataclass(frozen=True)
class Kernel:
    """The landmarks' n-grams as a trie: step[node * width + letter] is the next node, 0 where there is none."""

    letter: np.ndarray
    step: np.ndarray
    width: int
    longest: int
    landmarks: np.ndarray  # n-grams x landmarks: presence over the root of the landmark's n-gram count

    @property
    def size(self) -> int:
        return self.landmarks.shape[0]

    def present(self, texts: list[str]) -> np.ndarray:
        """Which n-grams each text has, as a matrix of 0 and 1."""
        found = np.zeros((len(texts), self.size), dtype=np.uint8)
        flat = found.ravel()
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        codes = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for at in range(0, len(codes), SLICE):
            # Each slice reads on into the next one, so that n-grams across the border are seen.
            letters = self.letter[codes[at:at + SLICE + self.longest - 1]]
            own = min(SLICE, len(codes) - at)
            row = (np.searchsorted(starts, np.arange(at, at + own), side="right") - 1) * self.size
            node = np.ones(own, dtype=np.int64)
            for n in range(self.longest):
                node = node[:max(0, min(own, len(letters) - n))]
                node = self.step[node * self.width + letters[n:n + len(node)]]
                flat[row[:len(node)] + node] = 1
        found[:, :2] = 0  # dead end and root are no n-grams
        return found

    def values(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts against the landmarks."""
        found = self.present(texts).astype(np.float32)
        return found @ self.landmarks / np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))


@dataclass(frozen=True)
class Model:
    kernel: Kernel
    labels: list[str]
    weights: np.ndarray  # landmarks x labels

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The best label of each text, and its share of the outputs brought to 0 to 1."""
        outputs = np.clip((self.kernel.values(texts) @ self.weights + 1) / 2, 1e-6, 1)
        best = outputs.argmax(axis=1)
        return [self.labels[i] for i in best], outputs[np.arange(len(texts)), best] / outputs.sum(axis=1)


def make_kernel(landmarks: list[str], longest: int) -> Kernel:
    seen = sorted({c for t in landmarks for c in t} - {"\0"})
    letter = np.zeros(0x110000, dtype=np.int32)
    letter[[ord(c) for c in seen]] = np.arange(1, len(seen) + 1)
    grams = sorted({t[i:i + n] for t in landmarks for n in range(1, longest + 1)
                    for i in range(len(t) - n + 1) if "\0" not in t[i:i + n]}, key=lambda g: (len(g), g))
    node = {"": 1} | {g: i + 2 for i, g in enumerate(grams)}
    width = len(seen) + 1
    step = np.zeros((len(grams) + 2) * width, dtype=np.int32)
    for g in grams:
        step[node[g[:-1]] * width + letter[ord(g[-1])]] = node[g]
    kernel = Kernel(letter, step, width, longest, np.zeros((len(grams) + 2, 0), dtype=np.float32))
    found = kernel.present(landmarks).astype(np.float32)
    found /= np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))
    return Kernel(letter, step, width, longest, np.ascontiguousarray(found.T))


def solve(kernel: Kernel, texts: list[str], labels: list[str], ridge: float) -> Model:
    """Nyström features, then one ridge regression per label against the rest, as one matrix for all labels."""
    names = sorted(set(labels))
    inside = kernel.landmarks.T.astype(np.float64) @ kernel.landmarks
    values, vectors = np.linalg.eigh(inside)
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = np.concatenate([kernel.values(texts[i:i + TEXTS]) for i in range(0, len(texts), TEXTS)]) @ root
    wanted = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ wanted)
    return Model(kernel, names, (root @ solved).astype(np.float32))


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", per_label: int = 300,
        landmarks_per_label: int = 24, longest: int = 3, prefer_below: int = 20_000, ridge: float = 1e-2) -> Model:
    """Fit on a bounded sample: ``per_label`` distinct texts of each label, those below ``prefer_below`` characters
    first, otherwise by hash. The first ``landmarks_per_label`` of them are the landmarks.

    Rows without text, letter or label are left out. Without any labelled row the model has no labels.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"),
        (F.length(text) >= prefer_below).alias("long"))
    # Copies collapse to one key before anything moves; what is chosen is bounded by labels times per_label.
    order = Window.partitionBy("label").orderBy("long", "hash")
    chosen = (rows.groupBy("label", "hash", "long").agg(F.count("*").alias("copies"))
              .withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_label))
    sample = (rows.join(F.broadcast(chosen.select("label", "hash", "place")), ["label", "hash"])
              .groupBy("label", "place").agg(F.min("text").alias("text")).orderBy("label", "place").collect())
    if not sample:
        return Model(make_kernel([], longest), [], np.zeros((0, 0), dtype=np.float32))
    texts, labels = [r["text"].lower() for r in sample], [r["label"] for r in sample]
    kernel = make_kernel([t for t, r in zip(texts, sample) if r["place"] <= landmarks_per_label], longest)
    return solve(kernel, texts, labels, ridge)


def _groups(lengths: np.ndarray) -> Iterator[slice]:
    """Neighbouring texts, as many as fit one presence matrix and one slice."""
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if i > first and (i - first >= TEXTS or total + n > SLICE):
            yield slice(first, i)
            first, total = i, 0
        total += n
    if len(lengths) > first:
        yield slice(first, len(lengths))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns with lang_pred and score (0 to 1) added.

    A null text, or one without a letter, is ``und`` with score 0. Every other text gets a learned label, also where no
    n-gram of it is known; from a model without labels it is ``und``. Columns named lang_pred or score are replaced. An
    empty table gives an empty result.
    """
    if not model.labels:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by landmarks and their n-grams
    kept = docs.drop("lang_pred", "score")
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()),
                         StructField("score", DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in portions(batches, text):
            texts = [t.lower() if t else "" for t in batch[text].to_pylist()]
            labels, scores = [], [np.zeros(0)]
            for part in _groups(np.array([len(t) for t in texts])):
                found, sure = own.predict(texts[part])
                labels += found
                scores.append(sure)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(np.concatenate(scores), pa.float64())],
                [*batch.schema.names, "lang_pred", "score"])

    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return in_arrow(kept, predict, schema).withColumns(
        {"lang_pred": F.when(known, F.col("lang_pred")).otherwise("und"),
         "score": F.when(known, F.col("score")).otherwise(0.0)})
