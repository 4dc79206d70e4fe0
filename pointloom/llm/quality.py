"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are bigrams of character classes (not words, so that any language and any
vocabulary is read alike) and a few binned shape statistics (repetition, length, case). TF-IDF weights and a truncated singular value decomposition,
fitted on labelled rows, give short vectors. Every document's vector is compared with all
labelled vectors by blocked matrix products, and the nearest ones vote with their labels,
weighted by similarity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The most labelled rows that a classifier is fitted on, and so that are broadcast
#: (FIT_ROWS x DIMENSIONS 32-bit numbers, under 1 MB).
FIT_ROWS, DIMENSIONS = 4096, 48
#: Neighbours that vote, the power of their cosine, the least score that is kept.
NEIGHBOURS, POWER, KEEP = 25, 8, 0.3
#: Every FOLDS-th row by crc32 of its id is held out.
FOLDS = 5

# Character classes of bytes: a-z, A-Z, digits, beyond ASCII, white space, each mark.
_MARKS = b".,;:!?'\"()[]{}<>|/\\*#%&$@+-=_~^`"
CLASSES = 5 + len(_MARKS) + 1


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES - 1, dtype=np.int64)
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1], t[128:] = 0, 1, 2, 3
    for c in b" \t\n\r\f\v":
        t[c] = 4
    for k, c in enumerate(_MARKS):
        t[c] = 5 + k
    return t


CLASS_OF = _class_table()
#: Bins of each of the shape statistics, and how much one of them weighs beside a bigram.
BINS, STATISTICS, STATISTIC_TF = 12, 8, 60.0
TERMS = CLASSES * CLASSES + BINS * STATISTICS


def _shape(text: str) -> list[float]:
    """Shares between 0 and 1 that tell running text from repeats, lists and shouting."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * STATISTICS
    lines, sentences = text.split("\n"), text.split(". ")
    different = len(set(words))
    letters = sum(map(len, words))
    return [
        different / n if n < 200 else min(1.0, different / (14.1 * n**0.5)),
        sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        len(set(sentences)) / len(sentences),
        min(1.0, letters / n / 20),
        min(1.0, np.log2(1 + n) / 16),
        min(1.0, sum(map(str.isupper, words)) / n),
        min(1.0, n / len(lines) / 200),
    ]


def counts(texts: list[str]) -> np.ndarray:
    """Term counts (rows x TERMS) of whole texts; an empty text has shape terms only."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    pairs = CLASSES * CLASSES
    for k, text in enumerate(texts):
        c = CLASS_OF[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
        if len(c) > 1:
            out[k, :pairs] = np.bincount(c[:-1] * CLASSES + c[1:], minlength=pairs)
            out[k, :pairs] *= 1000.0 / (len(c) - 1)
        for j, v in enumerate(_shape(text)):
            at = v * (BINS - 1)
            low = min(BINS - 2, int(at))  # a value lies between two bins
            out[k, pairs + BINS * j + low] = STATISTIC_TF * (1 - (at - low))
            out[k, pairs + BINS * j + low + 1] = STATISTIC_TF * (at - low)
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    def embed(self, tf: np.ndarray) -> np.ndarray:
        w = np.log1p(tf) * self.idf
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
        v = w @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str]) -> np.ndarray:
        """Similarity-weighted share of good labels among the nearest labelled rows."""
        if not len(self.labels):
            return np.full(len(texts), self.share)
        cosine = self.embed(counts(texts)) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(cosine, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0) ** POWER
        votes = (weight * self.labels[near]).sum(axis=1)
        # one vote's worth of the overall share settles texts that are like nothing seen
        return np.clip((votes + 0.05 * self.share) / (weight.sum(axis=1) + 0.05), 0.0, 1.0)


def fit(tf: np.ndarray, labels: np.ndarray) -> Model:
    """Latent vectors of labelled rows; without rows every text scores a neutral 0.5."""
    if not len(labels):
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    idf = (1 + np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0)))).astype(np.float32)
    w = np.log1p(tf) * idf
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
    values, vectors = np.linalg.eigh((w.T @ w).astype(np.float64))
    basis = vectors[:, ::-1][:, : min(DIMENSIONS, len(labels))].astype(np.float32)
    model = Model(idf, basis, np.zeros((0, 1), np.float32), labels.astype(np.float32), float(labels.mean()))
    model.vectors = model.embed(tf).astype(np.float32)
    return model


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled rows outside the held-out fold, the first by a
    hash of the id. Several labels of one id count as their mean, null labels not at all; of
    several rows of one id the text with the least hash is used, so ``fit_rows`` bounds what
    the task that fits gets; the driver gets the model (4 DIMENSIONS (TERMS + fit_rows) bytes)."""
    known = labels.where(F.col(label_col).isNotNull() & (fold(id_col) != 0)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = docs.select(docs[id_col].cast("long").alias("id"), common.whole(docs[text_col]).alias("text")).join(F.broadcast(chosen), "id")
    # the least hash first, as short rows; then that text once (equal ones are one group)
    least = rows.groupBy("id").agg(F.min(F.xxhash64("text")).alias("least"))
    rows = rows.join(F.broadcast(least), "id").where(F.xxhash64("text") == F.col("least"))
    rows = rows.groupBy("id").agg(F.first("text").alias("text"), F.first("label").alias("label"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_batches(batches, 1000):
            tf = counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in tf], pa.binary())], names=["id", "label", "tf"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            found = pa.Table.from_batches(held).sort_by("id")
            tf = np.frombuffer(b"".join(found["tf"].to_pylist()), np.float32).reshape(-1, TERMS)
            model = fit(tf, np.array(found["label"].to_pylist(), dtype=np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(astuple(model))], pa.binary())], names=["model"])

    # the counts of the fit_rows texts meet in one task; the driver gets the model alone
    counted = rows.select("id", "text", "label").mapInArrow(featured, "id long, label double, tf binary")
    made = counted.repartition(1).mapInArrow(fitted, "model binary").collect()
    return Model(*pickle.loads(made[0]["model"])) if made else fit(np.zeros((0, TERMS), np.float32), np.zeros(0, np.float32))


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score_") -> DataFrame:
    """All columns of ``docs`` and the score (double), from the whole texts alone."""
    held = common.share(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        model = common.opened(held)
        out = [model.score(texts.iloc[k : k + 500].tolist()) for k in range(0, len(texts), 500)]
        return pd.Series(np.concatenate(out).astype(float) if out else np.zeros(0))

    return docs.withColumn(name, score(common.whole(docs[text_col])))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document.

    A null text scores as an empty one. A null id is in no fold (held_out null reads as
    false). Repeated rows give repeated results; other columns are ignored."""
    model = train(docs, labels, id_col, text_col)
    picked = common.spread(docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].alias("text")))
    return scored(picked, model, "text").select(id_col, F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.col("score_").alias("score"), F.when(F.col("score_") >= KEEP, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns,
    whatever these are called.

    Null texts score as empty ones, null ids have no label, repeated rows share a fate; an
    empty table stays empty, and without labels every row stays."""
    (name,) = common.unused(docs, "score")
    return scored(docs, train(docs, labels, id_col, text_col), text_col, name).where(F.col(name) >= KEEP).select(*common.columns(docs))
