"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the words, pairs of neighbours and pairs with one word between that occur
in it, hashed to 2**BITS places; each counts once.  The trainer is one stream over a bounded sample
of labelled rows, in an order fixed by hashes: per-coordinate learning rates, L1 and L2.  Most
weights end at zero; the others are the model, which is broadcast (at most 2**BITS floats)."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tectra.llm.bloom import may_hold
from tectra.llm.common import materialize, prepare

BITS = 20
#: Labelled rows the fit uses, at most (those with the smallest hashes); passes over them.
MAX_TRAIN, EPOCHS = 24_000, 2
#: Bytes of features that the fit keeps in memory between passes.
HELD = 1 << 28
_WORD = re.compile(r"[^\W_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class _Hashes(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _Hashes()


def features(text: str | None) -> np.ndarray:
    """Places of all n-grams and skip-grams, with repeats."""
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    pairs = h[:-1] * _MIX[0] + h[1:] * _MIX[1]
    skips = h[:-2] * _MIX[2] + h[2:] * _MIX[3]
    return (np.concatenate([h * _MIX[0], pairs, skips]) >> np.uint64(64 - BITS)).astype(np.int64)


class FTRL:
    """FTRL-proximal: w = 0 where |z| <= l1, else -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2).
    Rows of label 1 weigh positive times as much."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1, positive: float = 2.0):
        self.alpha, self.beta, self.l1, self.l2, self.positive = alpha, beta, l1, l2, positive
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)  # distinct places; the last one is the bias
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (self.positive if label else 1.0)
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


def in_fold(doc_id: Column) -> Column:
    """True for the rows that learning never sees."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


class Held:
    """Rows of features for further passes: up to HELD bytes in memory, the rest in an unlinked file."""

    def __init__(self):
        self.rows, self.size, self.file = [], 0, None

    def add(self, at: np.ndarray, label: int) -> None:
        self.size += 4 * len(at)
        if self.size <= HELD:
            self.rows.append((at.astype(np.int32), label))
            return
        self.file = self.file or tempfile.TemporaryFile()
        np.save(self.file, np.append(at, label).astype(np.int32))

    def __iter__(self):
        yield from self.rows
        if self.file:
            end = self.file.seek(0, 2)
            self.file.seek(0)
            while self.file.tell() < end:
                row = np.load(self.file)
                yield row[:-1], int(row[-1])


def train(labelled: DataFrame, epochs: int = EPOCHS) -> pd.DataFrame:
    """labelled has doc_id, text, label (0 or 1), a bounded sample.  Gives the model's non-zero weights:
    place, weight.  No labelled rows give no weights."""
    rows = labelled.select(F.xxhash64("doc_id", F.lit(7)).alias("o"), "text", "label")

    def fit(batches):
        model, held = FTRL(), Held()
        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = np.unique(features(text))
                model.learn(at, label)
                if epochs > 1:
                    held.add(at, label)
        for _ in range(1, epochs):
            for at, label in held:
                model.learn(at.astype(np.int64), label)
        w = model.weights(np.arange((1 << BITS) + 1))
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(w[some])], ["place", "weight"])

    # One stream in a fixed order; texts move once.
    return rows.repartition(1).sortWithinPartitions("o").mapInArrow(fit, "place long, weight double").toPandas()


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.  Only rows outside the held-out fold
    with a non-null label teach; of a repeated label the largest counts.  Null and empty texts get
    the bias alone; null doc_ids count as outside the fold (held_out false) and teach nothing; an
    empty table gives an empty result; without labels every score is 0.5.  Rows that repeat a doc_id are
    scored one by one, and all teach if it has a label.  Texts of any length are read whole.  Other
    columns, whatever their names, are not read."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.filter(~in_fold(F.col("doc_id")))
    # At most max_train rows, those with the smallest hashes: two numbers each, so one task may pick them.
    # Before the join, so that only the sample's texts move.
    known = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(max_train)
    known = materialize(known, "labels")
    sample = materialize(rows.filter(may_hold(known.select("doc_id"), F.col("doc_id"))).join(known, "doc_id"), "labelled")
    model = train(sample, epochs)
    dense = np.zeros((1 << BITS) + 1, np.float32)
    dense[model["place"].to_numpy(np.int64)] = model["weight"]
    weights = spark.sparkContext.broadcast(dense)

    def score(batches):
        w = weights.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                at = features(text)
                at = np.unique(at[w[at] != 0])
                out.append(float(w[at].sum()) + float(w[-1]))
            p = 1.0 / (1.0 + np.exp(-np.clip(np.array(out, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    out = rows.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(in_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
