"""Quality classifier: Naive Bayes support vectors.

Features are indicators of the byte bigrams and trigrams in a text. Each is scaled by its class log-count ratio, counted
over all training rows; a linear hinge-loss model is then fitted to the scaled, normalised indicators by dual coordinate
descent, in one task on a bounded sample of the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import slices, texts_of, tune

#: Bigrams have a feature each; trigrams share 2 ** TRIGRAM_BITS by a hash.
TRIGRAM_BITS = 18
FEATURES = (1 << 16) + (1 << TRIGRAM_BITS)
#: Rows that the hinge-loss model is fitted to, at most: those with the least hashes.
FIT_ROWS = 4000
#: Added to each count, the loss's weight, and the passes over the sample.
SMOOTHING, COST, PASSES = 1.0, 10.0, 20


def features(text: str) -> np.ndarray:
    """The distinct features of a whole text, sorted."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    pairs = raw[:-1] << 8 | raw[1:]
    triples = (pairs[:-1] << 8 | raw[2:]) * np.uint32(2654435761) >> np.uint32(32 - TRIGRAM_BITS)
    if len(raw) < 20_000:
        return np.unique(np.concatenate([pairs, triples + np.uint32(1 << 16)]))
    seen = np.zeros(FEATURES, bool)
    seen[pairs] = True
    seen[triples + (1 << 16)] = True
    return np.flatnonzero(seen).astype(np.uint32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature the positive and negative rows of the task that have it; feature -1 counts the rows."""
    found = np.zeros((2, FEATURES + 1), np.int64)
    for batch in batches:
        for text, label in zip(texts_of(batch).to_pylist(), batch.column("label").to_pylist(), strict=True):
            found[label, features(text)] += 1
            found[label, FEATURES] += 1
    some = np.flatnonzero(found.sum(0))
    for at in range(0, len(some), 50_000):
        own = some[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.where(own == FEATURES, -1, own)), pa.array(found[1, own]), pa.array(found[0, own])], names=["feature", "positive", "negative"])


def _log_count_ratios(training: DataFrame) -> np.ndarray:
    """Of each feature. The driver gets one row for each feature, FEATURES + 1 at most."""
    counts = training.mapInArrow(_counts, "feature bigint, positive bigint, negative bigint").groupBy("feature").agg(F.sum("positive").alias("p"), F.sum("negative").alias("n")).toPandas()
    positive, negative = np.full(FEATURES, SMOOTHING), np.full(FEATURES, SMOOTHING)
    own = counts[counts.feature >= 0]
    positive[own.feature] += own.p
    negative[own.feature] += own.n
    return np.log(positive / positive.sum()) - np.log(negative / negative.sum())


def scaled(own: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The values of a text's features: log-count ratios, of length one together."""
    values = ratios[own]
    return values / (np.linalg.norm(values) or 1.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, size: int, cost: float = COST, passes: int = PASSES, seed: int = 7) -> np.ndarray:
    """Weights, the bias last, that minimise half their square plus cost times the hinge losses."""
    weights, dual = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in order.permutation(len(rows)):
            slope = signs[i] * (weights[rows[i]] @ values[i] + weights[-1]) - 1.0
            new = min(max(dual[i] - slope / square[i], 0.0), cost)
            if step := (new - dual[i]) * signs[i]:
                weights[rows[i]] += step * values[i]
                weights[-1] += step
                most = max(most, abs(step))
                dual[i] = new
        if most < 1e-3:
            break
    return weights


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [features(text) for text in texts_of(batch).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("pick"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["pick", "label", "features"])


def _fitted(ratios: np.ndarray):
    """The sample comes as features, at most FEATURES numbers a row, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, signs = [], []
        for batch in batches:
            rows += [np.array(x.values.to_numpy(zero_copy_only=False), np.uint32) for x in batch.column("features")]
            signs += [1.0 if label else -1.0 for label in batch.column("label").to_pylist()]
        values = [scaled(own, ratios) for own in rows]
        weights = dual_coordinate_descent(rows, values, np.array(signs), FEATURES)
        some = np.flatnonzero(weights)
        for at in range(0, len(some), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[at : at + 50_000]), pa.array(weights[some[at : at + 50_000]])], names=["feature", "weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(log-count ratios, weights with the bias last) from docs: doc_id, text, and labels: doc_id and the label, 0 or 1.

    Rows without a label or a known doc_id teach nothing; a doc_id's further label rows are rows of their own. With one
    class, or none, the ratios are 0 and scores depend on the bias alone.
    """
    tune(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Labels grow with the documents, so they meet by a shuffle at every size.
    ratios = _log_count_ratios(rows.join(known.hint("merge"), "doc_id").select("text", "label"))
    sample = known.withColumn("pick", F.xxhash64("doc_id", "label")).orderBy("pick", "doc_id", "label").limit(fit_rows)  # ids alone
    texts = rows.join(F.broadcast(sample), "doc_id").select("pick", "text", "label")
    featured = texts.mapInArrow(_featured, "pick bigint, label int, features array<int>")
    found = featured.repartition(1).sortWithinPartitions("pick", "label", "features").mapInArrow(_fitted(ratios), "feature bigint, weight double").toPandas()
    weights = np.zeros(FEATURES + 1)
    weights[found.feature] = found.weight
    return ratios, weights


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score): the probability-like score of each row's whole text, 0.5 at the model's border.

    Only the text counts. Null and empty texts have no features: their score is the bias's. Rows and null ids stay.
    """
    spark = docs.sparkSession
    tune(spark)
    ratios, weights = model
    shared = spark.sparkContext.broadcast((ratios.astype(np.float32), weights.astype(np.float32)))  # FEATURES values each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, weights = shared.value
        for batch in slices(batches, "text"):
            margins = []
            for text in texts_of(batch).to_pylist():
                own = features(text)
                margins.append(float(weights[own] @ scaled(own, ratios) + weights[-1]))
            found = 1.0 / (1.0 + np.exp(-np.clip(2.0 * np.array(margins), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double")
