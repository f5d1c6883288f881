"""Toxicity by a character n-gram linear classifier with naive Bayes features.

A text is the set of its hashed character 4- and 5-grams.  Each gram's value
is its naive Bayes log-count ratio between the labels, and a logistic
regression on those values gives the margin.  The margin becomes a score by a
logistic curve fitted to margins of rows that the model was not fitted on
(two folds), placed so that their best cut by F1 lies at the threshold.

Counts, ratios and the regression come from a bounded sample of labelled rows
(FIT_ROWS); scoring is one pass of map tasks over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import slices, small_batches, stored

GRAMS = (4, 5)
HASH_BITS = 20
#: Labelled rows that the classifier is fitted on, at most.
FIT_ROWS = 6_000
#: Grams in the model (those whose ratio stands out most), and rows that each needs.
MODEL_GRAMS = 4096
MIN_ROWS = 3
SMOOTHING = 1.0
REGULARISATION = 0.002
ITERATIONS = 40
THRESHOLD = 0.7

# lower-case ASCII letters and digits stay, other ASCII characters become spaces
_ASCII = np.array([c if chr(c).isalnum() else 32 for c in range(128)], dtype=np.uint32)


def gram_hashes(text: str) -> np.ndarray:
    """Hashes (below 2**HASH_BITS) of the character n-grams of a text, in order."""
    cp = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    cp = np.where(cp < 128, _ASCII[np.minimum(cp, 127)], cp)
    out = []
    for n in GRAMS:
        if len(cp) < n:
            continue
        h = np.full(len(cp) - n + 1, n, np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) ^ (cp[i: len(cp) - n + 1 + i] * np.uint32(0x9E3779B1))
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - HASH_BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    """Grams (hashes), their ratio times weight, and the score's curve."""
    grams: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def table(self) -> np.ndarray:
        """Position of each hash in the model, -1 for none."""
        at = np.full(1 << HASH_BITS, -1, np.int16)
        at[self.grams] = np.arange(len(self.grams))
        return at

    def margin(self, text: str, table: np.ndarray) -> float:
        at = table[gram_hashes(text)]
        return float(self.weights[np.unique(at[at >= 0])].sum() + self.bias)

    def score(self, margin: np.ndarray) -> np.ndarray:
        x = np.clip(self.slope * np.asarray(margin, dtype=np.float64) + self.shift, -40, 40)
        return 1 / (1 + np.exp(-x))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return ["" if t is None else t for t in batch.column("text").to_pylist()]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each gram by fold and label: each task adds up its own."""
    counts = np.zeros((4, 1 << HASH_BITS), np.int32)
    for batch in slices(batches):
        for text, fold, label in zip(_texts(batch), batch.column("fold").to_pylist(), batch.column("label").to_pylist()):
            counts[2 * fold + label, np.unique(gram_hashes(text))] += 1
    gram = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(gram)] + [pa.array(counts[i, gram].astype(np.int64)) for i in range(4)],
                                     names=["gram", "n00", "n01", "n10", "n11"])


def _ratios(counts: DataFrame, clean: F.Column, toxic: F.Column, n_clean: int, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """The MODEL_GRAMS grams whose log-count ratio stands out most, and the ratios."""
    # share of rows with the gram, per label; the ratio's spread falls with its counts
    p, q = (toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING), (clean + SMOOTHING) / (n_clean + 2 * SMOOTHING)
    ratio = F.log(p / q)
    spread = F.sqrt(1 / (toxic + SMOOTHING) + 1 / (clean + SMOOTHING))
    best = (counts.where(clean + toxic >= MIN_ROWS)
            .select("gram", ratio.alias("ratio"), (F.abs(ratio) / spread).alias("z"))
            .orderBy(F.col("z").desc(), "gram").limit(MODEL_GRAMS)).toPandas()
    return best["gram"].to_numpy(np.int64), best["ratio"].to_numpy(np.float64)


_vector = F.udf(lambda n, at, values: SparseVector(n, at, values), VectorUDT())


def _regression(rows: DataFrame, grams: np.ndarray, ratios: np.ndarray) -> Model:
    """Logistic regression on the ratios of the grams that a row has."""
    model = Model(grams, ratios, 0.0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in slices(batches):
            at = [np.unique(table[gram_hashes(t)]).astype(np.int32) for t in _texts(batch)]
            at = [a[a >= 0] for a in at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(at, pa.list_(pa.int32())),
                 pa.array([ratios[a] for a in at], pa.list_(pa.float64()))], names=["label", "at", "ratios"])

    fed = rows.mapInArrow(features, "label int, at array<int>, ratios array<double>")
    fed = fed.select(F.col("label").cast("double"), _vector(F.lit(len(grams)), "at", "ratios").alias("features"))
    fit = LogisticRegression(regParam=REGULARISATION, maxIter=ITERATIONS, standardization=False).fit(fed)
    return Model(grams, fit.coefficients.toArray() * ratios, float(fit.intercept))


def _margins(rows: DataFrame, model: Model) -> list[tuple[float, int]]:
    """(margin, label) of each row; rows are the bounded sample."""
    def run(batches):
        table = model.table()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([model.margin(t, table) for t in _texts(batch)], pa.float64()),
                                              batch.column("label")], names=["margin", "label"])
    return [(r.margin, r.label) for r in rows.mapInArrow(run, "margin double, label int").collect()]


def calibrate(margins: np.ndarray, labels: np.ndarray, threshold: float = THRESHOLD) -> tuple[float, float]:
    """Slope and shift of the score's curve: the best cut by F1 (the middle of
    the gap it lies in) gets the threshold as its score."""
    order = np.argsort(-margins, kind="stable")
    m, y = margins[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    ends = np.append(np.flatnonzero(np.diff(m)), len(m) - 1)  # a cut lies between different margins
    best = ends[np.argmax(f1[ends])]
    below = m[best + 1] if best + 1 < len(m) else m[best] - 1.0
    cut = (m[best] + below) / 2
    side = np.where(labels == 1, 1.0, -1.0) * (margins - cut)
    slope = 2.0 / max(float(np.median(np.abs(side))), 1e-6)
    return slope, float(np.log(threshold / (1 - threshold)) - slope * cut)


def fit_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The classifier of ``docs(doc_id, text)`` and ``labels(doc_id, label)``.

    Of the labels, the ``fit_rows`` rows with the smallest id hashes are used;
    of documents that share an id, the first text in code-point order.
    Null labels are left out; a doc_id with several labels has the largest.
    Without rows of both labels the model gives each text the share of label 1.
    """
    spark = docs.sparkSession
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int"))
    parts = max(2, min(16, spark.sparkContext.defaultParallelism))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label", "fold").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = stored(small_batches(rows).repartition(parts, "doc_id").sortWithinPartitions("doc_id", "text"), "toxic-sample")
    n = {(r.fold, r.label): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    n = {(f, y): n.get((f, y), 0) for f in (0, 1) for y in (0, 1)}
    everything = sum(n.values())
    toxic = n[0, 1] + n[1, 1]
    if not toxic or toxic == everything:
        share = min(max(toxic / everything if everything else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    counts = rows.mapInArrow(_gram_counts, "gram long, n00 long, n01 long, n10 long, n11 long")
    counts = stored(counts.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n00", "n01", "n10", "n11")]), "toxic-grams")
    c = {(f, y): F.col(f"n{f}{y}") for f in (0, 1) for y in (0, 1)}

    model = _regression(rows, *_ratios(counts, c[0, 0] + c[1, 0], c[0, 1] + c[1, 1], everything - toxic, toxic))
    seen = []
    if all(n.values()):
        for fold in (0, 1):
            other = 1 - fold
            part = _regression(rows.where(F.col("fold") == other),
                               *_ratios(counts, c[other, 0], c[other, 1], n[other, 0], n[other, 1]))
            seen += _margins(rows.where(F.col("fold") == fold), part)
    else:
        seen = _margins(rows, model)
    model.slope, model.shift = calibrate(np.array([m for m, _ in seen]), np.array([y for _, y in seen]))
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1); null text counts as empty.  All
    columns of ``docs`` stay (a column named score is replaced)."""
    names = [c for c in docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        table = held.table()
        for batch in slices(batches):
            scores = held.score(np.array([held.margin(t, table) for t in _texts(batch)], np.float64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(scores, pa.float64())],
                                             names=[*names, "score"])

    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text mod 3
    is 1 (a null id is not held out; it has no label either)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The classifier of ``toxic`` labels outside the held-out rows."""
    known = labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    return fit_model(docs, known, fit_rows)


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``; an empty
    table gives no rows."""
    scored = score_documents(docs.select("doc_id", "text"), toxicity_model(docs, labels, fit_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, columns as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scored = score_documents(docs.select(row, "text"), toxicity_model(docs, labels, fit_rows))
    return scored.where(F.col("score") < threshold).select("row.*")
