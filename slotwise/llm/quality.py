"""Quality classifier: random Fourier features over document statistics, ridge
regression by partition-summed normal equations, isotonic calibration.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import labelled
from slotwise.llm.common import added, blocks_of, cut, documents
from slotwise.llm.words import SPACE, shingles, word_hashes

FEATURES = 256
RIDGE = 1e-3
SEED = 17

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_HIGH = np.arange(256) >= 128
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SYMBOL = np.array([b in b"#$%&*+/<=>@\\^_`{|}~" for b in range(256)])


def statistics(text: str) -> list[float]:
    """Statistics of a text, in whatever language."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(data), 1)
    count = np.bincount(data, minlength=256)
    letters = max(int(count[_LETTER].sum() + count[_HIGH].sum()), 1)
    hashes, start, end = word_hashes(text)
    words = max(len(hashes), 1)
    lengths = end - start
    runs = shingles(hashes, 3)
    lines = [x for x in text.split("\n") if x]
    p = count[count > 0] / n
    return [
        math.log1p(len(data)),
        math.log1p(len(hashes)),
        count[_UPPER].sum() / letters,
        count[_SYMBOL].sum() / words,
        count[ord("!")] / words,
        count[ord("|")] / words,
        (count[ord(".")] + count[ord(",")]) / words,
        count[_DIGIT].sum() / n,
        count[SPACE].sum() / n,
        count[_HIGH].sum() / n,
        float(lengths.mean()) if len(lengths) else 0.0,
        float(lengths.std()) if len(lengths) else 0.0,
        len(np.unique(hashes)) / words,
        len(np.unique(runs)) / max(len(runs), 1),
        len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
        float(-(p * np.log(p)).sum()) if len(data) else 0.0,
        float(np.mean(hashes[1:] == hashes[:-1])) if len(hashes) > 1 else 0.0,
    ]


WIDTH = len(statistics(""))


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    low: float
    high: float
    steps: np.ndarray


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features whose inner product approximates a Gaussian kernel over the
    standardised statistics, of a width that grows with their number."""
    g = np.random.Generator(np.random.PCG64(SEED))
    w = g.normal(0, 1 / math.sqrt(WIDTH), (WIDTH, FEATURES))
    b = g.uniform(0, 2 * math.pi, FEATURES)
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([math.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])


def _table(docs: DataFrame, *carried: str) -> DataFrame:
    """The statistics of each row, beside the carried columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(x, pa.list_(pa.float64()))], [*carried, "x"])

    source = docs.select(*carried, "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields if f.name in carried)
    return source.mapInArrow(run, f"{kinds}, x array<double>")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, WIDTH)
    return x, batch.column("y").to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, part) -> dict[int, np.ndarray]:
    """The sum over all tasks of ``part(x, y)``, a matrix of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((part(*_arrays(b)) for b in batches if b.num_rows), 0.0)
        if not np.isscalar(total):
            yield blocks_of(total)

    return added(rows.select("x", "y").mapInArrow(run, "block int, values binary"))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model learned from a bounded sample of the labelled documents
    outside the held-out fold; None without labels of both kinds."""
    chosen = F.broadcast(labelled.sample(labels, "quality"))  # of bounded size
    rows = cut(_table(documents(docs).join(chosen, "doc_id"), "y", "fold"))
    learn, tune = rows.where("fold < 4"), rows.where("fold = 4")
    sums = _summed(learn, lambda x, y: np.vstack([x.sum(0), (x * x).sum(0), np.r_[len(x), y.sum(), np.zeros(WIDTH - 2)]]))
    if not sums or not 0 < sums[2][1] < sums[2][0]:
        return None
    n = sums[2][0]
    mean = sums[0] / n
    scale = np.sqrt(np.maximum(sums[1] / n - mean * mean, 0)) + 1e-6

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier(x, mean, scale)
        return np.hstack([z.T @ z, z.T @ y[:, None]])

    equations = _summed(learn, normal)
    m = np.array([equations[i] for i in range(FEATURES + 1)])
    weights = np.linalg.solve(m[:, :-1] + RIDGE * n / FEATURES * np.eye(FEATURES + 1), m[:, -1])
    low, high = -0.5, 1.5

    def bins(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = place(fourier(x, mean, scale) @ weights, low, high)
        return np.vstack([np.bincount(at, minlength=labelled.BINS), np.bincount(at, y, minlength=labelled.BINS)])

    seen = _summed(tune, bins) or _summed(learn, bins)
    return Model(mean, scale, weights, low, high, labelled.isotonic(seen[0], seen[1]))


def place(raw: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip((raw - low) / (high - low) * labelled.BINS, 0, labelled.BINS - 1).astype(int)


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    """Calibrated probabilities; a thousandth is left to the raw score, so that
    documents on one step stay in order."""
    raw = fourier(x, model.mean, model.scale) @ model.weights
    at = np.clip((raw - model.low) / (model.high - model.low), 0, 1)
    return 0.999 * np.interp(at * labelled.BINS - 0.5, np.arange(labelled.BINS), model.steps) + 0.001 * at


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document.

    Null and empty texts are scored by their (zero) statistics, and very long
    ones whole; repeated rows are scored alike; a null doc_id is not held out;
    further columns, whatever their names, play no part. Without labels of both
    kinds every score is 0.5. An empty table gives no rows.
    """
    rows = documents(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(-1, WIDTH)
            score = scores(model.value, x) if model.value is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject:
    all of them without labels of both kinds. Nulls, repeated rows, very long
    texts and empty tables as in ``classify``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.value is not None:
                x = np.array([statistics(t.as_py() or "") for t in batch.column("text")]).reshape(-1, WIDTH)
                batch = batch.filter(pa.array(scores(model.value, x) >= threshold))
            yield batch

    return docs.mapInArrow(run, docs.schema)
