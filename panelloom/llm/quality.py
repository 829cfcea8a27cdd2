"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is linear in its features. In a preference pair (a good
and a bad labelled document) the good one wins with the probability that the
logistic function gives to the difference of strengths; weights minimise the
logistic loss on feature differences. The threshold is a quantile of the
training scores: the share of bad documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import Workspace, id_hash_mod, spread

FOLDS, HELD_OUT = 5, 0
#: Labelled documents of each class that the weights are learned on, at most.
SAMPLE_EACH = 1000
PAIRS = 30_000
CUTOFF = 0.3
#: Ten shape features, then the shares of the 256 byte values.
SHAPE = 10


def text_features(text: str | None) -> np.ndarray:
    """Features of a whole text; all zero if null or empty."""
    out = np.zeros(SHAPE + 256)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    out[SHAPE:] = np.sqrt(hist)
    words = raw.split()
    n = max(1, len(words))
    lines = raw.split(b"\n")
    lower = hist[97:123].sum()
    upper = hist[65:91].sum()
    out[:SHAPE] = (
        np.log1p(len(words)),
        np.log1p(len(raw) / n),
        sum(map(eq, words, words[1:])) / n,  # words that repeat the one before
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        upper / max(1e-9, upper + lower),
        hist[48:58].sum(),
        hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum(),
        hist[128:].sum(),
        np.log1p(max(map(len, words), default=0)),
    )
    return out


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Logistic in the strength; the threshold quantile gets the cutoff score."""
        z = (self.strength(x) - self.threshold) * self.slope + np.log(CUTOFF / (1 - CUTOFF))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 300) -> Ranker:
    """Learn from features and labels. With one class only, every document scores alike, on its side of the cutoff."""
    width = x.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(width)
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(width)
    up, down = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(up) or not len(down):
        return Ranker(mean, scale, np.zeros(width), -1.0 if len(up) or not len(x) else 1.0, 1.0)
    z = (x - mean) / scale
    dice = np.random.default_rng(0)
    d = z[dice.choice(up, pairs)] - z[dice.choice(down, pairs)]
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for k in range(1, steps + 1):  # Adam on the whole set of pairs
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        g = -(p @ d) / pairs + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    s = z @ w
    ordered = np.sort(s)
    cut = len(down)  # as many documents lie under the quantile as are bad
    threshold = (ordered[cut - 1] + ordered[cut]) / 2
    slope = 3.0 / max(1e-6, float(np.median(s[up]) - threshold))
    return Ranker(mean, scale, w, float(threshold), min(slope, 100.0))


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "good", "x"])

    return docs.select("doc_id", "good", "text").mapInArrow(run, "doc_id long, good int, x array<double>")


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of the labels outside the held-out fold."""
    return labels.where(F.col("quality").isin(0, 1) & (id_hash_mod("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))


def train(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> Ranker:
    """Fit on labelled documents outside the held-out fold, ``each`` of either class (lowest hash of doc_id)."""
    known = _known(labels)
    order = Window.partitionBy("good").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select(F.col("doc_id").alias("_id"), "good")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most ``each`` of two classes
    rows = sorted(_features(texts).groupBy("doc_id", "good").agg(F.min("x").alias("x")).collect())
    return fit(np.array([r.x for r in rows]).reshape(len(rows), SHAPE + 256), np.array([r.good for r in rows]))


def calibrated(model: Ranker, strengths: DataFrame, labels: DataFrame) -> Ranker:
    """The model with its threshold at the quantile of all labelled strengths outside the held-out fold
    under which as many lie as are bad, and the slope from the median of the good ones."""
    known = _known(labels).withColumnRenamed("doc_id", "_id")
    rows = strengths.join(known, F.col("doc_id") == F.col("_id")).select("s", "good")
    n, bad, middle = rows.agg(F.count("*"), F.count_if(F.col("good") == 0), F.percentile_approx(F.when(F.col("good") == 1, F.col("s")), 0.5, 100_000)).first()
    if not bad or bad == n:
        return model
    low = rows.agg(F.percentile_approx("s", bad / n, 100_000)).first()[0]
    high = rows.where(F.col("s") > low).agg(F.min("s")).first()[0]
    threshold = low if high is None else (low + high) / 2
    return replace(model, threshold=float(threshold), slope=min(3.0 / max(1e-6, middle - threshold), 100.0))


def score_quality(docs: DataFrame, labels: DataFrame, space: Workspace, each: int = SAMPLE_EACH) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text).

    Labels that are null or not 0 or 1 are ignored; of contradicting labels the
    lower holds. Null text counts as empty and is scored. Without labels every
    score is the same and over the cutoff. held_out is false for a null id. Rows
    that repeat are each returned and score the same; a very long text is counted
    whole; an empty table gives an empty result. The weights are fitted on a bounded
    sample, the threshold on all labelled rows."""
    model = train(docs, labels, each)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(t.as_py()) for t in batch.column(2)]).reshape(batch.num_rows, SHAPE + 256)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.strength(x))], ["doc_id", "held_out", "s"])

    held = F.coalesce(id_hash_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    strengths = space.write(spread(rows).mapInArrow(run, "doc_id long, held_out boolean, s double"), "strengths")
    final = calibrated(model, strengths, labels)
    z = (F.col("s") - final.threshold) * final.slope + math.log(CUTOFF / (1 - CUTOFF))
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))
    return strengths.select("doc_id", "held_out", score.alias("score"), (score >= CUTOFF).cast("int").alias("predicted"))
