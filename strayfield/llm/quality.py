"""A quality classifier by compression with zstandard dictionaries.

Two dictionaries are trained, on good and on bad labelled texts. A whole text is cut into chunks; each is
compressed with either dictionary. The normalised difference of the two sizes, with the plain
compression ratio beside it, is turned into a probability by a logistic calibration.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

CHUNK = 2048
LEVEL = 3


class Dictionaries:
    """Compressors with the dictionary of good and of bad texts; built anew where it is unpickled."""

    def __init__(self, good: bytes, bad: bytes):
        self.raw, self.ready = (good, bad), None

    def __getstate__(self):
        return {"raw": self.raw, "ready": None}

    def signals(self, text: str | None) -> np.ndarray:
        """Of the whole text: the difference of the sizes over its length and over their sum, the ratio to its length and that squared, 1.

        A frame's fixed bytes don't count, and a short text's difference is drawn towards none.
        """
        if self.ready is None:
            self.ready = []
            for d in self.raw:
                own = zstandard.ZstdCompressionDict(d)
                own.precompute_compress(level=LEVEL)
                zipper = zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False)
                self.ready.append((zipper, len(zipper.compress(b""))))
        raw = (text or "").encode("utf-8", "replace")
        good, bad = (sum(max(1, len(z.compress(raw[k : k + CHUNK])) - fixed) for k in range(0, len(raw), CHUNK)) for z, fixed in self.ready)
        ratio = min(good, bad) / (len(raw) + 16)
        return np.array([(bad - good) / (len(raw) + 64), (bad - good) / (bad + good + 32), ratio, ratio * ratio, 1.0])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; the classes weigh alike in the fit of the slope."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * len(y) * w * 1e-2
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]) * ridge
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class QualityModel:
    def __init__(self, dictionaries: Dictionaries, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.dictionaries, self.mean, self.scale, self.weights = dictionaries, mean, scale, weights

    def score(self, text: str | None) -> float:
        z = (self.dictionaries.signals(text) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, per_class: int, most_chars: int) -> tuple[DataFrame, dict[int, int]]:
    """About ``per_class`` rows (text, quality) of each label, picked by a hash of the id, of texts of up to ``most_chars``; and how many rows have each label."""
    marks = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = {r.quality: r.n for r in marks.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("quality") == k, F.lit(min(1.0, 1.1 * per_class / v))) for k, v in sorted(n.items())], F.lit(0.0))
    marks = marks.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) < share * 1_000_003)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text").between(1, most_chars))
    found = texts.join(F.broadcast(marks), "doc_id").select("doc_id", "text", "quality")  # about 2 x per_class rows are broadcast
    # repeated ids may bring more rows: which of them stay doesn't depend on the order they come in
    return found.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text", "quality").limit(4 * per_class), n


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, most_chars: int = 20_000, dictionary: int = 65_536) -> QualityModel | None:
    """Fit on a bounded sample of the labelled rows that aren't held out: half makes the dictionaries, half the calibration.

    None if either label is missing among them.
    """
    picked, n = sample(docs, labels, per_class, most_chars)
    rows = sorted(picked.collect(), key=lambda r: (r.doc_id, r.text, r.quality))
    half = {q: [r.text for r in rows if r.quality == q] for q in (0, 1)}
    if min(map(len, half.values())) < 2:
        return None
    built = []
    for q in (1, 0):
        raw = [t.encode() for t in half[q][::2]]
        chunks = [b[k : k + CHUNK] for b in raw for k in range(0, len(b), CHUNK)]
        try:
            built.append(zstandard.train_dictionary(dictionary, chunks, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too few samples for training: the text itself is the dictionary
            built.append(b"".join(chunks)[-dictionary:])
    own = Dictionaries(*built)
    y = np.array([q for q in (0, 1) for _ in half[q][1::2]], dtype=float)
    x = np.stack([own.signals(t) for q in (0, 1) for t in half[q][1::2]])
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale = 0, np.where(scale < 1e-9, 1, scale)
    weights = logistic((x - mean) / scale, y)
    weights[-1] += np.log(n[1] / n[0]) - np.log(y.sum() / (len(y) - y.sum()))  # from the sample's share of good texts to the labels'
    return QualityModel(own, mean, scale, weights)


def classify(docs: DataFrame, model: QualityModel | None, threshold: float = 0.7) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) per row of ``docs``, from its whole text alone.

    A null text counts as empty and is scored too. Without a model (no labels to learn from) every score is 0.5.
    Repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """

    def scored(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                s = [model.score(t) if model else 0.5 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")
