"""Document quality by Bradley-Terry pairwise ranking."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, small_batches, text_bytes

#: Labelled rows that the model is fitted on, at most: those of the smallest hash of the id.
SAMPLE = 20_000
#: Preference pairs that it is fitted on, at most.
PAIRS = 60_000
ACCEPT = 0.3

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
_MARKS = np.flatnonzero(~_LETTERS[:128])  # ASCII without letters: a feature each
_SHOUT = re.compile(rb"\b[A-Z]{2,}\b")
_SYMBOLS = re.compile(rb"[^\w\s\x80-\xff]{2,}")
N_FEATURES = len(_MARKS) + 12


def features(text: bytes) -> np.ndarray:
    """What is known of one text: shares of its bytes and shapes of its words and lines. Zeros for the empty text."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, m = len(text), len(_MARKS)
    out[:m] = np.log1p(200 * counts[_MARKS] / n)
    words, lines = text.split(), text.split(b"\n")
    k = max(len(words), 1)
    out[m:] = (
        counts[65:91].sum() / n, counts[128:].sum() / n, np.log1p(n), np.log1p(len(words)), (n - counts[32]) / k / 10,
        len(set(words)) / k, len(set(lines)) / len(lines), len(_SHOUT.findall(text)) / k, len(_SYMBOLS.findall(text)) / k,
        sum(w[:1].isdigit() for w in words) / k, max(map(len, words), default=0) / 50, np.log1p(n / len(lines)),
    )
    return out


def _feature_rows(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    raw = data.tobytes()
    rows = [features(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.array(rows).reshape(-1, N_FEATURES)


def preferences(z: np.ndarray, label: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    """Feature differences of a text of label 1 and one of label 0, `pairs` of them at most."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    return z[rng.choice(good, n)] - z[np.resize(rng.permutation(bad), n)]


def fit_bradley_terry(x: np.ndarray, label: np.ndarray, *, pairs: int = PAIRS, penalty: float = 1e-3, seed: int = 5) -> dict:
    """Weights w with P(a preferred to b) = 1 / (1 + exp(-w . (a - b))) over pairs of a text of label 1 and one of label 0.

    The threshold is the quantile of the scores that parts the labels best (the middle one of equals); the score of a
    text is a logistic curve through `ACCEPT` at that threshold. With one label only, every text scores that label.
    """
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return {"constant": 0.0 if len(bad) else 1.0}
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = np.inf
    z = np.clip((x - mean) / scale, -8, 8)
    d = preferences(z, label, pairs, seed)
    n = len(d)
    w = np.zeros(x.shape[1])
    for _ in range(15):  # Newton steps on the logistic loss
        p = 1 / (1 + np.exp(-(d @ w)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + penalty * np.eye(len(w)), d.T @ (1 - p) / n - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    wrong = np.concatenate([[0], np.cumsum(np.where(label[order] == 1, 1, -1))]) + len(bad)  # errors when the first i are rejected
    best = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[s[order[0]] - 1], (s[order][1:] + s[order][:-1]) / 2, [s[order[-1]] + 1]])
    cut = float(edges[best[len(best) // 2]])
    grid = np.array([0.25, 0.5, 1, 2, 4, 8]) / max(s.std(), 1e-9)
    shift = np.log(ACCEPT / (1 - ACCEPT))
    losses = [np.logaddexp(0, np.where(label == 1, -1, 1) * (g * (s - cut) + shift)).mean() for g in grid]
    return {"mean": mean, "scale": scale, "w": w, "cut": cut, "slope": float(grid[int(np.argmin(losses))]), "quantile": float(best[len(best) // 2] / len(s))}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    s = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (s - model["cut"]) + np.log(ACCEPT / (1 - ACCEPT)), -30, 30)))


def held_out() -> F.Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> dict:
    """A model of labels.quality from the texts of at most `sample` labelled rows that are not held out.

    Only labels 0 and 1 count; without any, every text scores 1. The sample is bounded, so it can be broadcast to the
    scan of the texts, and its features fit on the driver. Of texts that share an id the one of the least hash stands for it,
    so the rows that reach the driver are those of the sample and reruns fit the same model.
    """
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = chosen.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", F.xxhash64("text").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = pa.array(_feature_rows(b.column(2)).ravel(), pa.float64())
            x = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * N_FEATURES, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), x], names=["doc_id", "quality", "h", "x"])

    rows = texts.mapInArrow(run, "doc_id long, quality int, h long, x array<double>").groupBy("doc_id", "quality").agg(F.min(F.struct("h", "x"))["x"].alias("x")).toArrow().to_pydict()
    order = np.lexsort((np.array(rows["quality"], dtype=np.int64), np.array(rows["doc_id"], dtype=np.int64)))
    x = np.array(rows["x"], dtype=float).reshape(-1, N_FEATURES)[order]
    return fit_bradley_terry(x, np.array(rows["quality"], dtype=int)[order])


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; null counts as the empty text. Only texts are read."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = predict(model, _feature_rows(b.column(2)))
            yield arrow_batch(schema, [b.column(0), b.column(1), score, (score >= ACCEPT).astype(np.int32)])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs whose text scores `ACCEPT` or more, with their columns as they are."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(predict(model, _feature_rows(b.column(names.index("text")))) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
