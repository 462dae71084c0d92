"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade > j) = sigmoid(w.x - t_j): one weight vector for all thresholds t_1 < t_2 < ... . The features
x are the words of a text and the first letters of its longer words, each present or not.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.llm.storage import materialise

_WORD = re.compile(r"[^\W\d_]+")
_PREFIX = 4


def features(text: str | None) -> set[str]:
    """Lower-cased letter runs, and ``abcd*`` for runs of more than four letters."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:_PREFIX] + "*" for w in words if len(w) > _PREFIX}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(z, -60, 60)))


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by feature and rising thresholds; grades are 0 to len(thresholds)."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, text: str | None) -> float:
        w = self.weights
        return math.fsum(w[f] for f in features(text) & w.keys())

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for j = 0 .. K - 2, one row per score."""
        return _sigmoid(np.asarray(scores, dtype=float)[:, None] - np.array(self.thresholds)[None, :])

    def toxic(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > 0) is at least one half, and some feature speaks for it."""
        return (self.exceed(scores)[:, 0] >= 0.5) & (np.asarray(scores) > 0)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, l2: np.ndarray,
                steps: int = 2000, clean_share: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) that maximise the mean log likelihood minus sum(l2 * w^2) / 2.

    Texts of grade 0 make up ``clean_share`` of the mean, however rare the others are. ``rows`` and
    ``cols`` are the positions of the ones of the binary feature matrix. Thresholds are the first one
    and logs of the gaps, so they stay in order. Full-batch Adam; no randomness.
    """
    n, top, width = len(grades), int(grades.max()), len(l2)
    clean = (grades == 0).mean()
    each = np.where(grades == 0, clean_share / max(clean, 1e-9), (1 - clean_share) / max(1 - clean, 1e-9)) / n
    share = [np.clip(each[grades > j].sum(), 1e-4, 1 - 1e-4) for j in range(top)]
    first = [-math.log(p / (1 - p)) for p in share]
    gaps = [math.log(max(b - a, 1e-2)) for a, b in zip(first, first[1:], strict=False)]
    p = np.concatenate([np.zeros(width), [first[0]], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, t = p[:width], np.cumsum(np.r_[p[width], np.exp(p[width + 1:])])
        s = np.bincount(rows, weights=w[cols], minlength=n)
        edges = np.r_[-np.inf, t, np.inf]
        upper, lower = _sigmoid(edges[grades + 1] - s), _sigmoid(edges[grades] - s)
        likelihood = np.maximum(upper - lower, 1e-12)
        du, dl = each * upper * (1 - upper) / likelihood, each * lower * (1 - lower) / likelihood
        du[grades == top] = 0
        dl[grades == 0] = 0
        gw = np.bincount(cols, weights=(dl - du)[rows], minlength=width) - l2 * w
        gt = np.bincount(grades, weights=du, minlength=top + 1)[:top] - np.bincount(grades, weights=dl, minlength=top + 1)[1:]
        chain = np.cumsum(gt[::-1])[::-1]  # a threshold moves with every gap before it
        g = np.concatenate([gw, [chain[0]], chain[1:] * np.exp(p[width + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.05 * (1 - step / (steps + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return p[:width], np.cumsum(np.r_[p[width], np.exp(p[width + 1:])])


def telling(sample: DataFrame, least: int, z: float) -> dict[str, float]:
    """z score of each feature that at least ``least`` texts of ``sample`` (features, label) hold and
    whose share differs between toxic and clean texts by more than ``z`` standard errors."""
    totals = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("n1"), F.count("*").alias("n")).first()
    n1, n = totals["n1"], totals["n"]
    if not 0 < n1 < n:
        return {}
    held = sample.select(F.explode("features").alias("feature"), "label").groupBy("feature").agg(F.sum("label").alias("a"), F.count("*").alias("c"))
    p = F.col("c") / n
    score = (F.col("a") / n1 - (F.col("c") - F.col("a")) / (n - n1)) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1)))
    found = held.filter((F.col("c") >= least) & (F.col("c") < n)).select("feature", score.alias("z")).filter(F.abs("z") > z)
    return {r["feature"]: r["z"] for r in found.orderBy("feature").collect()}


def severity_grades(sets: list[set[str]], toxic: np.ndarray, marks: dict[str, float]) -> np.ndarray:
    """0 for clean texts; toxic ones get 2 if they hold more of the strongest toxic words than the
    median toxic text, else 1. The labels only say toxic or not, so the number of such words ranks
    them; strong is a z score of at least a third of the highest."""
    least = max(marks.values()) / 3
    strong = {f for f, score in marks.items() if score > max(least, 0) and not f.endswith("*")}
    held = np.array([len(s & strong) for s in sets])
    return toxic.astype(int) + (toxic & (held > np.median(held[toxic]))).astype(int)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic") -> DataFrame:
    """Features and label (0 or 1) of at most ``max_rows`` labelled documents, those with the smallest
    id hashes.

    Null ids and labels are left out, an id labelled twice is toxic if one label says so, equal
    texts count once.
    """
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # the words of few texts at a time
                some = batch.iloc[at:at + 256]
                yield pd.DataFrame({"features": [sorted(features(t)) for t in some["text"]], "label": some["label"].to_numpy()})

    chosen = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col(label_col).cast("int") > 0).cast("int")).alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("text", "label")  # at most max_rows
    once = rows.filter("text is not null").groupBy(F.xxhash64("text")).agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return materialise(once.select("text", "label").mapInPandas(extract, "features array<string>, label int"), "labelled")


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, least: int = 5, z: float = 4.5, l2: float = 1e-6, **columns: str) -> OrdinalModel:
    """Fit on a bounded sample of labelled rows (``max_rows``, see :func:`labelled_sample`).

    Features are chosen by :func:`telling` on the executors; the driver gets the chosen features of
    the sample and nothing else. Grades come from :func:`severity_grades`. Without toxic or without
    clean examples the model has no weights and calls nothing toxic.
    """
    sample = labelled_sample(docs, labels, max_rows, **columns)
    marks = telling(sample, least, z)
    if not marks:
        return OrdinalModel({}, (60.0,))
    number = {f: i for i, f in enumerate(sorted(marks))}

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"held": [sorted(number[f] for f in fs if f in number) for fs in batch["features"]], "label": batch["label"]})

    # sorted, so that reruns agree to the last bit
    held = sorted((r["label"], r["held"]) for r in sample.mapInPandas(reduce, "held array<int>, label int").collect())
    names, toxic = list(number), np.array([label > 0 for label, _ in held])
    grades = severity_grades([{names[i] for i in h} for _, h in held], toxic, marks)
    rows = np.repeat(np.arange(len(held)), [len(h) for _, h in held])
    cols = np.array([i for _, h in held for i in h], dtype=np.int64)
    best = max(map(abs, marks.values()))
    penalty = np.array([l2 * best / abs(marks[f]) for f in names])  # chance features are held back
    weights, thresholds = fit_ordinal(rows, cols, grades, penalty)
    return OrdinalModel({f: float(weights[i]) for f, i in number.items()}, tuple(map(float, thresholds)))


def grade_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``severity`` (expected grade), ``grade`` (the most likely one), ``p_toxic`` and
    ``toxic`` (:meth:`OrdinalModel.toxic`) for every row, from its whole text.

    A null or empty text has no features: it gets the severity of the thresholds alone and is not toxic. Repeated
    rows each come back, a null id stays null, an empty table gives no rows. Only the two named
    columns are read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = np.array([model.score(t) for t in batch["text"]])
            over = model.exceed(scores)
            chance = -np.diff(np.c_[np.ones(len(over)), over, np.zeros(len(over))], axis=1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "severity": over.sum(axis=1), "grade": chance.argmax(axis=1).astype("int32"),
                                "p_toxic": over[:, 0], "toxic": model.toxic(scores)})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    graded = rows.mapInPandas(run, "doc_id string, severity double, grade int, p_toxic double, toxic boolean")
    return graded.withColumn("doc_id", F.col("doc_id").cast("long"))


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(~model.toxic(scores)))

    return docs.mapInArrow(run, docs.schema)
