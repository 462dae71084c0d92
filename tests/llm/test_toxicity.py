import math

import numpy as np
from pyspark.sql import functions as F

from clickspark.llm import toxicity
from clickspark.llm.queries import op3_toxicity
from tests.conftest import SF_ORACLE


def likelihood(w, t, rows, cols, grades, l2):
    s = np.bincount(rows, weights=w[cols], minlength=len(grades))
    edges = np.r_[-np.inf, t, np.inf]
    p = 1 / (1 + np.exp(-(edges[grades + 1] - s))) - 1 / (1 + np.exp(-(edges[grades] - s)))
    return np.log(p).mean() - l2 / 2 * (w @ w)


def test_fit_reaches_the_optimum_and_orders_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((600, 5)) < 0.3
    s = x @ np.array([2.0, 1.0, 0.0, -1.0, 0.5]) + rng.logistic(size=600)
    grades = (s > 0.5).astype(int) + (s > 1.5) + (s > 3)
    rows, cols = np.nonzero(x)
    w, t = toxicity.fit_ordinal(rows, cols, grades, np.full(5, 1e-3), clean_share=(grades == 0).mean())
    assert (np.diff(t) > 0).all() and np.abs(w - [2, 1, 0, -1, 0.5]).max() < 0.5
    best = likelihood(w, t, rows, cols, grades, 1e-3)
    for i in range(5):
        for step in (-1e-2, 1e-2):
            assert likelihood(w + step * np.eye(5)[i], t, rows, cols, grades, 1e-3) <= best + 1e-7
    for i in range(3):
        for step in (-1e-2, 1e-2):
            assert likelihood(w, t + step * np.eye(3)[i], rows, cols, grades, 1e-3) <= best + 1e-7


def test_held_out_accuracy(spark):
    big = SF_ORACLE.replace("sf0.01", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = toxicity.fit_toxicity(docs, labels.filter(~held))
    graded = toxicity.grade_documents(docs, model).join(labels.filter(held).withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    hit = (graded["toxic"] == (graded["label"] == 1))
    assert len(graded) > 1000 and hit.mean() > 0.97
    assert hit[graded["label"] == 0].mean() > 0.995 and hit[graded["label"] == 1].mean() > 0.8
    assert graded[graded.label == 1].severity.mean() > 1 > 0.1 > graded[graded.label == 0].severity.mean()
    assert len(model.thresholds) == 2


def test_query_grades_every_document(spark):
    rows = op3_toxicity(spark, SF_ORACLE)
    assert rows.count() == spark.read.parquet(f"{SF_ORACLE}/documents.parquet").count()
    again = op3_toxicity(spark, SF_ORACLE)
    assert rows.exceptAll(again).count() == 0


def plain_features(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return {*words, *(w[:4] + "*" for w in words if len(w) > 4)}


def test_query_equals_a_plain_version(spark):
    """Sample, feature choice, grades and scores without Spark; only the optimiser (tested above) is shared."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text").collect()]
    label = {}
    for r in spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect():
        if r.doc_id is not None and r.toxic is not None:
            label[r.doc_id] = max(label.get(r.doc_id, 0), int(r.toxic > 0))
    assert len(label) <= 8000  # so the sample is every labelled document
    texts = {}
    for i, t in docs:
        if i in label and t is not None:
            texts[t] = max(texts.get(t, 0), label[i])
    held = [(y, plain_features(t)) for t, y in texts.items()]
    n, n1 = len(held), sum(y for y, _ in held)
    marks = {}
    for f in sorted(set().union(*(s for _, s in held))):
        c, a = sum(f in s for _, s in held), sum(y for y, s in held if f in s)
        if 5 <= c < n:
            p = c / n
            z = (a / n1 - (c - a) / (n - n1)) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1)))
            if abs(z) > 4.5:
                marks[f] = z
    names = list(marks)
    held = sorted((y, sorted(names.index(f) for f in s if f in marks)) for y, s in held)
    strong = {i for i, f in enumerate(names) if marks[f] > max(marks.values()) / 3 and not f.endswith("*")}
    middle = np.median([len(strong & set(h)) for y, h in held if y])
    grades = np.array([y + (y and len(strong & set(h)) > middle) for y, h in held])
    penalty = np.array([1e-6 * max(map(abs, marks.values())) / abs(marks[f]) for f in names])
    weights, edges = toxicity.fit_ordinal(np.repeat(np.arange(n), [len(h) for _, h in held]), np.concatenate([h for _, h in held]).astype(int), grades, penalty)
    weight = dict(zip(names, weights, strict=True))
    expected = []
    for i, t in docs:
        score = sum(weight.get(f, 0.0) for f in plain_features(t))
        over = [1 / (1 + math.exp(min(max(e - score, -60), 60))) for e in edges]
        chance = [1 - over[0], over[0] - over[1], over[1]]
        expected.append((i, round(sum(over), 6), chance.index(max(chance)), over[0] >= 0.5 and score > 0))
    got = [(r.doc_id, round(r.severity, 6), r.grade, r.toxic) for r in op3_toxicity(spark, SF_ORACLE).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_nulls_repeats_empty_and_clashing_names(spark):
    texts = [f"you idiot{'!' * i} scum" for i in range(12)] + [f"kind word number {'abcdefghijkl'[i]}" for i in range(12)]
    docs = spark.createDataFrame([(i, t, 1.5, [1]) for i, t in enumerate(texts)] + [(None, None, None, None), (3, "", None, None), (0, texts[0], 1.0, None), (99, "You IDIOT scum " * 20_000, 0.0, None)],
                                 "doc_id long, text string, severity double, toxic array<int>")
    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(24)] + [(None, 1), (5, None), (0, 0), (777, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs.filter("text <> ''"), labels, z=3)
    graded = toxicity.grade_documents(docs, model).collect()
    assert len(graded) == docs.count()
    assert all(r.toxic == (r.doc_id is not None and (r.doc_id < 12 or r.doc_id == 99)) for r in graded if r.doc_id != 3 or r.toxic)
    assert all(r.severity < 0.51 for r in graded if r.doc_id is None)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema and kept.count() == 14
    assert toxicity.grade_documents(docs.limit(0), model).collect() == [] and toxicity.drop_toxic(docs.limit(0), model).collect() == []
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.grade_documents(docs, none).collect())
