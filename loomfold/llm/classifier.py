"""Operator 9, quality classifier: naive Bayes support vectors.

Features are the words and word pairs of the lower-cased text, as indicators hashed to DIMENSIONS, and a few
indicators of the text's shape (length, share of symbols, digits, capitals, repeated words and lines, each in steps). Each
feature is scaled by its log-count ratio between the classes, a linear hinge-loss model is fitted by dual coordinate descent,
and margins of a two-fold cross-fit set the logistic curve that turns margins into scores.

The model is fitted on a bounded sample: the SAMPLE labelled rows of least hash among those whose crc32(doc_id as text)
mod 4 is not 2. Their ids are broadcast (the bound is SAMPLE), their features meet in one task, and the model alone (two arrays of
DIMENSIONS) reaches the driver. Every row is scored.
Labels, lang, source and doc_id are no inputs of a score.

Defined results: a null text is an empty one and has a score; a document labelled both ways, or whose label is null, does not
train; rows that share a doc_id train once; without labels of both classes every score is 0.5; each row gives one row; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfold.llm.common import lean, plain, table

SAMPLE, DIMENSIONS, EPOCHS, PENALTY, THRESHOLD, KEPT = 12_000, 1 << 18, 12, 0.1, 0.7, 100_000
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


class Features:
    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct features of a whole text."""
        words = WORD.findall(text.lower())
        if len(self.seen) > KEPT:
            self.seen.clear()
        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = zlib.crc32(w.encode())
        ids = np.fromiter((seen[w] for w in words), np.uint64, len(words))
        pairs = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]) >> np.uint64(40)
        lines = [x for x in text.split("\n") if x.strip()]
        n, chars = max(1, len(words)), max(1, len(text))
        shares = [
            len(set(words)) / n,
            sum(map(str.isupper, text)) / chars,
            sum(map(str.isdigit, text)) / chars,
            len(re.findall(r"[^\w\s]", text)) / chars,
            sum(map(len, words)) / n / 10,
            len(set(lines)) / max(1, len(lines)),
            min(1.0, np.log1p(n) / 12),
            min(1.0, len(lines) / n),
        ]
        shape = [zlib.crc32(f"shape {k} {int(v * 20)}".encode()) for k, v in enumerate(shares)]
        return np.unique(np.concatenate([ids, pairs, np.array(shape, np.uint64)]) % np.uint64(DIMENSIONS)).astype(np.int32)


def fit_svm(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weights by feature: log-count ratios times a hinge-loss model (dual coordinate descent, seeded order); the last is the bias."""
    positive, negative = np.ones(DIMENSIONS), np.ones(DIMENSIONS)
    for x, label in zip(rows, y, strict=True):
        (positive if label > 0 else negative)[x] += 1
    ratio = np.log((positive / positive.sum()) / (negative / negative.sum()))
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    scaled = [ratio[x] / max(1.0, np.linalg.norm(ratio[x])) for x in rows]
    norm = np.array([v @ v + 1.0 for v in scaled])
    share = np.array([np.mean(y < 0), np.mean(y > 0)])
    box = PENALTY * 10 * np.where(y > 0, share[0], share[1]) * 2
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], scaled[i]
            slope = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), box[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[x] += step * v
                bias += step
    return np.append(w, bias), ratio


def margin(model, x: np.ndarray) -> float:
    w, ratio = model
    v = ratio[x]
    return float(w[x] @ v / max(1.0, np.linalg.norm(v)) + w[-1])


def fit(rows: list[np.ndarray], quality: np.ndarray):
    """(weights, ratios), and slope and offset of the logistic curve; None without both classes."""
    y = np.where(quality == 1, 1.0, -1.0)
    if min((y > 0).sum(), (y < 0).sum()) < 2:
        return None
    place, out = np.zeros(len(y), int), np.zeros(len(y))
    for side in (-1.0, 1.0):
        at = np.flatnonzero(y == side)
        place[at] = np.arange(len(at)) % 2
    for fold in (0, 1):
        part = fit_svm([rows[i] for i in np.flatnonzero(place != fold)], y[place != fold])
        for i in np.flatnonzero(place == fold):
            out[i] = margin(part, rows[i])
    a, b, t = 1.0, 0.0, (y > 0).astype(float)
    for _ in range(50):  # Newton's method, with a little ridge
        p = 1 / (1 + np.exp(-np.clip(a * out + b, -30, 30)))
        g = np.array([((p - t) * out).sum() + 0.01 * a, (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * out * out).sum() + 0.01, (s * out).sum()], [(s * out).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return fit_svm(rows, y), float(a), float(b)


def train(docs: DataFrame, labels: DataFrame):
    """The fitted model, or None. Features go to one task, which holds at most SAMPLE rows; only the model comes to the driver."""
    one = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
    one = one.filter("q = q2 and doc_id is not null and crc32(cast(doc_id as string)) % 4 != 2").select("doc_id", "q")
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def features(batches):
        make = Features()
        for batch in batches:
            got = [make(plain(t)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], names=["doc_id", "q", "x"])

    def fit_all(batches):
        rows = sorted(r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "q", "x")), strict=True))
        model = fit([np.frombuffer(x, np.int32) for _, _, x in rows], np.array([q for _, q, _ in rows]))
        if model:
            (weights, ratio), a, b = model
            yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "ratio": [ratio.tobytes()], "a": [a], "b": [b]})

    joined = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(sample), "doc_id").selectExpr("doc_id", "cast(q as int) q", "text")
    # rows that share a doc_id train once, so that the sample's bound holds
    rows = joined.mapInArrow(lean(features), "doc_id long, q int, x binary").groupBy("doc_id", "q").agg(F.min("x").alias("x"))
    got = rows.coalesce(1).mapInArrow(fit_all, "weights binary, ratio binary, a double, b double").collect()
    return ((np.frombuffer(got[0].weights), np.frombuffer(got[0].ratio)), got[0].a, got[0].b) if got else None


def scorer(held):
    """A function that gives the scores of texts; the model is a broadcast."""
    make = Features()

    def scores(texts) -> list[float]:
        if held.value is None:
            return [0.5] * len(texts)
        fitted, a, b = held.value
        return [float(1 / (1 + np.exp(-np.clip(a * margin(fitted, make(plain(t))) + b, -30, 30)))) for t in texts]

    return scores


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id of each row, and its score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = scorer(held)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(lean(run), "doc_id long, score double")


def accepted(docs: DataFrame, model, least: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores `least` or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        scores = scorer(held)
        for batch in batches:
            keep = [x >= least for x in scores(batch.column(at).cast(pa.string()).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    # by number, as the names may hold dots
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return numbered.mapInArrow(lean(run), numbered.schema).toDF(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
