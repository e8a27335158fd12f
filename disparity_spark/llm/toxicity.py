"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic of a bias plus weights of the distinct words in
it; the document's score is the noisy-or 1 - (1 - leak) prod(1 - p) over its sentences with evidence, where the leak, the
score of the bias, counts once a document: sentences without evidence don't add up, so a long clean text is no more
toxic than a short one. Only document labels train it, by gradient steps on the noisy-or likelihood; the sentence scores
then tell where the offence stands. A word's weight is that of the word plus those of its beginnings, so that inflected
forms share evidence.

Training uses labelled rows alone whose crc32(doc_id) mod 5 isn't 0, at most `sample` of them in the order of a hash;
that bound is a parameter and the only sample taken. Features are counted and looked up on the executors; the driver
gets the chosen ones and their places in sentences, no texts. Scoring reads every text whole, and only the text.

Edge cases: a null or empty text has no sentence, so the score of the leak; rows with a null doc_id count as
not held out; null labels and labels without a document are unused; a doc_id labelled twice is toxic if one label
says so; equal texts train once; without both kinds of labels all weights are 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SENTENCE = re.compile(r"[^.!?\n|]+")
WORD = re.compile(r"\w+")
PREFIXES = range(4, 9)
#: Labelled documents that training uses at most.
SAMPLE = 8_000
FEATURES = 4_000
#: Documents that a feature must stand in, and how far it must lean to one label: a likelihood ratio (chi-squared of one
#: degree) of this many times the logarithm of the training documents, as more of them hold more features that lean by chance.
LEAST, LEAN = 3, 2.4
STEPS = 300
RATE = 0.1
L2 = 5e-5
BIAS = -6.0


def features(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct words in lower case)."""
    return [(m.start(), m.end(), set(WORD.findall(m[0].lower()))) for m in SENTENCE.finditer(text)]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def document_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def counted_features(rows: DataFrame) -> DataFrame:
    """feature, a, b: training documents without and with the label that have a feature."""

    def batches(it):
        import pyarrow as pa

        common.lean()
        counts: dict[str, list[int]] = {}
        for batch in common.sliced(it):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in document_words(text) for f in features(w)}:
                    counts.setdefault(f, [0, 0])[label] += 1
        names = list(counts)
        for at in range(0, len(names), 100_000):
            part = names[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([counts[f][k] for f in part], pa.int64()) for k in (0, 1)]], names=["feature", "a", "b"])

    return rows.select("text", "label").mapInArrow(batches, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def chosen_features(rows: DataFrame, n0: int, n1: int) -> list[str]:
    """Features that lean to one label beyond chance (likelihood ratio of the two-by-two table), the strongest first."""
    n, a, b = float(n0 + n1), F.col("a").cast("double"), F.col("b").cast("double")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (term(b, (a + b) * n1 / n) + term(a, (a + b) * n0 / n) + term(n1 - b, (n - a - b) * n1 / n) + term(n0 - a, (n - a - b) * n0 / n))
    strong = counted_features(rows).filter(F.col("a") + F.col("b") >= LEAST).withColumn("lean", F.round(ratio, 9)).filter(F.col("lean") > LEAN * math.log(n))
    return [r.feature for r in strong.orderBy(F.desc("lean"), "feature").limit(FEATURES).collect()]


def bags(rows: DataFrame, names: list[str]) -> DataFrame:
    """label, key (of the text), data: packed (sentence with evidence, feature, count) of each training document."""

    def batches(it):
        import pyarrow as pa

        common.lean()
        index = {f: i for i, f in enumerate(names)}
        for batch in common.sliced(it):
            packed = []
            for text in batch.column(0).to_pylist():
                found, n = [], 0
                for _, _, words in sentences(text):
                    own: dict[int, int] = {}
                    for f in (f for w in words for f in features(w)):
                        if f in index:
                            own[index[f]] = own.get(index[f], 0) + 1
                    found += [(n, i, k) for i, k in sorted(own.items())]
                    n += bool(own)
                packed.append(np.array(found, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(packed, pa.binary())], names=["label", "key", "data"])

    return rows.select("text", "label", F.xxhash64("text").alias("key")).mapInArrow(batches, "label int, key long, data binary")


def train(labels: list[int], data: list[bytes], names: list[str]) -> tuple[float, dict[str, float]]:
    """Bias and feature weights, by Adam on the noisy-or likelihood of packed bags, each with its leak."""
    y = np.array(labels, int)
    held = [np.frombuffer(d, "<i4").reshape(-1, 3) for d in data]
    # Every document's first instance is its leak, without features.
    lengths = np.array([1 + (int(h[-1, 0]) + 1 if len(h) else 0) for h in held], int)
    first = np.cumsum(lengths) - lengths
    of_doc, n = np.repeat(np.arange(len(y)), lengths), int(lengths.sum())
    of_sentence = np.concatenate([h[:, 0] + 1 + f for h, f in zip(held, first, strict=True)])
    column, value = np.concatenate([h[:, 1] for h in held]), np.concatenate([h[:, 2] for h in held]).astype(float)
    w = np.zeros(len(names) + 1)
    w[-1] = BIAS
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = w[-1] + np.bincount(of_sentence, w[column] * value, minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        whole = 1 - np.exp(np.bincount(of_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)))
        factor = np.where(y == 1, -(1 - whole) / np.maximum(whole, 1e-12), 1.0)
        dz = p * factor[of_doc]
        g = np.append(np.bincount(column, dz[of_sentence] * value, minlength=len(names)), dz.sum()) / len(y)
        g[:-1] += L2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(w[-1]), {f: float(x) for f, x in zip(names, w, strict=False) if abs(x) > 1e-3}


class Scorer:
    """(score, start, end, sentence score) of a text: the noisy-or and the worst sentence."""

    CACHE = 100_000

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights, self.cache = bias, weights, {}

    def weight(self, word: str) -> float:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > self.CACHE:
                self.cache.clear()
            found = self.cache[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return found

    def __call__(self, text: str) -> tuple[float, int, int, float]:
        low = text.lower()
        if len(low) != len(text):  # a few characters change their length; places are those of the text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        weight = self.weight
        base = 1 / (1 + np.exp(-self.bias))
        miss = float(np.log1p(-base))
        best = (base, 0, 0)
        for m in SENTENCE.finditer(low):
            total = sum(map(weight, set(WORD.findall(m[0]))))
            if total > 0:
                p = 1 / (1 + float(np.exp(-min(30.0, max(-30.0, self.bias + total)))))
                miss += float(np.log1p(-min(p, 1 - 1e-12)))
                if p > best[0]:
                    best = (p, m.start(), m.end())
        return 1 - float(np.exp(miss)), best[1], best[2], float(best[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, dict[str, float]]:
    """Train on at most `sample` labelled documents outside the held-out fold. Their ids are few enough to broadcast."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    bounded = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(bounded), "doc_id")
    rows = common.staged(rows.groupBy("text").agg(F.max("__toxic").alias("label")), "toxicity-sample")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return BIAS, {}
    names = chosen_features(rows, counts[0], counts[1])
    got = bags(rows, names).toPandas().sort_values(["key", "label", "data"])  # the same model from rows in any order
    return train(got["label"].tolist(), got["data"].tolist(), names)


def score(docs: DataFrame, model: tuple[float, dict[str, float]]) -> DataFrame:
    """doc_id, held_out, score, predicted, and the worst sentence: worst_start, worst_end (code points), worst_score."""

    def batches(it):
        import pyarrow as pa

        common.lean()
        scorer = Scorer(*model)
        for batch in common.sliced(it):
            rows = [scorer(t or "") for t in batch.column(1).to_pylist()]
            s, a, b, w = zip(*rows, strict=True) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.float64())], names=["doc_id", "held_out", "score", "predicted", "worst_start", "worst_end", "worst_score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int, worst_start long, worst_end long, worst_score double")


def drop_toxic(docs: DataFrame, model: tuple[float, dict[str, float]], limit: float = 0.5) -> DataFrame:
    """docs without the rows whose text scores `limit` or more; rows are scored where they are read, and nothing is shuffled."""
    schema = docs.schema

    def batches(it):
        import pyarrow as pa

        common.lean()
        scorer, at = Scorer(*model), schema.names.index("text")
        for batch in common.sliced(it):
            yield batch.filter(pa.array([scorer(t or "")[0] < limit for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(batches, schema)


def query(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
