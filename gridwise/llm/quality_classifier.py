"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader
(proximal, per coordinate) and scored as sparse dot products.

Features are hashed into 2**BITS places: one- and two-word n-grams of the lower-cased words, and one- to
three-word n-grams of word shapes (case, digits, marks, length, whether a word repeats one of the two before
it). A feature's value is its share among the text's n-grams of its kind, so a score is a mean of weights.

Training reads a bounded sample: the TRAIN_ROWS labelled rows that come first by a hash of doc_id, of those
whose crc32(doc_id as text) mod 3 is not 1. The sample goes to one task; the model (2**BITS floats) is
broadcast. Scoring reads every text once, without a shuffle.

A doc_id with several labels counts once, by the mean of its labels (1 from one half). Null and empty texts
get the score of the bias; a text of any length is scored whole; without any usable label all scores are 0.5; repeated
rows are scored alike; empty tables give an empty result; a null doc_id is not held out; labels, lang, source and doc_id
never enter a score. Other columns, also one named score, are ignored by classify() and kept as they are by accepted().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridwise.llm.common import Words, free, mix, passes, read, strings, tidy, tidy_group

BITS, TRAIN_ROWS, EPOCHS = 18, 6_000, 3
ALPHA, BETA, L1, L2 = 0.8, 1.0, 1e-5, 1e-6
#: Weight of each kind of n-gram in a text's vector.
KINDS = (("word", 1, 2.0), ("word", 2, 2.0), ("shape", 1, 4.0), ("shape", 2, 4.0), ("shape", 3, 4.0))
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!\"#$%&()*+/;:<=>?@[\\]^_`{|}~")] = True


def shapes(words: Words, h: np.ndarray) -> np.ndarray:
    """A hash of each word's shape."""
    data = words.data
    count = lambda mask: (lambda t: t[words.end] - t[words.start])(np.concatenate(([0], np.cumsum(mask, dtype=np.int64))))
    size = words.end - words.start
    upper, digit, mark, high = count((data >= 65) & (data <= 90)), count((data >= 48) & (data <= 57)), count(_MARKS[data]), count(data >= 128)
    same = lambda k: np.concatenate((np.zeros(min(k, len(h)), bool), (h[k:] == h[:-k]) & (words.doc[k:] == words.doc[:-k])))
    code = np.minimum(upper, 3) | np.minimum(digit, 3) << 2 | np.minimum(mark, 3) << 4 | (np.minimum(size, 60) // 4) << 6
    code |= (high > 0).astype(np.int64) << 10 | same(1).astype(np.int64) << 11 | same(2).astype(np.int64) << 12 | (upper + high >= size).astype(np.int64) << 13
    return mix(code.astype(np.uint64) + np.uint64(0x51ED270B))


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each kind: the place of every n-gram, its document, and the kind's weight."""
    words = Words(data, off)
    h = words.hashes(lower=True)
    of = {"word": h, "shape": shapes(words, h)}
    for i, (what, n, weight) in enumerate(KINDS):
        at, grams = words.ngrams(of[what], n)
        yield (mix(grams + np.uint64(i)) >> np.uint64(64 - BITS)).astype(np.int64), words.doc[at], weight


def vectors(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sparse vector of each text: places and values."""
    for lo, hi, data, off in passes(pa.array(texts, pa.string())):
        kinds = list(features(data, off))
        for d in range(hi - lo):
            parts = [(p[i:j], np.full(j - i, w / max(1, j - i))) for p, doc, w in kinds for i, j in [np.searchsorted(doc, [d, d + 1])]]
            places, inverse = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            yield places, np.bincount(inverse, np.concatenate([v for _, v in parts]), minlength=len(places))


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last, after FTRL-proximal updates over the texts in order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rows = [(np.append(p, 1 << BITS), np.append(v, 1.0)) for p, v in vectors(texts)]
    at_rest = lambda p: np.where(np.abs(z[p]) <= L1, 0.0, -(z[p] - np.sign(z[p]) * L1) / ((BETA + np.sqrt(n[p])) / ALPHA + L2))
    for _ in range(epochs):
        for (p, v), y in zip(rows, labels, strict=True):
            w = at_rest(p)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            z[p] += g - (np.sqrt(n[p] + g * g) - np.sqrt(n[p])) / ALPHA * w
            n[p] += g * g
    return at_rest(np.arange(len(z))).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """The model of the labelled texts that are not held out; at most rows of them."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(order=mix(group["doc_id"].to_numpy().astype(np.uint64))).sort_values("order")
        return pd.DataFrame({"model": [train([t or "" for t in group["text"]], group["label"].to_numpy()).tobytes()]})

    made = texts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(tidy_group(learn), "model binary").head(1)  # at most rows texts
    return np.frombuffer(made[0]["model"], np.float32) if made else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, model: np.ndarray, name: str = "score") -> DataFrame:
    """Every row of docs with its score, 0 to 1, in a new column."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            texts = strings(batch.column(at))
            out = np.full(len(texts), float(w[-1]))
            for lo, hi, data, off in passes(texts):
                for place, doc, weight in features(data, off):
                    first = np.searchsorted(doc, np.arange(hi - lo + 1))
                    total = np.concatenate(([0.0], np.cumsum(w[place], dtype=np.float64)))
                    out[lo:hi] += weight * (total[first[1:]] - total[first[:-1]]) / np.maximum(1, np.diff(first))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], [*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields]).add(name, DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs(doc_id, text) as doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(docs, fit(docs, labels, rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that the classifier predicts to be good."""
    name = free(docs.columns, "score")
    return score(docs, fit(docs, labels, rows), name).filter(F.col(name) >= 0.5).drop(name)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
