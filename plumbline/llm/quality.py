"""Quality scores: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are its words, pairs of neighbouring words, and the same of the words' shapes (letters, capitals,
digits and other bytes as classes, runs as one), hashed to 2**18 weights. A text's score is the sparse dot product of
its feature shares with the weights. Words are found and hashed for a megabyte of text at a time by array operations.

Training reads at most ``TRAIN_ROWS`` labelled texts (a documented bound; those with the smallest hashes of ids, ids and
texts, however often an id repeats), in that order, so that a lost task trains the same model again. Texts become counts of
hashed features (2**18 at most, however long the text is) where they are read; the one task that learns, as each update needs
the one before, gets these sorted by epoch and holds a batch of them at a time, never the sample. The weights (1 MB)
travel with the scoring tasks.
Nulls: a null text is empty and gets the score of the bias; null labels and ids are not learned from. A document with
several labels counts as 1 if any is 1. Repeated rows are scored one by one; equal scores are equal chances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, cut, crc_bucket, extend, lower, mix, sample_of, span_hash, table, word_bounds

BITS = 18
#: Rows, at most, that the model learns from, and how often it sees them.
TRAIN_ROWS, EPOCHS = 6000, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
#: A feature's value is its share of the text's features, times this.
SCALE = 30.0
PREDICT_AT = 0.3

_CLASS = np.full(256, ord("p"), np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[0x80:] = ord("a")
for _c in b".,;:'\"!?#$%&*()[]{}<>|/\\@=_-+~^`":
    _CLASS[_c] = _c


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and the row of each."""
    starts, ends, first = word_bounds(data, at)
    row = np.repeat(np.arange(at.size - 1), np.diff(first))
    words = span_hash(lower(data), starts, ends)
    kind = _CLASS[data]
    turn = np.ones(data.size, bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[starts] = True
    pos = np.concatenate([[0], np.cumsum(turn)])
    shapes = span_hash(kind[turn], pos[starts], pos[ends])
    near = row[1:] == row[:-1]
    pair = lambda h, salt: mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(7) + np.uint64(salt))[near]
    found = np.concatenate([words, pair(words, 1), mix(shapes + np.uint64(2)), pair(shapes, 3)]) if starts.size else np.zeros(0, np.uint64)
    rows = np.concatenate([row, row[1:][near], row, row[1:][near]]) if starts.size else np.zeros(0, np.int64)
    return (found >> np.uint64(64 - BITS)).astype(np.int64), rows


def sums(weights: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The dot product of every row's feature shares with the weights."""
    n = at.size - 1
    index, row = features(data, at)
    total = np.bincount(row, weights[index], n)
    return SCALE * total / np.maximum(np.bincount(row, minlength=n), 1)


class Ftrl:
    """Logistic regression by follow-the-regularised-leader, each coordinate with its own rate; the bias is the last."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        i, x = np.append(i, self.z.size - 1), np.append(x, 1.0)
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        step = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - step * w
        self.n[i] += g * g


def _counted():
    """Turns texts into the distinct features of each, how often it has them, and their number in all."""

    def work(part, data, at):
        index, row = features(data, at)
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(1, part.num_rows))
        pairs = [np.unique(one.astype(np.int32), return_counts=True) for one in np.split(index[order], cuts)]
        found, often = ([x.astype(np.int32).tobytes() for x in xs] for xs in zip(*pairs, strict=True))
        return [pa.array(found, pa.binary()), pa.array(often, pa.binary()), pa.array([int(n.sum()) for _, n in pairs], pa.int64())]

    return work


def _train(batches):
    """Learns from rows as they come, and gives the weights after the last."""
    model = Ftrl(1 << BITS)
    for batch in batches:
        for found, often, size, y, times in zip(*(batch.column(c) for c in ("found", "often", "size", "y", "times")), strict=True):
            i, n = (np.frombuffer(x.as_py(), np.int32) for x in (found, often))
            for _ in range(times.as_py()):
                model.learn(i, SCALE * n / max(1, size.as_py()), y.as_py())
    yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], names=["weights"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights, bias last, learned from the labelled rows (at most ``most`` of them)."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    chosen = cut(sample_of(known, "id", most))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # of at most `most` ids
    rows = texts.select(F.xxhash64("id").alias("h"), "id", "text", F.xxhash64("text").alias("t"), F.col("y").cast("double").alias("y"))
    counted = cut(extend(rows, _counted, "found binary, often binary, size long", "text", drop=("text",)))
    key = ["h", "id", "t"]
    taken = cut(counted.select(key).orderBy(key).limit(most).groupBy(key).agg(F.count("*").alias("times")))  # `most` rows at most
    epochs = counted.join(F.broadcast(taken), key).dropDuplicates(key).withColumn("epoch", F.explode(F.lit([*range(EPOCHS)])))
    got = epochs.repartition(1).sortWithinPartitions("epoch", *key).mapInArrow(_train, "weights binary").first()
    return np.frombuffer(got["weights"], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``score``: the chance of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = held.value.astype(np.float64)
        return lambda part, data, at: [pa.array(1 / (1 + np.exp(-np.clip(sums(w[:-1], data, at) + w[-1], -30, 30))))]

    return extend(docs, make, "score double", text_col, STEP_BYTES, drop)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, table(spark, sf_dir, "labels").filter(crc_bucket("doc_id", 5) != 0))
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score(docs, weights, drop=("text",)).select("doc_id", held_out, "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
