"""Quality classifier on supervised subword embeddings.

Every word, pair of neighbouring words and character 3- and 4-gram is hashed to
a learned vector; the vectors of a document are averaged and go through a
softmax layer. Both layers are trained by mini-batch stochastic gradient descent
in NumPy. As the output is linear in the average, scoring looks up one number per
feature (its vector times the softmax layer), which is the same sum in another
order. A word equal to its predecessor makes the pair feature of any repetition.

Null and empty texts have no feature and get the score of the bias alone; a text
of blanks has its character features. Letter case counts. Rows that repeat a
doc_id are scored each; a null doc_id is scored and in no fold. An empty table
gives an empty result; without two kinds of label every text has the labels'
share of 1. Very long texts are scored whole, a slice of their own each. Columns
beside doc_id and text are not read by ``score`` and pass by in ``keep_good``,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparse import Bound, Rows, fitted, sums, training_sample
from .text import Words, map_arrow, mix

#: Rows that the fit may see; a documented bound of the fit alone.
FIT_ROWS = 2000
BITS = 17
DIM = 12


def _spot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word and word-pair features with the words' bounds; character features with the documents' byte bounds."""
    words = Words(column, lower=False)
    h = words.hashes()
    pair = np.zeros(len(h), np.uint64)
    if len(h):
        again = h[1:] == h[:-1]
        pair[1:] = np.where(again, np.uint64(1), mix(h[1:] + h[:-1] * np.uint64(0x9FB21C651E98DF25)))
    firsts = words.bounds[:-1][words.counts > 0]
    pair[firsts] = mix(h[firsts] + np.uint64(5)) if len(firsts) else pair[firsts]
    raw, n = words.bytes.astype(np.uint32), len(words.bytes)
    follow = [np.zeros(n, np.uint32) for _ in range(3)]
    for k, x in enumerate(follow, 1):
        x[: max(n - k, 0)] = raw[k:]
        ends = words.offsets[1:]
        for back in range(1, k + 1):
            x[np.maximum(ends[ends > 0] - back, 0)] = 0
    three = raw | follow[0] << np.uint32(8) | follow[1] << np.uint32(16)
    four = three | follow[2] << np.uint32(24)
    shift = np.uint32(32 - BITS)
    third = ((three + np.uint32(0x5BD1E995)) * np.uint32(0x9E3779B1)) >> shift
    fourth = ((four ^ (four >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> shift
    return _spot(mix(h)), _spot(mix(pair)), third.astype(np.int32), fourth.astype(np.int32), words.bounds, words.offsets


def features(column: pa.Array) -> Rows:
    one, two, third, fourth, bounds, offsets = hashed(column)
    n = len(offsets) - 1
    word_doc, byte_doc = np.repeat(np.arange(n), np.diff(bounds)), np.repeat(np.arange(n), np.diff(offsets))
    x = Rows.counted(np.concatenate([word_doc, word_doc, byte_doc, byte_doc]), np.concatenate([one, two, third, fourth]).astype(np.int64), n, 1 << BITS)
    total = 2 * np.diff(bounds) + 2 * np.diff(offsets)
    x.values = x.values / np.maximum(total, 1)[x.row]
    return x


class QualityModel:
    def __init__(self, texts: list[str], labels: list[int], epochs: int = 5, rate: float = 6.0, batch: int = 32, seed: int = 7):
        rng = np.random.default_rng(seed)
        y = np.array(labels, int)
        self.table, self.bias, self.prior = np.zeros(1 << BITS, np.float32), 0.0, float(y.mean()) if len(y) else 0.0
        if len(set(labels)) < 2:
            return
        x = Rows.in_slices(texts, features, 1 << BITS)
        emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
        out, bias = np.zeros((DIM, 2), np.float32), np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
        steps, done = epochs * -(-len(y) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                part = x.take(rows)
                used, place = np.unique(part.columns, return_inverse=True)
                dense = np.zeros((len(rows), len(used)), np.float32)
                dense[part.row, place] = part.values
                vectors = emb[used]
                mean = dense @ vectors
                z = mean @ out + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                now = rate * (1 - done / steps)
                grad = dense.T @ (p @ out.T)
                out -= np.float32(now) * (mean.T @ p)
                bias -= np.float32(0.1 * now) * p.sum(0)
                # rare features have tiny shares, so their vectors take steps scaled to the batch's mean share
                emb[used] -= np.float32(now * 100) * grad
                done += 1
        margin = emb @ (out[:, 1] - out[:, 0])
        self.table, self.bias = margin.astype(np.float32), float(bias[1] - bias[0])

    def score(self, column: pa.Array) -> np.ndarray:
        """Chance of label 1."""
        one, two, third, fourth, bounds, offsets = hashed(column)
        total = sums(self.table[one] + self.table[two], bounds) + sums(self.table[third] + self.table[fourth], offsets)
        n = 2 * np.diff(bounds) + 2 * np.diff(offsets)
        out = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -60, 60)))
        if not self.table.any():
            out[:] = self.prior
        return out


def fit(docs: DataFrame, labels: DataFrame, keep, label: str = "quality", limit: int | Bound = FIT_ROWS) -> QualityModel:
    return fitted(training_sample(docs, labels, label, keep, limit), lambda rows: QualityModel(rows.text.tolist(), rows[label].astype(int).tolist()))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS floats

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part["doc_id"], pa.array(shared.value.score(part["text"]))], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def _fold(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def grade_documents(docs: DataFrame, labels: DataFrame, bar: float = 0.3, folds: int = 5, held_out: int = 0, limit: int | Bound = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted): learn outside one fold, score every document."""
    out = score(docs, fit(docs, labels, _fold(folds) != held_out, limit=limit))
    held = F.coalesce(_fold(folds) == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= bar).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, bar: float = 0.3, folds: int = 5, held_out: int = 0, limit: int | Bound = FIT_ROWS) -> DataFrame:
    """The documents, with all their columns, that the classifier scores at ``bar`` or more."""
    model = fit(docs, labels, _fold(folds) != held_out, limit=limit)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array(shared.value.score(part["text"]) >= bar))

    return map_arrow(docs, run, docs.schema)
