"""Toxicity as an ordinal regression with cumulative links.

P(grade <= k | x) = logistic(cut_k - w.x) with one weight vector for all ordered
cuts, on the presence of the words and word beginnings that tell the grades apart in
the training rows. The result is the expected severity, sum over k of P(grade > k), in units
of grades, and the grade whose cut it passes.

A null or empty text, and one without a chosen word, has the severity of the
cuts alone. With fewer than two grades in training every text has the lowest.
Rows that repeat a doc_id are graded each; a null doc_id is graded and in no
fold. An empty table gives an empty result. Very long texts are graded whole, a
slice of their own each. Columns beside doc_id and text are not read, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparse import Bound, Rows, fitted, training_sample
from .text import Words, map_arrow

#: Rows that the fit may see; a documented bound of the fit alone.
FIT_ROWS = 6000
#: Words kept as features: the strongest, all with this |z| at least.
FEATURES = 2000
LEAST_Z = 4.0
#: Training documents that must hold a word.
LEAST_DOCS = 5
#: Lengths in bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)

_GAP = np.ones(256, bool)
_GAP[97:123] = _GAP[65:91] = _GAP[128:] = False


def _words(column: pa.Array) -> Words:
    return Words(column, gaps=_GAP)


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the whole words and of their first bytes, which catch inflected forms."""
    total, doc = words.prefix(), words.document
    docs, hashes = [doc], [words.hashes(total=total)]
    for size in PREFIXES:
        long = words.ends - words.starts > size
        docs.append(doc[long])
        hashes.append(words.hashes(words.starts[long], words.starts[long] + size, total) ^ np.uint64(size))
    return np.concatenate(docs), np.concatenate(hashes)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class SeverityModel:
    def __init__(self, texts: list[str], grades: list[int]):
        self.grades = sorted(set(grades))
        self.keys, self.w, self.cuts = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        if len(self.grades) < 2:
            return
        level = np.searchsorted(self.grades, grades)
        found = [np.unique(_features(_words(pa.array([t], pa.large_string())))[1]) for t in texts]
        doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
        keys, word = np.unique(np.concatenate(found), return_inverse=True)
        del found
        n, centred = np.bincount(word, minlength=len(keys)), level - level.mean()
        z = np.bincount(word, weights=centred[doc], minlength=len(keys)) / np.sqrt(np.maximum(n, 1) * max(level.var(), 1e-9))
        chosen = np.flatnonzero((np.abs(z) >= LEAST_Z) & (n >= LEAST_DOCS))
        chosen = np.sort(chosen[np.argsort(-np.abs(z[chosen]), kind="stable")[:FEATURES]])
        self.keys = keys[chosen]
        place = np.full(len(keys), -1)
        place[chosen] = np.arange(len(chosen))
        kept = place[word] >= 0
        self._fit(Rows.counted(doc[kept], place[word][kept], len(texts), max(len(chosen), 1)), level)

    def _fit(self, x: Rows, level: np.ndarray, l2: float = 1e-5, steps: int = 600) -> None:
        """Accelerated gradient descent; the cuts stay ordered as a first cut plus positive gaps."""
        k, n = len(self.grades) - 1, len(level)
        share = np.clip(np.cumsum(np.bincount(level, minlength=k + 1))[:-1] / n, 1e-3, 1 - 1e-3)
        cuts = np.log(share / (1 - share))
        theta = np.concatenate([np.zeros(x.width), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
        ahead, rate = theta, 2.0
        before = np.inf
        for step in range(steps):
            w, cut = ahead[: x.width], ahead[x.width] + np.concatenate([[0], np.cumsum(np.exp(ahead[x.width + 1 :]))])
            edge = np.concatenate([[-np.inf], cut, [np.inf]])
            score = x.dot(w)
            hi, lo = _logistic(edge[level + 1] - score), _logistic(edge[level] - score)
            p = np.maximum(hi - lo, 1e-12)
            loss = -np.log(p).mean() + l2 * (w @ w)
            if loss > before + 1e-9:  # restart the momentum with a shorter step
                ahead, rate, before = theta, rate / 2, np.inf
                continue
            before = loss
            d_hi, d_lo = -hi * (1 - hi) / p / n, lo * (1 - lo) / p / n
            d_cut = np.bincount(level, weights=d_hi, minlength=k + 1)[:k] + np.bincount(level, weights=d_lo, minlength=k + 1)[1:]
            later = np.cumsum(d_cut[::-1])[::-1]
            grad = np.concatenate([x.back(-(d_hi + d_lo)) + 2 * l2 * w, later[:1], later[1:] * np.exp(ahead[x.width + 1 :])])
            new = ahead - rate * grad
            ahead, theta = new + step / (step + 3) * (new - theta), new
        self.w = theta[: x.width]
        self.cuts = theta[x.width] + np.concatenate([[0], np.cumsum(np.exp(theta[x.width + 1 :]))])

    def severity(self, column: pa.Array) -> np.ndarray:
        """Expected severity of each text."""
        words = _words(column)
        score = np.zeros(len(column))
        if len(self.keys):
            doc, h = _features(words)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            pairs = np.unique(doc[hit] * len(self.keys) + at[hit])
            score = np.bincount(pairs // len(self.keys), weights=self.w[pairs % len(self.keys)], minlength=len(column))
        if len(self.grades) < 2:
            return np.full(len(column), float(self.grades[0]) if self.grades else 0.0)
        steps = np.diff(np.array(self.grades, float))
        return self.grades[0] + (_logistic(score[:, None] - self.cuts[None, :]) * steps).sum(1)


def score(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """(doc_id, severity, grade): expected severity and the nearest grade."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        severity = m.severity(part["text"])
        grades = np.array(m.grades or [0])
        grade = grades[np.abs(severity[:, None] - grades[None, :]).argmin(1)]
        return pa.RecordBatch.from_arrays([part["doc_id"], pa.array(severity), pa.array(grade, pa.int32())], ["doc_id", "severity", "grade"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, severity double, grade int")


def grade_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int | Bound = FIT_ROWS, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, severity, grade, toxic): learn from the labels outside one fold, grade every document."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    sample = training_sample(docs, labels, label, fold != held_out, limit)
    out = score(docs, fitted(sample, lambda rows: SeverityModel(rows.text.tolist(), rows[label].astype(int).tolist())))
    return out.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "severity", "grade", (F.col("severity") >= 0.5).cast("int").alias("toxic"))
