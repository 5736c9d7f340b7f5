"""Language identification in two levels.

The first level predicts the language family with one linear support vector
machine per family against the rest. The second holds one machine for each pair
of languages of that family; each pair votes with its margin. Features are
shares of hashed byte 1- to 3-grams of letters within the text, so the score of
a text is one table lookup per byte and the whole text counts.

A null text, or one without a letter, gets ``und`` and score 0. A language code
without an entry in FAMILIES is a family of its own. Without training rows every
text gets ``und``. Rows that repeat a doc_id are predicted each; a null doc_id is
predicted and in no fold. Ties go to the first language in alphabetical order. An
empty table gives an empty result. Very long texts are predicted whole, a slice of
their own each. Columns beside doc_id, text and lang are not read, whatever their
names.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparse import Bound, Rows, fitted, sums, training_sample
from .text import _LOWER, buffer_of, map_arrow

#: Language families by code.
FAMILIES = {
    "de": "germanic", "en": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic",
}

#: Rows that the fit may see; a documented bound of the fit alone.
FIT_ROWS = 4000
BITS = 15
_LETTER = re.compile(r"[^\W\d_]")
_CLASS = np.full(256, 0, np.uint32)
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def grams(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed 1-, 2- and 3-grams that start at each byte, and the bounds of the documents.

    All that is not a letter counts as one kind of gap.
    """
    raw, offsets = buffer_of(column)
    sign = _LOWER[raw].astype(np.uint32) * _CLASS[raw]
    second, third = np.zeros_like(sign), np.zeros_like(sign)
    second[:-1], third[:-2] = sign[1:], sign[2:]
    ends = offsets[1:][np.diff(offsets) > 0]
    second[ends - 1] = 0
    third[ends - 1] = 0
    third[np.maximum(ends - 2, 0)] = 0
    shift = np.uint32(32 - BITS)
    out = []
    for salt, value in ((11, sign), (23, sign | second << np.uint32(8)), (37, sign | second << np.uint32(8) | third << np.uint32(16))):
        out.append(((value + np.uint32(salt * 0x01000193)) * np.uint32(0x9E3779B1)) >> shift)
    return out, offsets


def features(column: pa.Array) -> Rows:
    found, offsets = grams(column)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    x = Rows.counted(np.tile(doc, len(found)), np.concatenate(found).astype(np.int64), len(offsets) - 1, 1 << BITS)
    x.values = x.values / np.maximum(np.diff(offsets), 1)[x.row]
    return x


def train_svm(x: Rows, sign: np.ndarray, scale: np.ndarray, l2: float = 1e-3, steps: int = 80) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient descent; classes weigh the same."""
    weight = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1))
    z = Rows(x.indptr, x.columns, x.values * scale[x.columns], x.width)
    norm = np.bincount(z.row, weights=z.values**2, minlength=len(z))
    rate = 1 / (2 * (float((weight * (norm + 1)).sum()) + l2))
    w = ahead = np.zeros(x.width + 1)
    for step in range(steps):
        loss = np.maximum(0, 1 - sign * (z.dot(ahead[:-1]) + ahead[-1])) * sign * weight * 2
        grad = np.append(-z.back(loss), -loss.sum()) + l2 * np.append(ahead[:-1], 0)
        new = ahead - rate * grad
        ahead, w = new + step / (step + 3) * (new - w), new
    return w[:-1] * scale, float(w[-1])


class LanguageModel:
    """Family machines and, inside each family, one machine per pair of languages."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        family = [FAMILIES.get(x, x) for x in langs]
        self.families = {f: sorted({x for x, g in zip(langs, family, strict=True) if g == f}) for f in sorted(set(family))}
        x = Rows.in_slices(texts, features, 1 << BITS) if texts else None
        machines, self.bias = [], []
        self.columns: list[tuple] = []
        if x is not None:
            mean = np.bincount(x.columns, weights=x.values, minlength=x.width) / max(len(x), 1)
            scale = 1 / np.sqrt(mean + 1e-4)
            tasks = [(("family", f), np.arange(len(x)), np.array([1.0 if g == f else -1.0 for g in family])) for f in self.families if len(self.families) > 1]
            for f, members in self.families.items():
                for a, b in combinations(members, 2):
                    rows = np.array([i for i, v in enumerate(langs) if v in (a, b)])
                    tasks.append(((f, a, b), rows, np.array([1.0 if langs[i] == a else -1.0 for i in rows])))
            for name, rows, sign in tasks:
                w, b = train_svm(x.take(rows), sign, scale)
                self.columns.append(name)
                machines.append(w.astype(np.float32))
                self.bias.append(b)
        self.weights = np.stack(machines) if machines else np.zeros((0, 1 << BITS), np.float32)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        found, offsets = grams(column)
        size = np.maximum(np.diff(offsets), 1)
        margins = {}
        for name, w, b in zip(self.columns, self.weights, self.bias, strict=True):
            total = w[found[0]]
            for g in found[1:]:
                total = total + w[g]
            margins[name] = sums(total, offsets) / size + b
        n = len(offsets) - 1
        chance = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -60, 60)))
        kinds = list(self.families)
        if len(kinds) > 1:
            table = np.stack([margins["family", f] for f in kinds])
            pick, sure = table.argmax(0), chance(table).max(0)
        else:
            pick, sure = np.zeros(n, int), np.ones(n)
        lang, score = np.full(n, "und", object), np.zeros(n)
        for k, f in enumerate(kinds):
            rows, members = np.flatnonzero(pick == k), self.families[f]
            votes = np.zeros((len(members), len(rows)))
            least = np.ones((len(members), len(rows)))
            for i, j in combinations(range(len(members)), 2):
                m = margins[f, members[i], members[j]][rows]
                for at, v in ((i, m), (j, -m)):
                    votes[at] += (v > 0) + 1e-3 * np.tanh(v)
                    least[at] = np.minimum(least[at], chance(v))
            best = votes.argmax(0) if len(rows) else np.zeros(0, int)
            lang[rows] = np.array(members, object)[best]
            score[rows] = sure[rows] * least[best, np.arange(len(rows))]
        for i, text in enumerate(column.to_pylist()):
            if not self.langs or not text or not _LETTER.search(text):
                lang[i], score[i] = "und", 0.0
        return lang.tolist(), score


def fit(docs: DataFrame, keep, limit: int | Bound = FIT_ROWS) -> LanguageModel:
    return fitted(training_sample(docs, docs.select("doc_id", "lang"), "lang", keep, limit), lambda rows: LanguageModel(rows.text.tolist(), rows.lang.tolist()))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB at most: machines x 2^BITS floats

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = shared.value.predict(part["text"])
        return pa.RecordBatch.from_arrays([part["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, limit: int | Bound = FIT_ROWS, folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from the other folds, predict every document."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    out = predict(docs, fit(docs, fold != held_out, limit))
    return out.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
