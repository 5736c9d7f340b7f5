"""Small sparse-matrix kernels and the bounded training sample of the classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored


class Rows:
    """Sparse rows: ``indptr`` bounds each row's ``columns`` and ``values``."""

    def __init__(self, indptr: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.indptr, self.columns, self.values, self.width = indptr, columns, values, width
        self.row = np.repeat(np.arange(len(indptr) - 1, dtype=np.int32), np.diff(indptr))

    def __len__(self) -> int:
        return len(self.indptr) - 1

    @classmethod
    def counted(cls, row: np.ndarray, column: np.ndarray, n_rows: int, width: int) -> Rows:
        """Occurrence counts of (row, column)."""
        keys, counts = np.unique(row.astype(np.int64) * width + column, return_counts=True)
        return cls(np.searchsorted(keys // width, np.arange(n_rows + 1)), keys % width, counts.astype(float), width)

    @classmethod
    def in_slices(cls, texts: list[str], features, width: int, limit: int = 1 << 18) -> Rows:
        """Rows of ``features(column)`` over runs of texts of bounded size, so that working memory is bounded too."""
        parts, start, total = [], 0, 0
        for i, text in enumerate([*texts, None]):
            size = limit if text is None else len(text)
            if i > start and total + size > limit:
                rows = features(pa.array(texts[start:i], pa.large_string()))
                parts.append(cls(rows.indptr, rows.columns.astype(np.int32), rows.values.astype(np.float32), width))
                start, total = i, 0
            total += size
        sizes = np.concatenate([np.zeros(1, np.int64), *(np.diff(x.indptr) for x in parts)])
        columns = np.concatenate([np.zeros(0, np.int32), *(x.columns for x in parts)])
        return cls(np.cumsum(sizes), columns, np.concatenate([np.zeros(0, np.float32), *(x.values for x in parts)]), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.values * w[self.columns], minlength=len(self))

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=self.values * g[self.row], minlength=self.width)

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.indptr)[rows]
        ends = np.cumsum(sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(self.indptr[rows] - (ends - sizes), sizes)
        return Rows(np.concatenate([[0], ends]), self.columns[at], self.values[at], self.width)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring bounds."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Bound(NamedTuple):
    """The bounded sample of labelled rows that a fit may see; it bounds the fit alone, every row is scored.

    ``rows``: labelled rows at most. ``text_bytes``: bytes of their texts together at
    most. ``doc_bytes``: a labelled row with a longer text is not drawn; it is scored
    like all others. A plain number of rows stands for a bound with the other two at
    their defaults.
    """

    rows: int
    text_bytes: int = 12 << 20
    doc_bytes: int = 256 << 10

    @classmethod
    def of(cls, limit: int | Bound) -> Bound:
        return limit if isinstance(limit, Bound) else cls(limit)


_DRAWS = 1 << 40


def draw(key: Column, salt: int) -> Column:
    """A number below 2^40 that the key alone decides."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(_DRAWS))


def bounded(rows: DataFrame, limit: int | Bound, max_bytes: int | None = None) -> DataFrame:
    """The rows (draw, text, ...) with the smallest ``draw`` within the bound; ``max_bytes`` stands for its ``text_bytes``.

    The rows are written once; the driver sees a draw and a size of each, not a text.
    """
    bound = Bound.of(limit)
    bound = bound if max_bytes is None else bound._replace(text_bytes=max_bytes)
    rows = stored(rows.where(F.octet_length("text") <= bound.doc_bytes), "sample")
    sizes = rows.select("draw", F.octet_length("text").alias("size")).toPandas().sort_values("draw").iloc[: bound.rows]
    fits = sizes[sizes["size"].cumsum() <= bound.text_bytes]
    return rows.where(F.col("draw") <= (int(fits.draw.iloc[-1]) if len(fits) else -1))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int | Bound) -> DataFrame:
    """Labelled rows (draw, doc_id, text, label) within the bound ``limit``, chosen by a hash of doc_id.

    The bounds are parameters of the fit only; every document is scored. Null labels
    and null texts are left out. A repeated doc_id counts once, with its smallest text
    and label, before anything is gathered.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.min(label).alias(label))
    bar = int(min(1.0, Bound.of(limit).rows / max(known.count(), 1)) * _DRAWS)
    drawn = lambda d: d.where(draw(F.col("doc_id"), 17) <= bar)
    texts = drawn(docs.select("doc_id", "text")).where("text is not null").join(drawn(known).select("doc_id"), "doc_id", "left_semi")
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(drawn(known), "doc_id")
    return bounded(one.withColumn("draw", draw(F.col("doc_id"), 17)), limit)


def fitted(rows: DataFrame, fit: Callable[[pd.DataFrame], object]):
    """``fit`` on all rows, which are bounded, in one task; only the model comes to the driver."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.to_pandas() for b in batches]
        frame = pd.concat(held, ignore_index=True) if held else pd.DataFrame(columns=names)
        model = pickle.dumps(fit(frame.sort_values("draw", kind="stable").reset_index(drop=True)))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit(pd.DataFrame(columns=names))
