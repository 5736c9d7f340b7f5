"""Bigram language model by deleted interpolation.

Tokens are words without ASCII white space, A-Z in lower case, and one end per
document. The probability of a token after its predecessor mixes the maximum
likelihood estimate of the pair with a smoothed unigram, (c + 0.1) / (N + 0.1
(V + 1)). The weight of the pair depends on the bucket of the predecessor's
frequency (powers of two; 0 for unseen). The weights come from
expectation-maximisation on counts that are held out: pairs of one part of the
training documents under estimates from the others. The final counts use all
training documents.

Plan. Words and pairs are 64-bit hashes. Each task cuts its documents into
blocks, numbers a block's distinct words, and writes the block's token stream in
those numbers. From the streams each block's sorted keys of words and pairs go
out with their counts, dealt by hash range.
The ranges are summed over all blocks, and each block gets back the corpus counts
of its own keys only. So corpus counts of any size are used without a broadcast,
and no task holds more than a block or one range.

A null or empty text is one end token. A null doc_id is in no fold but scored and
never learned from. With no training document every count is 0. Rows that repeat
a doc_id are learned from and scored each. An empty table gives an empty result. A
very long text is a block of its own. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import even_labels, partitions, stored
from .text import Words, mix, slices

#: Text bytes of a block, about.
BLOCK_BYTES = 8 << 20
#: Tokens whose keys meet in one hash range, on average at most.
RANGE_TOKENS = 4 << 20
ADD = 0.1
BUCKETS = 24
#: Bins of log2(pair estimate / unigram estimate) for the weights' fit: 32 a unit, -24 to 40.
BINS, BIN_STEP, BIN_LOW = 2048, 32, -24.0

_END = np.uint64(0x1F83D9ABFB41BD6B)
_START = np.uint64(0x5BE0CD19137E2179)
_PAIR = np.uint64(0x9FB21C651E98DF25)

#: What a document is for: scored only, learned from, or learned from and held out while the weights are fitted.
SCORED, LEARNED, TUNED = 0, 1, 2


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unzip(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart."""
    step = np.diff(keys, prepend=np.uint64(0))
    return _zip(step.view(np.uint8).reshape(-1, 8).T)


def _planes(x: np.ndarray) -> bytes:
    """32-bit integers with their byte planes apart."""
    return _zip(x.view(np.uint8).reshape(-1, 4).T)


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unzip(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _unpack_keys(raw: bytes) -> np.ndarray:
    planes = _unzip(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


class _Block:
    """Documents gathered until they fill a block."""

    def __init__(self):
        self.docs: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, part: pa.RecordBatch) -> None:
        words = Words(part["text"])
        counts = words.counts
        ends = np.cumsum(counts + 1) - 1
        h = np.empty(len(words) + len(counts), np.uint64)
        inner = np.ones(len(h), bool)
        inner[ends] = False
        h[inner], h[ends] = words.hashes(), _END
        self.hashes.append(h)
        self.sizes.append(counts + 1)
        self.docs.append(np.stack([np.array(part["doc_id"].fill_null(0).to_numpy()), part["doc_id"].is_valid().to_numpy(zero_copy_only=False), part["use"].to_numpy()]))
        self.bytes += len(words.bytes)


def _pairs_of(number: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """A code of (predecessor, token) for each token of the stream; number ``words`` stands for the start."""
    before = np.empty(len(number), np.int64)
    before[1:] = number[:-1]
    before[np.cumsum(sizes) - sizes] = words
    return before * (words + 1) + number


class _Numbered:
    """Keys of a block's distinct words and pairs, in ascending order, from its words and token stream."""

    def __init__(self, words: np.ndarray, number: np.ndarray, sizes: np.ndarray):
        self.number, n = number, len(words)
        pairs, self.pair = np.unique(_pairs_of(number, sizes, n), return_inverse=True)
        ends = np.append(words, _START)
        two = mix(ends[pairs // (n + 1)] * _PAIR + ends[pairs % (n + 1)]) | np.uint64(1)
        keys = np.concatenate([ends & ~np.uint64(1), two])
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.words = keys[self.order], n
        self.before = pairs // (n + 1)

    def count(self, chosen: np.ndarray, starts: int) -> np.ndarray:
        """Counts of the keys over the chosen tokens; ``starts`` documents begin among them."""
        one = np.bincount(self.number[chosen], minlength=self.words)
        two = np.bincount(self.pair[chosen], minlength=len(self.before))
        return np.concatenate([one, [starts], two])[self.order].astype(np.int32)

    def spread(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: corpus counts of itself, of its predecessor, and of the pair."""
        by = np.empty(len(total), np.int64)
        by[self.order] = total
        one, two = by[: self.words + 1], by[self.words + 1 :]
        return one[self.number], one[self.before[self.pair]], two[self.pair]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token streams of blocks: documents (id, valid, use, tokens), word hashes, and each token's place among them."""

    def close(block: _Block, name: int) -> pa.RecordBatch:
        docs = np.concatenate([np.concatenate(block.docs, axis=1), np.concatenate(block.sizes)[None]])
        words, number = np.unique(np.concatenate(block.hashes), return_inverse=True)
        block.hashes.clear()
        row = (name, len(number), _zip(docs), _planes(number.astype(np.uint32)), _pack_keys(words))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "tokens", "docs", "stream", "words"])

    task, n = TaskContext.get().partitionId(), 0
    # tuned documents have blocks of their own, so that the weights' fit reads no other block
    held = {False: _Block(), True: _Block()}
    for batch in batches:
        for part in slices(batch):
            tuned = part["use"].to_numpy() == TUNED
            for kind in (False, True):
                own = part.filter(pa.array(tuned == kind))
                if own.num_rows:
                    held[kind].add(own)
                    if held[kind].bytes >= BLOCK_BYTES:
                        yield close(held[kind], ((task << 24) + n) * 2 + kind)
                        held[kind], n = _Block(), n + 1
    for kind, block in held.items():
        if block.docs:
            yield close(block, ((task << 24) + n) * 2 + kind)
            n += 1


def _numbered(docs: bytes, stream: bytes, words: bytes) -> tuple[np.ndarray, _Numbered]:
    table = _unzip(docs, np.int64).reshape(4, -1)
    return table, _Numbered(_unpack_keys(words), _unplanes(stream).astype(np.int64), table[3])


def _keys(labels: list[int]):
    """Keys and counts of each stored block by hash range; labels name the ranges for the shuffle. Keys of words are even, of pairs odd; counts are (learned, learned but not tuned)."""
    buckets = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs, stream, words in zip(*(batch[c].to_pylist() for c in ("block", "docs", "stream", "words")), strict=True):
                (_, _, use_of, sizes), k = _numbered(docs, stream, words)
                use = np.repeat(use_of, sizes)
                counts = np.stack([k.count(use >= LEARNED, (use_of >= LEARNED).sum()), k.count(use == LEARNED, (use_of == LEARNED).sum())])
                place = (k.keys >> np.uint64(32)).astype(np.int64) * buckets >> 32
                edges = np.searchsorted(place, np.arange(buckets + 1))
                rows = [(block, b, labels[b], _pack_keys(k.keys[x:y]), _zip(counts[:, x:y])) for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "bucket", "label", "keys", "counts"])

    return run


def _sum_range(table: pa.Table) -> pa.Table:
    """Corpus counts of one hash range, for each block in the order of its own keys; and the range's totals."""
    keys = [_unpack_keys(x) for x in table["keys"].to_pylist()]
    counts = [_unzip(x, np.int32).reshape(2, -1) for x in table["counts"].to_pylist()]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.stack([np.bincount(place, weights=np.concatenate([c[i] for c in counts]), minlength=len(every)).astype(np.int64) for i in (0, 1)])
    words = (every & np.uint64(1) == 0) & (every != _START & ~np.uint64(1))
    edges = np.cumsum([0, *map(len, keys)])
    # only the blocks of tuned documents, which are odd, need the second kind of count
    back = [_zip(total[: 1 + block % 2, place[a:b]]) for block, a, b in zip(table["block"].to_pylist(), edges, edges[1:], strict=False)]
    out = {"block": table["block"], "bucket": table["bucket"], "counts": pa.array(back, pa.binary())}
    for name, i, kind in (("n_all", 0, "sum"), ("v_all", 0, "any"), ("n_kept", 1, "sum"), ("v_kept", 1, "any")):
        own = total[i][words]
        out[name] = pa.array([int(own.sum() if kind == "sum" else (own > 0).sum())] + [0] * (len(keys) - 1), pa.int64())
    return pa.table(out)


def _opened(stream: pa.Table, ranges: pa.Table, which: int):
    """Documents, their token bounds, and the corpus counts of each token, its predecessor and the pair."""
    (ids, valid, use, sizes), k = _numbered(*(stream[c][0].as_py() for c in ("docs", "stream", "words")))
    blobs, order = ranges["counts"].to_pylist(), np.argsort(ranges["bucket"].to_numpy(), kind="stable")
    kinds = 1 + stream["block"][0].as_py() % 2
    total = np.concatenate([_unzip(blobs[i], np.int64).reshape(kinds, -1)[which] for i in order])
    return ids, valid, use, sizes, k.spread(total)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def _estimates(c: np.ndarray, context: np.ndarray, pair: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    return (c + ADD) / (n + ADD * (v + 1)), pair / np.maximum(context, 1)


def _tune(n: int, v: int):
    def run(stream: pa.Table, ranges: pa.Table) -> pa.Table:
        if not stream.num_rows or not ranges.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "bin": pa.array([], pa.int32()), "tokens": pa.array([], pa.int64())})
        *_, (c, context, pair) = _opened(stream, ranges, 1)
        base, own = _estimates(c, context, pair, n, v)
        with np.errstate(divide="ignore"):
            bins = np.clip((np.log2(own / base) - BIN_LOW) * BIN_STEP, 0, BINS - 1)
        at, tokens = np.unique(_bucket(context) * BINS + np.where(own > 0, bins, 0).astype(np.int64), return_counts=True)
        return pa.table({"bucket": pa.array(at // BINS, pa.int32()), "bin": pa.array(at % BINS, pa.int32()), "tokens": pa.array(tokens, pa.int64())})

    return run


def maximise(ratios: np.ndarray, tokens: np.ndarray, steps: int = 100) -> float:
    """Weight of the pair estimate that maximises the held-out likelihood, given its ratios to the base."""
    weight = 0.5
    for _ in range(steps):
        share = weight * ratios / (weight * ratios + 1 - weight)
        new = float((share * tokens).sum() / tokens.sum())
        if abs(new - weight) < 1e-9:
            break
        weight = new
    return min(weight, 1 - 1e-6)  # an unseen pair keeps some chance


def _weights(histogram: list, buckets: int = BUCKETS) -> np.ndarray:
    """One weight per bucket; a bucket without held-out tokens takes its lower neighbour's."""
    out = np.zeros(buckets)
    for b in range(1, buckets):
        own = [(r["bin"], r["tokens"]) for r in histogram if r["bucket"] == b]
        if own:
            bins, tokens = np.array(own, float).T
            out[b] = maximise(np.where(bins > 0, 2 ** ((bins + 0.5) / BIN_STEP + BIN_LOW), 0), tokens)
        else:
            out[b] = out[b - 1]
    return out


def _score(n: int, v: int, weights: np.ndarray):
    def run(stream: pa.Table, ranges: pa.Table) -> pa.Table:
        ids, valid, use, sizes, (c, context, pair) = _opened(stream, ranges, 0)
        base, own = _estimates(c, context, pair, n, v)
        if not n:  # nothing learned: every token has the chance of an unseen one
            base = np.full(len(c), 1.0)
        w = weights[_bucket(context)]
        at = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, at)  # noqa: E731  every document has its end token
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=valid == 0), "held_out": pa.array((use == SCORED) & (valid == 1)), "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(add((c > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(sizes), n), pa.int64()),
                "base_score": pa.array(add(np.log10(base))), "score": pa.array(add(np.log10(w * own + (1 - w) * base))),
            }
        )

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, folds: int = 10, held_out: int = 0, tuned: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    use = F.coalesce(F.when(fold == held_out, SCORED).when(fold == tuned, TUNED).when(fold.isNotNull(), LEARNED), F.lit(SCORED))
    made = docs.select("doc_id", "text", use.cast("int").alias("use"))
    streams = stored(made.mapInArrow(_blocks, "block long, tokens long, docs binary, stream binary, words binary"), "tokens")
    # a range holds no more than RANGE_TOKENS tokens' keys on average, whatever the session's number of partitions
    copies = -(-(streams.agg(F.sum("tokens")).first()[0] or 0) // (RANGE_TOKENS * partitions(spark))) or 1
    keys = streams.mapInArrow(_keys(even_labels(spark, copies)), "block long, bucket int, label int, keys binary, counts binary")
    ranges = stored(keys.groupBy("label").applyInArrow(_sum_range, "block long, bucket int, counts binary, n_all long, v_all long, n_kept long, v_kept long"), "ranges")
    n_all, v_all, n_kept, v_kept = (int(x or 0) for x in ranges.agg(*[F.sum(c) for c in ("n_all", "v_all", "n_kept", "v_kept")]).first())
    back = ranges.select(F.col("block").alias("of"), "bucket", "counts")
    meet = lambda s, r: s.groupBy("block").cogroup(r.groupBy("of"))
    tuned_rows = meet(streams.where("block % 2 = 1"), back.where("of % 2 = 1")).applyInArrow(_tune(n_kept, v_kept), "bucket int, bin int, tokens long") if n_kept else None
    histogram = tuned_rows.groupBy("bucket", "bin").agg(F.sum("tokens").alias("tokens")).collect() if n_kept else []  # at most BUCKETS x BINS rows
    return meet(streams, back).applyInArrow(_score(n_all, v_all, _weights(histogram)), SCORES)
