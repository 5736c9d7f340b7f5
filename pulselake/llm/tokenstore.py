"""Token ids in a compressed store with random access to single documents.

Format: a folder with two Parquet tables, so that it works on any store that
Spark writes to and a failed write leaves no half file behind.

* ``dictionary``: one row, the zstandard dictionary trained on serialized id
  arrays of a bounded sample, and its SHA-256.
* ``segments``: rows in ascending (shard, segment) order. A row holds a run of
  documents in ascending doc_id order: ``payload`` is the concatenation of one
  zstandard frame per document, compressed separately with the shared
  dictionary; ``offsets`` says where each frame starts and the last ends;
  ``doc_ids`` and ``counts`` (ids with the end id) go with it, ``dictionary_hash``
  names the dictionary, ``start`` is the number of ids before the segment in its
  shard, ``first_id`` and ``last_id`` bound its doc_ids for look-ups.

A frame holds the ids as little-endian unsigned 32-bit integers. One document is
read by its offsets alone, without the rest of the payload's frames.

Null texts count as empty: the end id alone. Rows with a null doc_id come first.
Rows that repeat a doc_id are stored each, in the order of a hash of their
frames. An empty table gives a store without segments. A very long text is a frame
and, over SEGMENT_BYTES, a segment of its own. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import mark, new_path, partitions, release, stored
from .sparse import bounded, draw, fitted
from .text import slices

#: Documents whose ids train the dictionary, and the dictionary's largest size.
SAMPLE_DOCS = 2000
DICTIONARY_BYTES = 64 << 10
LEVEL = 1
#: Chunks up to this length stay when a full cache is emptied; short words are the frequent ones.
KEPT_LENGTH = 6
#: Documents and payload bytes in a segment, at most (one document may be larger).
SEGMENT_DOCS = 512
SEGMENT_BYTES = 4 << 20
#: Chunks of text kept with their ids in one Python worker, and the longest such chunk.
CACHE_CHUNKS = 900_000
CACHE_LENGTH = 64

#: Size of a Parquet row group of segments, the unit that a look-up reads.
ROW_GROUP_BYTES = 8 << 20

SEGMENTS = "shard int, segment int, start long, total long, first_id long, last_id long, dictionary_hash string, doc_ids array<long>, counts array<int>, offsets array<long>, payload binary"


class _Chunks(dict):
    """Ids by chunk; ``learn`` makes those of an unknown one, and short chunks stay."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        found = self.learn(chunk)
        if len(chunk) <= CACHE_LENGTH:
            self[chunk] = found
        return found

    def trim(self, limit: int) -> None:
        if len(self) > limit:
            kept = [(k, v) for k, v in self.items() if len(k) <= KEPT_LENGTH]
            self.clear()
            self.update(kept)


class ByteEncoder:
    """The library's byte-level encoder behind a cache of chunks.

    The tokenizer never joins a single space to what stands before it, so a text
    may be cut before a space between two characters that are not white space.
    """

    _IRREGULAR = re.compile(r" \s|\s ")
    _OTHER = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
    #: A run of letters, and what may follow it from another ASCII character on: no token spans that border.
    _WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([^A-Za-z\x80-\U0010ffff].*)?", re.S)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._tokenize = self._library.model.tokenize
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._four = [struct.pack("<I", i) for i in range(self._library.get_vocab_size() + 1)]
        #: the model's symbol of each byte of the letters that _WORD takes
        self._symbol = {}
        for letter in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]):
            self._symbol.update(zip(letter.encode(), self._library.pre_tokenizer.pre_tokenize_str(letter)[0][0], strict=True))
        #: ids of a chunk with a space before it, by the chunk
        self._spaced = _Chunks(self._learn)
        #: ids of what follows a word without a space, by that rest
        self._rests = _Chunks(lambda rest: self._ids([rest])[0])

    def _ids(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._library.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        self._spaced.trim(CACHE_CHUNKS)
        self._rests.trim(CACHE_CHUNKS // 4)
        spaced = self._spaced.__getitem__
        heads, tails = [], []
        for text in texts:
            pieces = [text] if any(s in text for s in self._special) else text.split(" ")
            if len(pieces) > 1 and not self._regular(text):
                pieces = self._joined(pieces)
            heads.append(pieces[0])
            tails.append(b"".join(map(spaced, pieces[1:])))
        return [head + tail for head, tail in zip(self._ids(heads), tails, strict=True)]

    def _learn(self, chunk: str) -> bytes:
        """Ids of a space and the chunk; one in two parts needs only the parts that are new."""
        if chunk.isascii() and chunk.isalpha():
            return self._one("Ġ" + chunk)
        parts = self._WORD.fullmatch(chunk)
        if not parts:
            return self._ids([" " + chunk])[0]
        letters, rest = parts.groups()
        if rest:
            return self._spaced[letters] + self._rests[rest]
        return self._one("Ġ" + chunk.encode().decode("latin-1").translate(self._symbol))

    def _one(self, symbols: str) -> bytes:
        """Ids of one pre-token, straight from the library's model."""
        four = self._four
        return b"".join([four[x.id] for x in self._tokenize(symbols)])

    def _regular(self, text: str) -> bool:
        """Whether no space stands beside white space; the common case is told by substring searches alone."""
        if text.isascii() and not any(x in text for x in self._OTHER):
            return not ("  " in text or " \n" in text or "\n " in text)
        return not self._IRREGULAR.search(text)

    @staticmethod
    def _joined(pieces: list[str]) -> list[str]:
        """The pieces of a text with runs of white space, joined again wherever the cut is beside white space."""
        out = [[pieces[0]]]
        for before, piece in zip(pieces, pieces[1:], strict=False):
            if piece and before and not piece[0].isspace() and not before[-1].isspace():
                out.append([piece])
            else:
                out[-1].append(piece)
        return [" ".join(x) for x in out]


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int) -> bytes:
    """A dictionary trained, in one task, on the serialized ids of at most SAMPLE_DOCS different texts (``sparse.Bound``).

    Samples too few or too alike to train on are the dictionary themselves, as raw
    content, its end first to be matched; without a text it is the end id.
    """
    texts = docs.select("text").where("text is not null").withColumn("draw", draw(F.col("text"), 29))
    n = texts.agg(F.approx_count_distinct("draw")).first()[0]
    drawn = texts.where(F.col("draw") <= int(min(1.0, SAMPLE_DOCS / max(n, 1)) * (1 << 40)))

    def fit(rows: pd.DataFrame) -> bytes:
        last = struct.pack("<I", end_id)
        samples = [x + last for x in encoder(vocabulary).encode(rows.text.tolist())] if len(rows) else []
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            return (b"".join(samples) or last * 2)[-DICTIONARY_BYTES:]

    return fitted(bounded(drawn.groupBy("draw").agg(F.min("text").alias("text")), SAMPLE_DOCS), fit)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encode every document and write the store in ascending doc_id order."""
    spark, since = docs.sparkSession, mark()
    dictionary = train_dictionary(docs, vocabulary, end_id)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value), write_content_size=True)
        last = struct.pack("<I", end_id)
        for batch in batches:
            for part in slices(batch):
                ids = [x + last for x in e.encode(pc.fill_null(part["text"], "").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int32()), pa.array([packer.compress(x) for x in ids], pa.binary())],
                    ["doc_id", "n", "frame"],
                )

    frames = stored(docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n int, frame binary"), "frames")
    # the range partitioner samples these keys to the driver, so a frame enters by its hash; the row's own number parts equal ones
    keyed = frames.withColumn("hash", F.xxhash64("frame")).withColumn("own", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(partitions(spark), "doc_id", "hash", "own").sortWithinPartitions("doc_id", "hash", "own")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId(), []
        size = before = segment = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, before, segment
            docs, counts = [x[0] for x in held], [x[1] for x in held]
            offsets = np.cumsum([0, *(len(x[2]) for x in held)]).tolist()
            row = {
                "shard": [shard], "segment": [segment], "start": [before], "total": [sum(counts)], "first_id": [docs[0]], "last_id": [docs[-1]], "dictionary_hash": [name],
                "doc_ids": [docs], "counts": [counts], "offsets": [offsets], "payload": [b"".join(x[2] for x in held)],
            }
            before, segment, held, size = before + sum(counts), segment + 1, [], 0
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "frame")), strict=True):
                # a segment of null doc_ids holds no others, so that the ids bound the rest
                if held and (len(held) >= SEGMENT_DOCS or size + len(row[2]) > SEGMENT_BYTES or (row[0] is None) != (held[0][0] is None)):
                    yield flush()
                held.append(row)
                size += len(row[2])
        if held:
            yield flush()

    ordered.select("doc_id", "n", "frame").mapInArrow(pack, SEGMENTS).write.option("compression", "none").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/segments")
    release(since)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, before): ids in all earlier shards, from the segment headers; a row per shard."""
    per_shard = spark.read.parquet(f"{path}/segments").groupBy("shard").agg(F.sum("total").alias("total")).orderBy("shard").collect()
    rows, before = [], 0
    for shard, total in per_shard:  # one row per written file, not per document
        rows.append((shard, before))
        before += total
    return spark.createDataFrame(rows, "shard int, before long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, dictionary_hash) of every stored document, from the files."""
    dictionary = spark.read.parquet(f"{path}/dictionary").first()
    shared = spark.sparkContext.broadcast((dictionary["hash"], bytes(dictionary["dictionary"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, raw = shared.value
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        for batch in batches:
            for shard, start, found, docs, counts, offsets, payload in zip(*(batch[c].to_pylist() for c in ("shard", "start", "dictionary_hash", "doc_ids", "counts", "offsets", "payload")), strict=True):
                if found != name:
                    raise ValueError(f"segment was written with dictionary {found}, not {name}")
                view = memoryview(payload)
                sums = [zlib.crc32(reader.decompress(view[a:b])) for a, b in zip(offsets, offsets[1:], strict=False)]
                first = np.cumsum([start, *counts[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(first), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    ["shard", "doc_id", "first", "n_tokens", "ids_crc32"],
                )

    rows = spark.read.parquet(f"{path}/segments").mapInArrow(run, "shard int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(starts(spark, path)), "shard").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Ids of one document (one array per stored row), by its offsets; only row groups whose ids reach it are read."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    at = F.explode(F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.get("doc_ids", i) == doc_id))
    cut = spark.read.parquet(f"{path}/segments").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).withColumn("i", at)
    begin, end = F.get("offsets", F.col("i")), F.get("offsets", F.col("i") + 1)
    frames = cut.select(F.substring("payload", (begin + 1).cast("int"), (end - begin).cast("int")).alias("frame")).collect()
    return [np.frombuffer(reader.decompress(bytes(r[0])), "<u4") for r in frames]


def store_and_read(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the documents to a store in the shared folder and read its digests back."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, vocabulary, end_id)
    return read(docs.sparkSession, path)
