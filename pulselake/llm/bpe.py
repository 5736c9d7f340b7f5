"""BPE encoding and decoding with the word-end vocabulary.

Encoding finds, from an Aho-Corasick automaton over the vocabulary, the longest
token at each position and walks left to right. A token is accepted after its
predecessor only if the pair is compatible, meaning that no merge of lower rank
joins the two across their border; otherwise a shorter token, and at last the
predecessor itself, is tried again. A border found to be a dead end is never
tried twice, so the walk is linear, and its result is exactly what the merges
give. Decoding gathers token strings through one offset table.

A null or empty text has no ids and decodes to the empty string. Only doc_id (null or
not) and text are read; other columns, whatever their names, change nothing and are
not returned. Repeated rows are encoded each for itself, with equal results. An empty
table gives an empty result. A very long text is encoded whole by one task.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import map_arrow, ragged

#: Words kept with their ids in one Python worker, and the longest such word.
CACHE_WORDS = 400_000
CACHE_LENGTH = 64

_END = "</w>"
_MARK = 0xE000
#: White space as the tokenizer's patterns see it; str.split() differs at the four separators.
_GAPS = re.compile("[\t-\r \x85\xa0  -     　]+")
#: The tokenizer's own pattern, for lower-case ASCII.
_ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


class WordBpe:
    """Encoder and decoder of one vocabulary file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self._normalize = library.normalizer.normalize_str
        self._cut = library.pre_tokenizer.pre_tokenize_str
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

        self._rank: dict[int, int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        self._pair: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self._pair[left, right] = rank
            self._rank[whole], self._parts[whole] = rank, (left, right)
        self._size: dict[int, int] = {}
        keys = {}
        for token, i in vocab.items():
            if i in self._parts or len(token.removesuffix(_END)) == 1:
                key = self.marked(token.removesuffix(_END)) if token.endswith(_END) and token != _END else token
                keys[key] = i
                self._size[i] = len(key)
        self._shorter = {i: next((keys[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in keys), -1) for key, i in keys.items()}
        self._automaton = ahocorasick.Automaton()
        for key, i in keys.items():
            self._automaton.add_word(key, i)
        self._automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

        names = dict.fromkeys(range(max([*vocab.values(), *self.special.values()]) + 1), "")
        names |= {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = self._table([names[i] + " " for i in range(len(names))])
        self.numbers = self._table([f"{i} " for i in range(len(names))])

    @staticmethod
    def _table(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [s.encode() for s in strings]
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) for x in raw], out=offsets[1:])
        return np.frombuffer(b"".join(raw), np.uint8), offsets

    @staticmethod
    def marked(word: str) -> str:
        """The word with its last symbol turned into the word-end form of that symbol."""
        return word[:-1] + chr(_MARK + ord(word[-1]))

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the merges that build the two tokens."""
        known = self._fits.get((left, right))
        if known is not None:
            return known
        ok, a, above_a = True, left, 1 << 62
        while ok:
            b, above_b = right, 1 << 62
            while True:
                rank = self._pair.get((a, b))
                if rank is not None and rank < above_a and rank <= above_b:
                    ok = False
                    break
                if b not in self._parts:
                    break
                above_b, b = self._rank[b], self._parts[b][0]
            if a not in self._parts:
                break
            above_a, a = self._rank[a], self._parts[a][1]
        if len(self._fits) >= 1_000_000:
            self._fits.clear()
        self._fits[left, right] = ok
        return ok

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token given in byte-level symbols."""
        word, size = self.marked(piece), self._size
        longest = [-1] * len(word)
        for last, i in self._automaton.iter(word):
            longest[last - size[i] + 1] = i  # matches of one start come by growing end
        out: list[int] = []
        dead = bytearray(len(word) + 1)
        at, token, full, known = 0, longest[0], len(word), self._fits
        while at < full:
            while token >= 0:
                end = at + size[token]
                if not dead[end]:
                    if not out:
                        break
                    fit = known.get((out[-1], token))
                    if self.fits(out[-1], token) if fit is None else fit:
                        break
                token = self._shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < full else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def _piece(self, piece: str) -> bytes:
        raw = self._pieces.get(piece)
        if raw is None:
            ids = self.encode_piece(piece)
            raw = struct.pack(f"{len(ids)}I", *ids)
            if len(piece) <= CACHE_LENGTH:
                if len(self._pieces) >= CACHE_WORDS:
                    self._pieces.clear()
                self._pieces[piece] = raw
        return raw

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # byte-level symbols of these are the characters themselves
            low = word.lower()
            raw = self._piece(low) if low.isalpha() else b"".join(map(self._piece, _ASCII_PIECES.findall(low)))
        else:
            raw = b"".join(self._piece(piece) for piece, _ in self._cut(self._normalize(word)))
        if len(word) <= CACHE_LENGTH:
            if len(self._words) >= CACHE_WORDS:
                self._words.clear()
            self._words[word] = raw
        return raw

    def _plain(self, text: str) -> bytes:
        words = _GAPS.split(text) if _SEPARATORS.search(text) else text.split()
        get, found = self._words.get, []
        for word in words:
            raw = get(word)
            found.append(self._word(word) if raw is None else raw)
        return b"".join(found)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self._special is None or not self._special.search(text):
            return np.frombuffer(self._plain(text), np.uint32)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], np.uint32).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), np.uint32)

    def joined(self, ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
        """Strings of the ids joined by one space."""
        return ragged(*table, ids.astype(np.int64))[0][:-1].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.joined(np.asarray(ids), self.names).decode()


_loaded: dict[str, WordBpe] = {}


def codec(path: str) -> WordBpe:
    """The codec of a vocabulary file, loaded once per Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every document."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        return pa.RecordBatch.from_arrays([part["doc_id"], _lists([c.encode(x) for x in part["text"].to_pylist()])], ["doc_id", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches):
        c = codec(path)
        for part in batches:
            text = [c.decode(np.array(x or [], np.int64)) for x in part["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): encode, decode the ids again, and digest both."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [c.encode(text) for text in part["text"].to_pylist()]
        columns = {
            "doc_id": part["doc_id"],
            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(c.joined(x, c.numbers)).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(c.joined(x, c.names)).hexdigest() for x in ids], pa.string()),
        }
        if with_ids:
            columns["ids"] = _lists(ids)
        return pa.RecordBatch.from_pydict(columns)

    return map_arrow(docs.select("doc_id", "text"), run, schema)
