"""Spelling variant grouping by a positional q-gram inverted index.

Words are letter runs of all texts. Two words are near if exactly one inserted,
deleted or replaced letter parts them. A word's form is its near word of largest
count, if that is at least twice the word's own; its root is where the forms end.

Plan: words are counted over all texts with map-side combine. The index is cut into
blocks by what one edit cannot touch: a word of length n is cut in parts of at most
three letters (three parts at least), and a word that is one edit away agrees with
it in all parts but one. A block holds the words of length n (short) and n + 1
(long) that agree outside one open part, so length and position limits hold by
construction. The block's key includes all the other letters; hence the block is
bounded by the words that three or four letters can spell, whatever the corpus, and
no key grows with the number of texts.

Within a block the inverted index has a posting list for each (q-gram, position).
q-grams outside the open part are common to all words of the block and are counted
without being merged; the posting lists of a word's others are merged through a
heap, at its position for words of equal length and at its position or the next one
for longer words. One edit touches at most q of a word's q-grams (q - 1 for an
insertion), which gives the least number of lists that a near word appears in; words
that reach it are verified letter by letter. A pair that several open parts could
explain is counted in the first of them alone. What leaves a task is one row per
word and block: the number of near words and the best of them.

A null or empty text has no words. A null doc_id counts as an empty one when letters
are deleted. Repeated rows count again. Very long texts are taken whole. An empty
table, or one without frequent words, gives an empty result. Other columns do not
matter. Of words with equal counts the smallest in code-point order is the form.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linededup import _LOWER, _UPPER
from .shared import mark, partitions, settled, stored

MIN_CHARS = 5
MIN_COUNT = 3
#: Letters of a q-gram; words are padded with q - 1 marks at both ends.
GRAM = 2
#: A run loses a letter where this divides its hash (planted misspellings).
EVERY = 97
#: Letters of an open part at most.
PART = 3
#: A form has at least so many times the word's count.
RATIO = 2


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, run): maximal runs of letters, at least ``min_chars`` long."""
    found = F.regexp_extract_all(lowered(F.col("text")), F.lit(f"[a-zÀ-ÿ]{{{min_chars},}}"), F.lit(0))
    return docs.where("text is not null").select("doc_id", F.explode(found).alias("run"))


def thinned(found: DataFrame, every: int = EVERY) -> DataFrame:
    """(word): the runs; those whose hash with their document ``every`` divides lose one letter."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    x = found.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return x.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the frequent words and their counts."""
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def blocks(vocab: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, at, width, long, word, n): each word under each open part, as short word of its length and as long word of the length below."""
    roles = F.array(*(F.struct(F.lit(k).alias("long"), (F.length("word") - k).alias("size")) for k in (0, 1)))
    x = vocab.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.long", "r.size").where(F.col("size") >= min_chars)
    x = x.withColumn("parts", F.greatest(F.lit(3), F.ceil(F.col("size") / PART).cast("int"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = x.withColumn("at", F.expr("part * size div parts").cast("int")).withColumn("width", (F.expr("(part + 1) * size div parts") - F.col("at")).cast("int")).where("width > 0")
    before = F.substring(F.col("word"), F.lit(1), F.col("at"))
    after = F.substring(F.col("word"), F.col("at") + F.col("width") + F.col("long") + 1, F.length("word"))
    return x.select(F.concat_ws(":", F.col("size").cast("string"), F.col("part").cast("string"), before, after).alias("key"), "at", "width", "long", "word", "n")


def near_in_block(at: int, width: int, long: list[int], words: list[str], q: int = GRAM) -> list[tuple[int, int]]:
    """(i, j): the pairs of near words of one block, i short and j short (both ways round) or long."""
    head = ("^" * (q - 1) + words[0][:at])[at:]  # the letters next to the open part, the same for all
    tail = (words[0][at + width + long[0] :] + "$" * (q - 1))[: q - 1]
    opens = [w[at : at + width + k] for w, k in zip(words, long, strict=True)]
    grams = [[(s[p : p + q], p) for p in range(len(s) - q + 1)] for s in (head + m + tail for m in opens)]
    index: tuple[dict, dict] = ({}, {})
    for i, (k, own) in enumerate(zip(long, grams, strict=True)):
        for g in own:
            index[k].setdefault(g, []).append(i)
    same, longer = index
    out = []
    for i, own in enumerate(grams):
        if long[i]:
            continue
        for lists, least in (
            ([same[g] for g in own], width - 1),  # a replaced letter touches q of the width + q - 1 q-grams
            ([x for g, p in own for x in (longer.get((g, p)), longer.get((g, p + 1))) if x], width),  # an inserted one q - 1 of them
        ):
            if len(lists) < least:
                continue
            if least < 1:
                hits = [j for j, k in enumerate(long) if not k]
            else:
                hits, last, count = [], -1, 0
                for j in heapq.merge(*lists):
                    count = count + 1 if j == last else 1
                    last = j
                    if count == least:
                        hits.append(j)
            a = opens[i]
            for j in hits:
                b = opens[j]
                if not long[j]:
                    if i != j and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
                        out.append((i, j))
                elif any(b[:x] + b[x + 1 :] == a for x in range(width + 1)) and not (at and b[1:] == a):  # else the part before explains it
                    out.append((i, j))
    return out


def _search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks in key order, across the borders of the batches; one row for each word that is near to others of its block."""
    rest: pd.DataFrame | None = None

    def of(x: pd.DataFrame) -> pd.DataFrame:
        key = x["key"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        at, width, long, word, n = (x[c].tolist() for c in ("at", "width", "long", "word", "n"))
        found: list[tuple[str, int, int, str]] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a == 1 or 0 not in long[a:b]:
                continue
            near: dict[int, list] = {}
            for i, j in near_in_block(at[a], width[a], long[a:b], word[a:b]):
                for me, other in ((i, j), (j, i)) if long[a + j] else ((i, j),):
                    best = (-n[a + other], word[a + other])
                    mine = near.setdefault(me, [0, best])
                    mine[0] += 1
                    mine[1] = min(mine[1], best)
            found += [(word[a + i], k, -best[0], best[1]) for i, (k, best) in near.items()]
        return pd.DataFrame(found, columns=["word", "n_near", "best_n", "best"])

    for frame in frames:
        if not len(frame):
            continue
        x = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        key = x["key"].to_numpy()
        cut = len(x) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
        rest = x.iloc[cut:]
        if cut:
            yield of(x.iloc[:cut])
    if rest is not None:
        yield of(rest)


def near_words(vocab: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n_near, best_n, best): how many words are near, and the most frequent of them, for words that have any."""
    spark = vocab.sparkSession
    dealt = blocks(vocab, min_chars).repartition(partitions(spark), "key").sortWithinPartitions("key")
    found = dealt.mapInPandas(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("x")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("x.m")).alias("best_n"), F.col("x.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of ``forms`` (word, form): where the chain of forms ends.

    Counts at least double along a chain, so it has no loop and fewer steps than a
    count has bits. Each round doubles the steps taken; words that have arrived leave.
    """
    under_way = known = forms.select("word", F.col("form").alias("root"))
    arrived = None
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(under_way.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNull().alias("end")), "steps")
        ended, under_way = step.where("end").select("word", "root"), step.where("not end").select("word", "root")
        arrived = ended if arrived is None else arrived.unionByName(ended)
        if under_way.isEmpty():
            return arrived
        known = arrived.unionByName(under_way)


def group(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, every: int = EVERY) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every frequent word of the texts."""
    since = mark()
    vocab = stored(vocabulary(thinned(runs(docs, min_chars), every), min_chars, min_count), "vocabulary")
    near = near_words(vocab, min_chars)
    held = F.col("best_n") >= ratio * F.col("n")
    x = stored(
        vocab.join(near.hint("merge"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(held, F.col("best")).alias("form"), F.when(held, F.col("best_n")).alias("form_n")
        ),
        "forms",
    )
    ends = roots(x.where("form is not null"))
    out = x.join(ends.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
    return settled(out, "variants", since)
