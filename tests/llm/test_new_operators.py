"""Spelling variants and shards against brute force; tables of callers in other threads."""

import heapq
import random
import re
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from helpers import DOCS, LOWER, documents, prose

from pulselake.llm import linededup, queries, sharding, variants

SF = "/root/testdata/sf0.001"


def plain_words(rows):
    """Counts of the words of (doc_id, text) rows."""
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = plain_words(rows)
    deleted = {}
    for w in counts:  # words that meet in a deletion, or one in the other's, are the only ones to compare
        for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            deleted.setdefault(v, set()).add(w)
    meet = {w: set() for w in counts}
    for ws in deleted.values():
        for w in ws:
            meet[w] |= {v for v in ws if near(w, v)}
    form = {}
    for w, others in meet.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n, len(meet[w]), form[w], counts.get(form[w]), root(w)) for w, n in counts.items())


def got_variants(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def test_variants_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 1000 and sum(x[3] is not None for x in want) > 100
    df = queries.op11_spelling_variants(spark, SF)
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert got_variants(df) == want


def test_variants_of_dense_words(spark):
    """Few letters, so that blocks are large, edits ambiguous and chains of forms long."""
    rng = random.Random(4)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaaaaaaé"]
    texts = [" ".join(w for w in pool for _ in range(int(3 * 2 ** rng.uniform(0, 5)))) for _ in range(2)]
    rows = list(enumerate(texts))
    want = plain_variants(rows)
    assert max(x[2] for x in want) > 5 and any(x[5] not in (x[0], x[3]) for x in want)
    assert got_variants(variants.group(documents(spark, rows))) == want


def test_every_pair_in_one_block(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(5, 12))) for _ in range(300)})
    words += sorted({w[:i] + rng.choice("abz") + w[i + rng.randint(0, 1) :] for w in words for i in (0, 2, len(w))} - set(words))
    found = Counter()
    vocab = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    by = {}
    for r in variants.blocks(vocab).collect():
        by.setdefault(r.key, []).append(r)
    for rows in by.values():
        long, own = [r.long for r in rows], [r.word for r in rows]
        for i, j in variants.near_in_block(rows[0].at, rows[0].width, long, own):
            found[own[i], own[j]] += 1
            if long[j]:
                found[own[j], own[i]] += 1
    assert found == Counter({(a, b): 1 for a in words for b in words if near(a, b)})


@pytest.mark.parametrize("q", [1, 2, 3, 4])
def test_gram_length_changes_nothing(q):
    words = ["abcde", "abxde", "abde", "abcxde", "abxxde", "abccde"]
    block = [w for w in words if len(w) in (5, 6)]
    got = variants.near_in_block(2, 1, [int(len(w) == 6) for w in block], block, q=q)
    assert {(block[i], block[j]) for i, j in got} == {("abcde", "abxde"), ("abxde", "abcde"), ("abcde", "abcxde")}
    # a letter put in right before the open part counts there: abxde and abxxde, abcde and abccde, abxde and abcxde


def test_variants_of_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert variants.group(empty).count() == 0
    assert variants.group(documents(spark, [None, "", "1 2 ***", "abcde abcde"])).count() == 0
    rows = [(None, "house house mouse"), (7, "HOUSE Mouse"), (7, "HOUSE Mouse"), (8, "Ärger Ärger ärger ÄRGER x" * 40), (9, "word" + "x" * 20_000 + " house" * 40_000)]
    clash = documents(spark, rows).selectExpr("*", "1 as word", "2 as n", "'x' as form", "3 as root", "4 as key", "5 as h")
    assert got_variants(variants.group(clash)) == plain_variants(rows)


def plain_schedule(sizes, shards):
    heap, out = [(0, i) for i in range(shards)], [0] * shards
    for s in sorted(sizes, reverse=True):
        load, i = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (load + s, i))
    return out, sorted(x for x, _ in heap)


@pytest.mark.parametrize("seed", range(20))
def test_schedule_equals_single_steps(seed):
    rng = random.Random(seed)
    shards, sizes = rng.randint(1, 9), []
    for _ in range(rng.randint(1, 6)):
        sizes += [rng.randint(1, 500)] * rng.choice([1, 2, 40, 700])
    classes = [(s, n, s * n) for s, n in Counter(sizes).items()]
    plan = sharding.schedule(classes, shards)
    taken, loads = plain_schedule(sizes, shards)
    assert [sum(x[1][i] for x in plan) for i in range(shards)] == taken
    assert sorted(sum(s * x[i] for s, x in plan) for i in range(shards)) == loads


def check_shards(rows, got, shards):
    """Rows of (doc_id, text); got rows with doc_id, size, text_crc32, shard, slot."""
    raw = lambda t: (t or "").encode()
    key = lambda i: (i is not None, i or 0)
    want = sorted((key(i), len(raw(t)) + 8, zlib.crc32(raw(t))) for i, t in rows)
    assert sorted((key(r.doc_id), r.size, r.text_crc32) for r in got) == want
    home, slots, load = {}, {}, [0] * shards
    for r in got:
        assert 0 <= r.shard < shards
        home.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        slots.setdefault(r.shard, []).append((r.slot, key(r.doc_id)))
        load[r.shard] += r.size
    assert all(len(x) == 1 for x in home.values())
    for x in slots.values():
        assert [s for s, _ in sorted(x)] == list(range(len(x)))
        assert [d for _, d in sorted(x)] == sorted(d for _, d in x)
    return load


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df = queries.op12_sharding(spark, SF)
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = df.collect()
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    load = check_shards(rows, got, 24)
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    _, best = plain_schedule(groups.values(), 24)
    assert max(load) <= 1.01 * max(best) and min(load) >= 0.99 * min(best)


def test_many_small_groups_and_a_hot_one(spark):
    texts = [prose(i, 5 + i % 40) for i in range(4000)] + [prose(1, 200)] * 1500 + [None, "", None]
    rows = list(enumerate(texts))
    load = check_shards(rows, sharding.assign(documents(spark, rows), 7).collect(), 7)
    hot = 1500 * (len(texts[4000].encode()) + 8)
    rest = sorted(load)[:-1] if max(load) == hot else sorted(load)
    assert max(rest) - min(rest) < 0.005 * sum(load)


def test_shards_of_odd_tables(spark):
    assert sharding.assign(spark.createDataFrame([], DOCS), 3).count() == 0
    rows = [(None, "a"), (None, "a"), (3, "a"), (3, "b"), (4, None), (5, ""), (6, "x" * 300_000), (6, "x" * 300_000), (7, "é")]
    clash = documents(spark, rows).selectExpr("*", "1 as shard", "2 as a", "3 as size", "4 as slot", "5 as part", "6 as class")
    check_shards(rows, sharding.assign(clash, 3).collect(), 3)
    assert {r.shard for r in sharding.assign(documents(spark, rows), 1).collect()} == {0}


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i % 30}") for i in range(100)]
    sharding.write(documents(spark, rows).selectExpr("*", "doc_id as a"), 4, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text, r.a) for r in back.collect()) == [(i, t, i) for i, t in rows]
    placed = {r.doc_id: r.shard for r in sharding.assign(documents(spark, rows), 4).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == placed


def test_callers_in_threads_keep_their_tables(spark):
    docs = documents(spark, [prose(i, 30) + "\n" + prose(i % 3, 20) for i in range(60)])

    def run(_):
        return sorted((r.doc_id, r.text) for r in linededup.deduplicate(docs).collect())

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(run, range(4)))
    assert found[0] == found[1] == found[2] == found[3]
