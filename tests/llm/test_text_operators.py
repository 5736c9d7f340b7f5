"""Line dedup, Jaccard join, decontamination: brute force, skew and odd rows."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, components, deduplicated, documents, leaked, prose, shingles
from pyspark.sql import functions as F

from pulselake.llm import decontam, linededup, queries, setjoin

ODD = [None, "", " ", "\n", "a", "\n\n\n", "ÉÀ ß 日本", "x" * 30, "word " * 3000]


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    pool = [prose(i, 6) for i in range(12)] + ["short", "", "  Padded Line Of Some Length  ", "padded line of some length"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)]
    want = deduplicated(rows)
    got = {r.doc_id: (r.n_dropped, r.text or "", r.keep_runs) for r in linededup.deduplicate(documents(spark, rows)).collect()}
    assert {k: v[:2] for k, v in got.items()} == want
    for i, t in rows:  # the bitmap says the same
        dropped, at = [], 0
        for run in got[i][2]:
            at += run
            dropped.append(at)
            at += 1
        kept = "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in set(dropped))
        assert kept == want[i][1]


def test_line_dedup_threshold_and_keeper(spark):
    line = "a line that is certainly long enough"
    got = {r.doc_id: r.n_dropped for r in linededup.deduplicate(documents(spark, [line, line.upper() + "\nrest"])).collect()}
    assert got == {0: 0, 1: 0}  # two documents are too few
    got = {r.doc_id: r.text for r in linededup.deduplicate(documents(spark, [line, line.upper() + "\nrest", "\t" + line + " \n" + line])).collect()}
    assert got == {0: "", 1: "rest", 2: "\t" + line + " \n" + line}  # the last keeps both of its lines


def test_line_dedup_repeated_rows_and_clashing_columns(spark):
    line = "the very same line in many documents here"
    rows = [(1, line), (1, line), (2, line), (None, line)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string")
    out = linededup.deduplicate(df)
    assert sorted(out.columns) == sorted(["doc_id", "text", "n_lines", "n_dropped", "keep_runs"])
    assert all(r.n_dropped == 0 for r in out.collect())  # two distinct documents only
    assert linededup.deduplicate(documents(spark, [])).count() == 0


def test_line_dedup_uses_no_python(spark, tmp_path):
    plan = linededup.deduplicate(documents(spark, ["a", "b"]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_first_occurrences_stream_from_sorted_ranges(spark):
    docs = documents(spark, ["a line that is long enough for a key\n" * 3] * 40)
    runs = linededup.sorted_runs(linededup.occurrences(docs))
    plan = runs._jdf.queryExecution().executedPlan().toString()
    order = [plan.index(x) for x in ("Window [lag(pos", "Sort [a#", "Exchange rangepartitioning(a#")]
    assert order == sorted(order) and "hashpartitioning" not in plan  # the sort feeds the window, nothing is dealt again
    got = runs.collect()
    assert len({r.range for r in got}) > 1 and sum(r.first for r in got) == 40  # one key, several tasks


def test_line_dedup_of_a_long_document_is_linear(spark):
    line = "this very line stands in every document"
    texts = ["\n".join(f"line number {i} of the long one" if i % 2 else line for i in range(200_000)), line, line, line]
    began = time.time()
    got = {r.doc_id: r for r in linededup.deduplicate(documents(spark, texts)).select("doc_id", "n_lines", "n_dropped", F.length("text").alias("chars")).collect()}
    assert time.time() - began < 30
    assert (got[0].n_lines, got[0].n_dropped) == (200_000, 100_000) and got[0].chars == len("\n".join(texts[0].split("\n")[1::2]))


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join_matches_brute_force(spark, width, percent):
    rng = random.Random(width)
    rows = []
    for group in range(8):
        base = prose(group, rng.choice([3, 4, 12, 60, 150])).split(" ")
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(99)
            rows.append(" ".join(w))
    passage = prose(77, 60)
    rows += [prose(200 + i, 80) + " " + passage for i in range(20)] + [rows[0], rows[0].upper()]
    rng.shuffle(rows)
    rows = list(enumerate(rows)) + [(900 + i, t) for i, t in enumerate(ODD)]
    got = {r.doc_id: r for r in setjoin.join_components(documents(spark, rows), width, percent).collect()}
    assert {k: r.component_id for k, r in got.items()} == components(rows, width, percent)
    assert {k: r.n_shingles for k, r in got.items()} == {i: len(shingles(t, width)) for i, t in rows}


def test_jaccard_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 16)
    monkeypatch.setattr(setjoin, "SMALL", 2)
    rng = random.Random(9)
    base = prose(5, 120).split(" ")
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in setjoin.join_components(documents(spark, rows), 4, 85).collect()}
    assert got == components(rows, 4, 85)


def test_jaccard_join_sends_no_text_for_a_shared_passage(spark, monkeypatch):
    passage, sent, links = prose(78, 60), [], setjoin._links

    def counted(asked, *rest):
        sent.append(asked.count())
        return links(asked, *rest)

    monkeypatch.setattr(setjoin, "_links", counted)
    rows = list(enumerate([prose(700 + i, 60) + " " + passage for i in range(60)] + [prose(700, 60) + " " + passage + " end"]))
    got = {r.doc_id: r.component_id for r in setjoin.join_components(documents(spark, rows).repartition(30), 4, 85).collect()}
    assert got == components(rows, 4, 85) and got[60] == 0
    assert sum(sent) <= 4 * len(rows)  # not a text for each pair that shares the passage


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_sketches_of_linked_sets_are_never_refused(percent):
    rng, linked, refused = np.random.default_rng(percent), 0, 0
    for n in [1, 2, 5, 31, 63, 64, 65, 127, 128, 129, 200, 257, 1000]:
        for changed in range(0, n + 2, max(1, n // 40)):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: max(0, len(a) - changed)], rng.integers(0, 1 << 63, int(rng.integers(0, changed + 1)), dtype=np.uint64)]))
            if not len(b):
                continue
            members = pa.table({"n": [len(a)], "sketch": [setjoin._sketch(a)]})
            queries = pa.table({"to": [7], "asks": [1], "n": [len(b)], "sketch": [setjoin._sketch(b)]})
            kept = setjoin._may_link(percent)(members, queries)
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert kept.to_pylist() == [{"cid": 1, "block": 7, "n": len(b)}]
                linked += 1
            else:
                refused += not kept.num_rows
    assert linked > 10 and refused > 10


def test_jaccard_join_odd_tables(spark):
    assert setjoin.join_components(documents(spark, []), 4, 85).count() == 0
    df = spark.createDataFrame([(1, prose(1, 30), "p"), (1, prose(2, 30), "q"), (None, prose(1, 30), "r")], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles) for r in setjoin.join_components(df, 4, 85).collect()), key=str)
    assert got == sorted([(1, 27), (1, 27), (None, 27)], key=str)
    kept = setjoin.keep_one(documents(spark, [prose(3, 50), prose(3, 50), "", None]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_keep_one_decides_repeated_doc_ids_per_text(spark):
    a, b, c, d, e = (prose(600 + i, 50) for i in range(5))
    rows = [(1, a), (5, a), (5, b), (1, c), (7, c)]  # 5 copies 1 with one text only; 1 holds two unlike texts
    rows += [(8, d), (8, d), (8, d + " more"), (9, d)]  # copies within one doc_id
    rows += [(4, e), (6, e), (6, e), (2, ""), (2, ""), (3, None), (None, b), (None, b)]
    kept = [(r.doc_id, r.text) for r in setjoin.keep_one(documents(spark, rows)).collect()]
    assert sum(i == 8 for i, _ in kept) == 1 and {t for i, t in kept if i == 8} <= {d, d + " more"}
    rest = [(1, a), (5, b), (1, c), (4, e), (2, ""), (2, ""), (3, None), (None, b), (None, b)]
    assert sorted((x for x in kept if x[0] != 8), key=str) == sorted(rest, key=str)


def test_keep_one_of_exact_repeated_rows(spark):
    for t in (prose(610, 40), "two words"):
        assert [(r.doc_id, r.text) for r in setjoin.keep_one(documents(spark, [(3, t), (3, t), (3, t)])).collect()] == [(3, t)]


def _benchmark(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_decontamination_catches_planted_and_leaves_clean(spark):
    items = [prose(300 + i, n) for i, n in enumerate((16, 30, 45, 59, 3))] + [None, ""]
    clean = [prose(i, 200) for i in range(12)]
    texts = clean + [f"{prose(50 + i, 40)}. {item.upper()}! {prose(90 + i, 40)}" for i, item in enumerate(items[:4])] + [items[1]] + ODD[:6]
    near = items[3].split(" ")
    near[0] = near[-1] = "changed"
    texts.append(prose(7, 30) + " " + " ".join(near))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(documents(spark, texts), _benchmark(spark, items)).collect()}
    want = {(d, i): leaked(t, x) for d, t in enumerate(texts) if t for i, x in enumerate(items) if x and leaked(t, x) >= 0.8}
    assert set(got) == set(want) and {(12, 0), (13, 1), (14, 2), (15, 3), (16, 1)} <= set(got)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    left = {r.doc_id for r in decontam.clean(documents(spark, texts), _benchmark(spark, items)).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}


def test_decontamination_tries_every_start(spark):
    items = [prose(400 + i, n) for i, n in enumerate((60, 60, 94, 60, 40))]
    w = [x.split(" ") for x in items]
    edited = [
        w[0][15:] + w[0][:15],  # the first 15 words moved to the end
        w[1][30:] + w[1][:30],  # halves swapped
        w[2][47:] + w[2][:47],
        ["p1", "p2", *w[3][2:30], "in1", "in2", "in3", "in4", *w[3][30:58], "p3", "p4"],  # changed ends, words inserted in the middle
        w[4][:20] + ["in5"] + w[4][20:],
    ]
    texts = [f"{prose(420 + i, 35)} {' '.join(e)} {prose(440 + i, 35)}" for i, e in enumerate(edited)] + [prose(460 + i, 150) for i in range(4)]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(documents(spark, texts), _benchmark(spark, items), min_similarity=0.7).collect()}
    want = {(d, i): leaked(t, x) for d, t in enumerate(texts) for i, x in enumerate(items) if leaked(t, x) >= 0.7}
    assert set(want) == {(i, i) for i in range(5)}
    assert got == pytest.approx(want)
    caught = {d for (d, _), x in want.items() if x >= 0.8}
    assert {0, 1, 2} <= caught
    left = {r.doc_id for r in decontam.clean(documents(spark, texts), _benchmark(spark, items)).collect()}
    assert left == set(range(len(texts))) - caught


def test_decontamination_of_documents_shorter_than_the_item(spark):
    items = [prose(500, 60), prose(501, 100), prose(502, 40), "one two three four five six", "seven eight nine"]
    w = [x.split(" ") for x in items]
    short = [w[0][:-2], w[1][:50] + w[1][51:], w[2][1:], w[2][:30], w[3][:5], w[4][:2], w[0][:4]]
    texts = [" ".join(x) for x in short]

    def whole(text, item, width=5):  # the document is the only window
        k = min(width, len(item.split(" ")))
        a, b = (Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)) for x in (text.split(" "), item.split(" ")))
        return sum((a & b).values()) / sum((a | b).values())

    for least in (0.8, 0.45):
        want = {(d, i): whole(t, x) for d, t in enumerate(texts) for i, x in enumerate(items) if len(short[d]) < len(w[i]) and whole(t, x) >= least}
        rows = decontam.leaks(documents(spark, texts), _benchmark(spark, items), min_similarity=least).collect()
        got = {(r.doc_id, r.item_id): r.similarity for r in rows if len(short[r.doc_id]) < len(w[r.item_id])}
        assert {(0, 0), (1, 1), (2, 2)} <= set(want) and got == pytest.approx(want)
        assert all((r.start, r.n_words) == (0, len(short[r.doc_id])) for r in rows if (r.doc_id, r.item_id) in want)
    left = {r.doc_id for r in decontam.clean(documents(spark, texts), _benchmark(spark, items)).collect()}
    assert not left & {0, 1, 2} and {3, 4, 5, 6} <= left


def test_decontamination_odd_tables(spark):
    none = _benchmark(spark, [])
    docs = documents(spark, ["a b c d e f", None])
    assert decontam.leaks(docs, none).count() == 0 and decontam.clean(docs, none).count() == 2
    assert decontam.leaks(documents(spark, []), _benchmark(spark, ["a b c d e f"])).count() == 0
    twice = spark.createDataFrame([(1, "one two three four five six", 5)] * 2, "doc_id long, text string, start int")
    rows = decontam.leaks(twice, _benchmark(spark, ["one two three four five six"])).collect()
    assert [(r.doc_id, r.item_id, r.start, r.similarity) for r in rows] == [(1, 0, 0, 1.0)]


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = random.Random(4)
    assert sum(w for _, w in decontam.blocks(20)) == 64
    for _ in range(300):
        a, flips = rng.getrandbits(64), rng.sample(range(64), rng.randint(0, 20))
        b = a
        for f in flips:
            b ^= 1 << f
        assert any((a >> s) & ((1 << w) - 1) == (b >> s) & ((1 << w) - 1) for s, w in decontam.blocks(20))


def test_simhash_counts_votes(spark):
    rng = random.Random(6)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(1, 40))] for _ in range(20)]
    df = spark.createDataFrame([(r,) for r in rows], "h array<long>")
    got = [r[0] for r in df.select(decontam.simhash(F.col("h"))).collect()]
    for r, g in zip(rows, got, strict=True):
        want = sum(1 << k for k in range(64) if 2 * sum((x >> k) & 1 for x in r) > len(r))
        assert g & ((1 << 64) - 1) == want
    many = spark.range(1).select(F.array_repeat(F.lit(-1), 70_000).cast("array<long>").alias("h"))  # more than a narrow lane holds
    assert many.select(decontam.simhash(F.col("h"))).first()[0] == -1


@pytest.mark.parametrize("bound", [0, decontam.BROADCAST_ITEMS])
def test_broadcast_bound_changes_no_result(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_ITEMS", bound)
    items = [prose(900 + i, 12 + i) for i in range(4)]
    texts = [prose(i, 20) + " " + items[i % 4] + " " + prose(50 + i, 9) if i % 2 else prose(i, 40) for i in range(12)]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(documents(spark, texts), _benchmark(spark, items)).collect()}
    assert got == {(i, i % 4) for i in range(1, 12, 2)}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_decontamination_sorts_no_texts(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, bench = documents(spark, [prose(i, 30) for i in range(4)]), _benchmark(spark, [prose(2, 30)])
        found, clean = _plan(decontam.leaks(docs, bench)), _plan(decontam.clean(docs, bench))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "LeftSemi" in found and "SortMergeJoin" not in found  # only texts with windows go on
    assert "BroadcastHashJoin" in clean and "LeftAnti" in clean and "SortMergeJoin" not in clean and "Exchange hash" not in clean
    texts = spark.createDataFrame([(1, ["a"] * 9)], "doc_id long, words array<string>")
    carried = re.findall(r"Generate posexplode\(.*\), \[([^\]]*)\], (?:false|true)", _plan(decontam.shingle_rows(texts, [5, 3])))
    assert len(carried) == 2 and not any("words" in x for x in carried)


@pytest.mark.parametrize("bound", [0, decontam.BROADCAST_ITEMS])
def test_decontamination_weighs_repeated_shingles(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_ITEMS", bound)
    turn = "one two three four five six"
    items = [" ".join([turn] * 4), f"{turn} {prose(970, 20)} {turn}"]
    bodies = [items[0], " ".join([turn] * 3) + " one two three", " ".join([turn] * 9), f"{turn} {prose(970, 20)} {turn}"]
    texts = [f"{prose(980 + i, 15)} {x} {prose(990 + i, 15)}" for i, x in enumerate(bodies)] + [prose(999, 40)]
    want = {(d, i): leaked(t, x) for d, t in enumerate(texts) for i, x in enumerate(items) if leaked(t, x) >= 0.8}
    assert {(0, 0), (2, 0), (3, 1)} <= set(want)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(documents(spark, texts), _benchmark(spark, items)).collect()}
    assert got == pytest.approx(want)
    left = sorted(r.doc_id for r in decontam.clean(documents(spark, [*enumerate(texts), (None, items[0])]), _benchmark(spark, items)).collect() if r.doc_id is not None)
    assert left == sorted(set(range(len(texts))) - {d for d, _ in want})


def test_line_query_digest(spark, tmp_path):
    rows = [(0, "x"), (1, None)]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in queries.QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}
